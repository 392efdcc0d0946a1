"""The toxicity features of whole texts against a plain reading: word by word, one transducer after the other."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import common
from tesserae.llm import op09_toxicity as g

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[0-9A-Za-z'\x80-\xff]+")


def plain(text: str, lexicon: dict[bytes, float]) -> list[float]:
    closed = {}
    for symbol, words in ((g.INTENT, g.INTENTS), (g.COPULA, g.COPULAS), (g.TARGET, g.TARGETS), (g.NEGATION, g.NEGATIONS), (g.REPORT, g.REPORTS), (g.THREAT, g.THREATS)):
        closed |= {w.encode(): symbol for w in words}
    clauses, hits, total = [], 0, 0
    for clause in re.split(rb"[.!?;\n]", text.encode()):
        words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(clause)]
        total += len(words)
        symbols, weights = [], []
        for w in words:
            found = max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + b"*", 0.0) for k in g.PREFIXES if len(w) > k)])
            symbol = closed.get(w, g.INSULT if found > 0 else g.OTHER)
            symbols.append(symbol)
            weights.append(found + g.THREAT_WEIGHT if symbol == g.THREAT else found if symbol == g.INSULT else 0.0)
        attacks = sum(s in (g.INSULT, g.THREAT) for s in symbols)
        if not attacks:
            continue
        hits += attacks
        factors, bonus = [1.0] * len(words), 0.0
        for part in (g.insulting(), g.threatening(), g.targeting(), g.negation(), g.reported_speech()):
            state = part.start
            for i, s in enumerate(symbols):
                state, factor, more = part.step(state, s)
                factors[i] *= factor
                bonus += more
        clauses.append(sum(w * f for w, f in zip(weights, factors, strict=True)) + bonus)
    return [1.0, math.log1p(sum(clauses)), max(clauses, default=0.0), math.log1p(hits), math.log1p(total)]


@pytest.fixture
def grammar():
    lexicon = {b"idiot": 2.0, b"scum": 3.0, b"mor*": 9.0, b"stup*": 1.5}
    whole = [w.decode() for w in lexicon if not w.endswith(b"*")]
    starts = [w[:-1].decode() for w in lexicon if w.endswith(b"*") and len(w) - 1 in g.PREFIXES]
    keys = np.concatenate([g._hash(whole), g._hash(starts) ^ np.uint64(0x5BD1E995)])
    weights = np.array([lexicon[w.encode()] for w in whole] + [lexicon[w.encode() + b"*"] for w in starts])
    order = np.argsort(keys)
    return g.Grammar(keys[order], weights[order], g.closed_classes(), np.zeros(5)), lexicon


def test_features_of_whole_texts(grammar):
    machine, lexicon = g.grammar_machine(), grammar[1]
    texts = ["", "You are an IDIOT. He said you idiot; not a stupid stupidity!", "I'll kill you. kill. going to the end to hurt them", "scum scum\nyou scum you", "they wrote: stupidly she is idiot no scum"]
    texts += [t for (t,) in duckdb.connect().sql(f"select coalesce(text, '') from '{SF}/documents.parquet' order by doc_id").fetchall()]
    texts += [" ".join(texts) + "."]
    got = g.measure(pa.array(texts), grammar[0], machine)
    assert np.allclose(got, [plain(t, lexicon) for t in texts])


def test_long_texts_are_read_in_pieces(grammar):
    machine, lexicon = g.grammar_machine(), grammar[1]
    long = "you are an idiot, he said. kill them! nothing here; not scum\n" * 40_000
    assert len(long) > 2 * common.PASS_BYTES
    assert np.allclose(g.measure(pa.array(["a", long, "scum"]), grammar[0], machine), [plain(t, lexicon) for t in ("a", long, "scum")])
