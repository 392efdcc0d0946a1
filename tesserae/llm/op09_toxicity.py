"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), threat verb, target, copula, intent,
negation, reported speech, other. Five transducers read a clause:

* insult: an insult in full where it follows its target ("you idiot", "you are an
  idiot") or another insult ("stupid fool"), or where a target follows it; alone it
  keeps half its weight;
* threat: a threat verb in full after an intent ("will", "going to") or once a
  target follows it; alone it keeps a quarter;
* target: a bonus once the clause holds both an attack and a target;
* negation rewrites the attacks in its scope;
* reported speech rewrites the attacks after a verb of saying.

They are composed into one machine by the product construction, which scores the
clauses that hold an insult or a threat. A text's features are the sum of its
clauses, its worst clause, and its numbers of attacks and words.

The insult lexicon is learned: words and word beginnings are weighted by the
smoothed log odds of occurring in a toxic text, where these differ from chance,
from a bounded sample of labelled rows (at most about `per_class` of each label,
picked by a hash of the id); it has as many entries as the sample gives. Seven
tenths of the sample teach the lexicon, the rest calibrates the features to a
probability by logistic regression. Scoring covers whole texts and touches each
row once; nothing is shuffled. A clause ends at . ! ? ; or a line end; in a text
longer than a pass, one of more than 64 KB may be cut.

Defined results: null or empty text: the calibrated score of a text without a
match; no labelled rows of both kinds: the fixed grammar with default
calibration; repeated rows: equal rows; several labels of one id: each counts;
further columns are ignored (or, in `reject_toxic`, kept).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import LOWER, held_out, passes, per_text, pieces, span_hashes, spans, table, text_buffer, trim

#: Closed classes of the grammar, in English, French, German and Spanish.
THREATS = "kill hurt destroy beat burn smash stab shoot hang tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split()
TARGETS = "you your yours yourself u ur he she him her they them their vous votre toi ton tu du dich dir euch ihr ihnen usted ustedes te vosotros".split()
NEGATIONS = "not never no none neither nor isn't aren't wasn't don't doesn't didn't won't pas jamais aucun ne nicht nie kein keine nunca jamás ningún".split()
REPORTS = "said says say saying called calls wrote writes claimed quoted reported allegedly dit disait écrit sagte sagt schrieb dijo dice escribió".split()

COPULAS = "are r is am be being was were you're ur es est êtes suis sont bist seid ist sind eres sois son".split()
INTENTS = "will gonna going shall i'll we'll must should want vais allons va veux werde werden will soll voy vamos quiero".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, INTENT = SYMBOLS = range(8)
#: Forms that the transducers write for insults and threats.
PLAIN, NEGATED, REPORTED, LONE_INSULT, LONE_THREAT = 1.0, 0.2, 0.4, 0.5, 0.25
#: Words over which a negation, an intent, a target or an insult reaches.
SCOPE, NEAR = 3, 3
TARGET_BONUS, AIMED_INSULT, AIMED_THREAT = 0.5, 0.75, 1.0
THREAT_WEIGHT = 1.5

#: Bytes of words: letters, digits, apostrophe, all non-ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
WORD[0x27] = True
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True
#: Bytes of the word beginnings that may carry a weight.
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Transducer:
    """A deterministic weighted transducer over symbols: (state, symbol) -> (state, factor, bonus)."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), self.arcs.get((state, None)))


def insulting() -> Transducer:
    """The state counts down the words since a target or copula, or since an insult."""
    arcs: dict = {}
    for kind in ("none", "aimed", "insulted"):
        for left in range(1, NEAR + 1) if kind != "none" else (0,):
            state, after = (kind, left), (kind, left - 1) if left > 1 else ("none", 0)
            aimed = ("aimed", NEAR)
            arcs[(state, None)] = (after, PLAIN, 0.0)
            arcs[(state, TARGET)] = (aimed, PLAIN, AIMED_INSULT if kind == "insulted" else 0.0)
            arcs[(state, COPULA)] = (aimed if kind == "aimed" else after, PLAIN, 0.0)
            arcs[(state, INSULT)] = (("insulted", NEAR), PLAIN if kind != "none" else LONE_INSULT, AIMED_INSULT if kind == "aimed" else 0.0)
    return Transducer(("none", 0), arcs)


def threatening() -> Transducer:
    """The state counts down the words since an intent, or since a threat verb."""
    arcs: dict = {}
    for kind in ("none", "meant", "threat"):
        for left in range(1, NEAR + 1) if kind != "none" else (0,):
            state, after = (kind, left), (kind, left - 1) if left > 1 else ("none", 0)
            arcs[(state, None)] = (after, PLAIN, 0.0)
            arcs[(state, INTENT)] = (("meant", NEAR), PLAIN, 0.0)
            arcs[(state, TARGET)] = (("none", 0) if kind == "threat" else after, PLAIN, AIMED_THREAT if kind == "threat" else 0.0)
            arcs[(state, THREAT)] = (("threat", NEAR), PLAIN if kind == "meant" else LONE_THREAT, 0.0)
    return Transducer(("none", 0), arcs)


def negation() -> Transducer:
    arcs: dict = {}
    for left in range(SCOPE + 1):
        after = max(0, left - 1)
        arcs[(left, None)] = (after, PLAIN, 0.0)
        arcs[(left, NEGATION)] = (SCOPE, PLAIN, 0.0)
        for s in (INSULT, THREAT):
            arcs[(left, s)] = (after, NEGATED if left else PLAIN, 0.0)
    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    arcs: dict = {}
    for heard in (False, True):
        arcs[(heard, None)] = (heard, PLAIN, 0.0)
        arcs[(heard, REPORT)] = (True, PLAIN, 0.0)
        for s in (INSULT, THREAT):
            arcs[(heard, s)] = (heard, REPORTED if heard else PLAIN, 0.0)
    return Transducer(False, arcs)


def targeting() -> Transducer:
    """One bonus for a clause with both a target and an attack, in either order."""
    states = {"none": ("seen", "attack"), "seen": ("seen", "both"), "attack": ("both", "attack"), "both": ("both", "both")}
    arcs: dict = {}
    for state, (on_target, on_attack) in states.items():
        arcs[(state, None)] = (state, PLAIN, 0.0)
        arcs[(state, TARGET)] = (on_target, PLAIN, TARGET_BONUS if on_target == "both" != state else 0.0)
        for s in (INSULT, THREAT):
            arcs[(state, s)] = (on_attack, PLAIN, TARGET_BONUS if on_attack == "both" != state else 0.0)
    return Transducer("none", arcs)


def compose(*parts: Transducer) -> Transducer:
    """The product machine: factors multiply, bonuses add."""
    start = tuple(p.start for p in parts)
    out, todo, seen = Transducer(start), [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            to = tuple(s[0] for s in steps)
            out.arcs[(state, symbol)] = (to, float(np.prod([s[1] for s in steps])), sum(s[2] for s in steps))
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return out


def grammar_machine() -> Transducer:
    return compose(insulting(), threatening(), targeting(), negation(), reported_speech())


def score_clause(machine: Transducer, symbols: list[int], weights: list[float], gaps: list[int]) -> float:
    """gaps: words between a symbol and the one before it."""
    state, total, arcs = machine.start, 0.0, machine.arcs
    for symbol, weight, gap in zip(symbols, weights, gaps, strict=True):
        for _ in range(min(gap, max(SCOPE, NEAR))):
            state = arcs[(state, OTHER)][0]
        state, factor, bonus = arcs[(state, symbol)]
        total += weight * factor + bonus
    return total


@dataclass
class Grammar:
    keys: np.ndarray  # sorted hashes of words and beginnings
    weights: np.ndarray
    classes: dict[int, int]  # hash of a word -> its closed class
    coefficients: np.ndarray  # of 1, score, best clause, hits, log words

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def _hash(words: list[str]) -> np.ndarray:
    data, at = text_buffer(pa.array(words, pa.string()))
    return span_hashes(LOWER[data], at[:-1], at[1:])


def closed_classes() -> dict[int, int]:
    out: dict[int, int] = {}
    for symbol, words in ((INTENT, INTENTS), (COPULA, COPULAS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):  # a later class wins
        out.update(zip(_hash(words).tolist(), [symbol] * len(words), strict=True))
    return out


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = text_buffer(texts)
    data = LOWER[data]
    start, end = spans(WORD[data], at)
    return data, start, end, np.searchsorted(start, at)


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, hashes): whole words, then beginnings; a beginning's hash never equals a word's."""
    everything = np.arange(len(start))
    yield everything, span_hashes(data, start, end)
    for k in PREFIXES:
        use = everything[end - start > k]
        yield use, span_hashes(data, start[use], start[use] + k) ^ np.uint64(0x5BD1E995)


def beginnings(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows): the words and word beginnings of each text, once a text, in order of the hash."""
    held: list[np.ndarray] = []
    for part, rows, _, whole in pieces(texts, WORD):
        data, start, end, before = _tokens(part)
        owner = rows[np.searchsorted(before[1:], np.arange(len(start)), "right")]
        found = list(_features(data, start, end))
        h, o = np.concatenate([x for _, x in found]), np.concatenate([owner[use] for use, _ in found])
        if held or not whole:  # a long text, piece by piece
            held.append(np.unique(h))
            if not whole:
                continue
            h = np.unique(np.concatenate(held))
            o, held = np.full(len(h), rows[0]), []
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        if len(h):
            first = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
            yield h[first], o[first]


def measure(texts: pa.Array, grammar: Grammar, machine: Transducer) -> np.ndarray:
    """Per text: 1, sum of clause scores (log), best clause, hits (log), words (log)."""
    total, best, hits, words = np.zeros((4, len(texts)))
    for part, rows, _, _ in pieces(texts, WORD, prefer=CLAUSE_END):
        t, b, h, w = _measure(part, grammar, machine)
        total[rows] += t
        best[rows] = np.maximum(best[rows], b)
        hits[rows] += h
        words[rows] += w
    return np.stack([np.ones(len(texts)), np.log1p(total), best, np.log1p(hits), np.log1p(words)], 1)


def symbols_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each word, and the weight of each insult and threat."""
    weight, word_hashes = np.zeros(len(start)), None
    for use, hashes in _features(data, start, end):
        word_hashes = hashes if word_hashes is None else word_hashes
        if len(grammar.keys):
            spot = np.minimum(np.searchsorted(grammar.keys, hashes), len(grammar.keys) - 1)
            hit = np.flatnonzero(grammar.keys[spot] == hashes)
            np.maximum.at(weight, use[hit], grammar.weights[spot[hit]])
    known = np.array(sorted(grammar.classes), np.uint64)
    spot = np.minimum(np.searchsorted(known, word_hashes), len(known) - 1)
    closed = np.flatnonzero(known[spot] == word_hashes)
    symbol = np.zeros(len(start), np.int64)
    symbol[closed] = [grammar.classes[int(h)] for h in word_hashes[closed].tolist()]
    symbol[(weight > 0) & (symbol == OTHER)] = INSULT
    weight[symbol == THREAT] += THREAT_WEIGHT
    weight[(symbol != INSULT) & (symbol != THREAT)] = 0
    return symbol, weight


def _measure(texts: pa.Array, grammar: Grammar, machine: Transducer) -> np.ndarray:
    """Rows of total, best, hits and words."""
    data, start, end, before = _tokens(texts)
    out = np.zeros((4, len(texts)))
    out[3] = np.diff(before)
    if not len(start):
        return out
    symbol, weight = symbols_of(data, start, end, grammar)
    owner = np.searchsorted(before[1:], np.arange(len(start)), "right")
    ends = np.append(0, np.cumsum(CLAUSE_END[data], dtype=np.int32))
    clause = np.cumsum(np.append(True, (np.diff(ends[start]) > 0) | (np.diff(owner) > 0))) - 1
    attack = (symbol == INSULT) | (symbol == THREAT)
    live = np.zeros(int(clause[-1]) + 1, bool)
    live[clause[attack]] = True
    use = np.flatnonzero(live[clause] & (symbol != OTHER))
    if not len(use):
        return out
    cut = np.flatnonzero(np.append(True, np.diff(clause[use]) > 0))
    gap = np.append(0, np.diff(use) - 1)
    gap[cut] = 0
    symbols, weights, gaps = symbol[use].tolist(), weight[use].tolist(), gap.tolist()
    np.add.at(out[2], owner[use[attack[use]]], 1)
    edges = np.append(cut, len(use)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s, text = score_clause(machine, symbols[a:b], weights[a:b], gaps[a:b]), owner[use[a]]
        out[0, text] += s
        out[1, text] = max(out[1, text], s)
    return out


def _sample(labels: DataFrame, per_class: int) -> list[tuple[int, int, bool]]:
    """(doc_id, toxic, for the lexicon): about per_class of each label, by a hash threshold."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    counts = dict(rows.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return []
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)))
    share = F.when(F.col("toxic") == 1, F.lit(int(min(1, per_class / counts[1]) * (1 << 40)))).otherwise(F.lit(int(min(1, per_class / counts[0]) * (1 << 40))))
    picked = hashed.where(F.col("h") < share).select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) < 7).alias("teach"))
    return [tuple(r) for r in picked.collect()]


def train(documents: DataFrame, labels: DataFrame, per_class: int = 10_000, least_weight: float = 1.5, least_z: float = 2.0) -> Grammar:
    """Learn the lexicon (words of a log odds and a deviation from chance of at least the given ones) and the calibration."""
    spark = documents.sparkSession
    grammar = Grammar(np.empty(0, np.uint64), np.empty(0), closed_classes(), np.array([-4.0, 2.0, 0.5, 1.0, 0.0]))
    sample = _sample(labels, per_class)
    if not sample:
        return grammar
    picked = spark.createDataFrame(sample, "doc_id long, toxic int, teach boolean")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for h, owner in beginnings(batch.column("text")):
                bad = toxic[owner]
                cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n1 = np.add.reduceat(bad, cut)
                n = np.diff(np.append(cut, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array((n - n1).astype(np.int64)), pa.array(n1.astype(np.int64))], names=["h", "n0", "n1"])
            trim()

    sizes = [sum(1 for _, t, teach in sample if teach and t == y) for y in (0, 1)]
    a = 0.5
    odds = F.log((F.col("n1") + a) / (sizes[1] + 2 * a)) - F.log((F.col("n0") + a) / (sizes[0] + 2 * a))
    expected = (F.col("n0") + F.col("n1")) * F.lit(sizes[1] / max(1, sum(sizes)))
    found = (
        rows.where("teach").select("text", "toxic").mapInArrow(count, "h long, n0 long, n1 long")
        .groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .withColumn("w", odds).where((F.col("w") >= least_weight) & (F.col("n1") - expected >= F.lit(least_z) * F.sqrt(expected + 1)))
        .select("h", "w").toArrow()
    )
    keys = found["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    grammar.keys, grammar.weights = keys[order], found["w"].to_numpy()[order]
    machine = grammar_machine()
    shared = spark.sparkContext.broadcast(vars(grammar))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            x = measure(batch.column("text"), Grammar(**shared.value), machine)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, i]) for i in range(5))], names=["toxic", *"abcde"])

    held = rows.where("not teach").select("text", "toxic").mapInArrow(look, "toxic int, a double, b double, c double, d double, e double").toArrow()
    y = held["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.stack([held[c].to_numpy() for c in "abcde"], 1)
        order = np.lexsort((*x.T, y))  # the same sum in any order of rows
        grammar.coefficients = logistic(x[order], y[order])
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(spark: SparkSession, grammar: Grammar) -> Callable[[Column], Column]:
    """A column function: the toxicity of a text."""
    shared, machine = spark.sparkContext.broadcast(vars(grammar)), grammar_machine()

    def run(texts: pa.Array) -> pa.Array:
        g = Grammar(**shared.value)
        return pa.array(g.probability(measure(texts, g, machine)))

    return per_text(run, "double")


def reject_toxic(documents: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The documents whose toxicity is below the threshold; their columns stay as they are."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = F.col(names[documents.columns.index("text")]).cast("string")
    return documents.toDF(*names).where(toxicity(documents.sparkSession, grammar)(text) < threshold).toDF(*documents.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 5, 0)
    grammar = train(documents, labels.where(~held))
    scored = documents.select("doc_id", held.alias("held_out"), toxicity(spark, grammar)(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
