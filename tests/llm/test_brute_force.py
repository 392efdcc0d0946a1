"""The contracts, word by word in plain Python, on a small table."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest
import xxhash

from tesserae.llm import op02_decontaminate
from tesserae.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def read(sql):
    return duckdb.connect().sql(sql).fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(read(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'"))


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    order = [list(rel.columns).index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


def test_decontamination(spark, texts):
    items = read(f"select item_id, text from '{SF}/benchmark.parquet'")
    got = rows(spark, "op2_benchmark_decontamination")
    for i in list(texts)[::7]:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == op02_decontaminate.brute_force(texts[i], items)


def test_fingerprints(spark, texts):
    got = rows(spark, "op3_document_fingerprints")
    cut = re.compile(r"\n|(?<=[.!?])(?<=[^.!?\n]{60}.)[ \t]+")
    pieces = lambda t: set(collections.Counter(x for x in cut.split(t) if x).items())
    ids = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        text, after, r = texts[i], texts[ids[(k + 1) % len(ids)]], got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = pieces(text), pieces(other)
            assert math.isclose(near, len(a & b) / len(a | b) if a | b else 1.0)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_language_on_held_out_rows(spark):
    lang = dict(read(f"select doc_id, lang from '{SF}/documents.parquet'"))
    held = [r for r in rows(spark, "op5_language_id").values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_lm_base_and_gain(spark, texts):
    got = rows(spark, "op6_lm_scoring")
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i in words if i not in held for w in words[i])
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(words[i]), sum(counts[w] > 0 for w in words[i]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-6)
    assert sum(got[i].score - got[i].base_score for i in held) > 0


def test_simhash_components(spark, texts):
    got, prints = rows(spark, "op10_simhash_near_dedup"), {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[a], changed = least[b], True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", least[i]) for i in texts}


def test_toxicity_scores_are_probabilities(spark):
    got = rows(spark, "op9_toxicity")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
