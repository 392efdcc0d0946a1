"""Draws, selections, neighbours and hashes that stay bounded as tables grow."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.functions import vectorised as U
from tesserae.operators import curation as C
from tesserae.operators import distributions as D
from tesserae.operators import neighbours as N


def test_draws_do_not_depend_on_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_PART", 150)
    monkeypatch.setattr(D, "DRAWS_A_BLOCK", 700)
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1000, 400).astype(float)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "key long, x double")
    totals = []
    for parts in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        totals.append([r.total for r in D.drawn_sums(frame, 200, 2000).orderBy("draw").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert totals[0] == totals[1] and len(totals[0]) == 2000
    assert abs(np.mean(totals[0]) - 200 * values.mean()) < 5 * np.sqrt(200 * values.var() * 200 / 399 / 2000)
    assert abs(np.var(totals[0]) / (200 * values.var() * 200 / 399) - 1) < 0.2


def test_percentiles_of_all_pairs_are_exact(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(70, 6))
    m[5:15] = m[5]  # copies: many pairs of one cosine
    frame = spark.createDataFrame([(i, i % 2, m[i].tolist()) for i in range(70)], "id long, label long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    shares = [0.0, 0.01, 0.33, 0.5, 0.95, 1.0]
    blocks = F.array(F.concat_ws("-", "q_label", "g_label"), F.lit("pooled"))
    got = {r.block: r for r in D.cosine_distribution(frame, blocks, shares, bins=8, block=16).collect()}
    assert sorted(got) == ["0-0", "0-1", "1-0", "1-1", "pooled"]
    for name, r in got.items():
        x = np.array([cos[a, b] for a in range(70) for b in range(70) if a != b and name in ("pooled", f"{a % 2}-{b % 2}")])
        assert r.n == len(x) and np.allclose([r["mean"], r.sd, r.min, r.max], [x.mean(), x.std(), x.min(), x.max()])
        assert np.allclose([r[f"p{round(p * 100)}"] for p in shares], np.quantile(x, shares), atol=1e-12)


def test_cosines_of_a_block_are_held_a_strip_at_a_time():
    rng = np.random.default_rng(9)
    side = pa.table({"id": np.arange(900), "label": np.arange(900) % 2, "v": pa.array(list(rng.normal(size=(900, 4))))})
    tiles = list(D._tiles(side, side))
    assert max(cos.shape[0] for _, _, _, cos, _ in tiles) <= D.STRIP and sum(other.sum() for *_, other in tiles) == 900 * 899


def test_cells_beyond_the_first_are_met_without_a_shuffle_of_vectors(spark):
    rng = np.random.default_rng(10)
    m = rng.normal(size=(200, 6))
    frame = spark.createDataFrame([(i, i % 3, m[i].tolist()) for i in range(200)], "id long, label long, v array<double>")
    found = N.search(N.build(frame, 20), frame, 3, "other")
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    got = {(r.q, r["rank"]): r.g for r in found.collect()}
    for q in range(200):
        want = sorted((g for g in range(200) if g % 3 != q % 3), key=lambda g: -cos[q, g])[:3]
        assert [got[q, k] for k in (1, 2, 3)] == want


def test_best_rows_are_cut_by_strips_with_ties_by_id():
    g, ids = np.ones((500, 2)), np.arange(500)[::-1].copy()
    zero = np.zeros(300, np.int64)
    r, c, cos = N._best(np.ones((300, 2)), np.arange(1000, 1300), zero, np.full(300, -np.inf), g, ids, np.zeros(500, np.int64), 4, "any")
    assert len(r) == 1200 and (ids[c].reshape(300, 4) == [0, 1, 2, 3]).all()


def test_quantiles_from_sketches_are_exact_beyond_their_size(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 != 0, (F.col("id") % 3).cast("string")).alias("g"), (F.col("id") % 16).alias("bucket"), F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(9_973))).cast("double").alias("x"))
    rows = C.materialise(rows)
    wrong = D.sketches(rows.withColumn("x", F.lit(-1.0)), ["g", "bucket"], "x")  # no bound holds: all values are counted
    for stored in (D.sketches(rows, ["g", "bucket"], "x"), wrong):
        got = {r.g: r for r in D.exact_quantiles(rows, stored, ["g"], "x", [1, 50, 90, 100]).collect()}
        assert sorted(got, key=str) == ["0", "1", "2", None]
        for g, r in got.items():
            values = [v.x for v in rows.where(F.col("g").eqNullSafe(g)).collect()]
            x = sorted(v for v in values if v is not None)
            assert r.n == len(values) > len(x) > D.SKETCH and [r[f"p{p}"] for p in (1, 50, 90, 100)] == [x[(len(x) * p + 99) // 100 - 1] for p in (1, 50, 90, 100)]


def test_text_hashes_stream_and_short_texts_count_as_they_are(spark):
    texts = ["", "A", " A b ", "a B", "A b c", "A b c ", " one two three four", "\x0bX\fy\tz", None, "É é é", "a " * 5000]
    got = [r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.simhash60(F.col("t")).alias("h")).orderBy("i").collect()]
    assert got == [None if t is None else U.similarity_hash(t.lower(), t) for t in texts]
    batches = U._hashes(iter([(pa.array(["a b c d", None]), pa.array([None, None], pa.string()))]))
    assert [b.to_pylist() for b in batches] == [[U.similarity_hash("a b c d", None), None]]


def test_gate_and_members_tell_every_pair_of_copies(spark):
    from tesserae.streaming import pipelines as P

    train = spark.createDataFrame([("a", "a/1", "x"), ("a", "a/2", "x"), ("b", "b/1", "x"), ("b", "b/2", "y"), ("b", "b/3", "z"), ("b", "b/4", None)], "class string, path string, sha256 string")
    rows = spark.createDataFrame([("a", "t/1", "x"), ("b", "t/2", "x"), ("b", "t/3", "y"), ("b", "t/4", "w"), ("b", "t/5", None)], "class string, path string, sha256 string")
    hits = C.materialise(P.leak_gate(rows, train))
    members = P.leak_members(hits, train)
    label = F.when(hits["kind"] == "exact", hits["cls"] == members["train_cls"]).otherwise(hits["cls"] != members["train_cls"])
    got = {(r.test_path, r.path) for r in hits.join(members, (hits["sha256"] == members["sha256"]) & label).select("test_path", members["train_path"].alias("path")).collect()}
    assert got == {(t, p) for t, ps in (("t/1", ("a/1", "a/2", "b/1")), ("t/2", ("a/1", "a/2", "b/1")), ("t/3", ("b/2",))) for p in ps}
    assert members.count() == 4 and hits.agg(F.sum("n_train")).first()[0] == 7


def test_trie_of_places_is_that_of_words():
    from tesserae.llm import op06_lm as g

    rng = np.random.default_rng(12)
    words = np.unique(rng.integers(1, 1 << 40, 80).astype(np.uint64))
    v, u, w = np.unique(rng.integers(0, 60, (3, 500)), axis=1)
    c = rng.integers(1, 9, len(v))
    rest = (c, c + 5, c + 9, np.ones(len(v), bool))
    one, two = g.Trie(v, u, w, *rest, words), g.Trie(words[v], words[u], words[w], *rest)
    assert all((x == y).all() for x, y in zip(one.lookup(words, v, u, w), two.lookup(words, v, u, w), strict=True)) and (one.a3 == two.a3).all() and (one.a2 == two.a2).all()


def test_a_pair_of_blocks_gives_a_bar_once(spark, monkeypatch):
    rng = np.random.default_rng(10)
    side = pa.table({"id": np.arange(900), "label": np.arange(900) % 2, "v": pa.array(list(rng.normal(size=(900, 4))))})
    works = []
    monkeypatch.setattr(D, "_pairs_of_blocks", lambda rows, work, kind, block: works.append(work) or spark.createDataFrame([], kind))
    for bins in (20, 1_000_000):  # more bars than pairs of a strip
        D.cosine_histograms(None, bins)
        found = works[-1](side, side)
        assert sum(found["n"].to_pylist()) == 900 * 899
        if bins == 20:
            keys = list(zip(*(found[c].to_pylist() for c in ("q_label", "g_label", "bin")), strict=True))
            assert len(keys) == len(set(keys)) <= 4 * bins
