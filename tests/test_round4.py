"""Queries take every row of their table."""

import numpy as np

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"


def cosines(spark):
    """Ids, labels and the cosines of all pairs of different rows."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels, m = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -np.inf)
    return ids, labels, cos


def test_nearest_rows_of_every_row(spark):
    ids, _, cos = cosines(spark)
    got = {(r.q, r["rank"]): r.g for r in registry.QUERIES["knn_topk"](spark, SF).collect()}
    want = {(int(q), k + 1): int(g) for q, line in zip(ids, cos, strict=True) for k, g in enumerate(ids[np.lexsort((ids, -line))[:20]])}
    assert got == want and len(got) == 20 * len(ids)


def test_regions_of_every_row(spark):
    ids, labels, cos = cosines(spark)
    order = [np.lexsort((ids, -line))[:20] for line in cos]
    want = {}
    for q, near in zip(ids, order, strict=True):
        for g in near:
            key = int(q), int(labels[order[g][0]])
            want[key] = want.get(key, 0) + 1
    got = {(r.q, r.near_label): r.n for r in registry.QUERIES["region_occupancy"](spark, SF).collect()}
    assert got == want and sum(got.values()) == 20 * len(ids)


def test_stream_gate_gives_every_pair_of_copies(spark, tmp_path):
    from tesserae.plans.base import split_samples

    texts = [(i, "common" if i % 2 else f"text {i // 6}", "en", None if i % 31 == 5 else f"s{i % 3}", 6) for i in range(900)]  # 450 copies of one text, in three sources
    spark.createDataFrame([*texts, (900, None, "en", "s0", None)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    train = split_samples(spark, str(tmp_path)).where("split = 'train'").select("class", "path", "sha256").collect()
    rows = split_samples(spark, str(tmp_path)).where("sample_id % 5 = 0").select("class", "path", "sha256").collect()
    pairs = lambda found: sorted(found, key=str)
    want = [("exact" if t["class"] is not None and t["class"] == r["class"] else "cross_class_exact", t["class"], t.path, r.path, t.sha256) for t in rows for r in train if t.sha256 is not None and t.sha256 == r.sha256]
    got = registry.QUERIES["stream_leak_gate"](spark, str(tmp_path))
    assert got.columns == ["kind", "cls", "test_path", "train_path", "sha256"]
    assert pairs(map(tuple, got.collect())) == pairs(want) and len(want) > 30_000


def test_pairs_of_a_digest_are_dealt_out(spark):
    from tesserae.streaming import pipelines as P

    train = spark.createDataFrame([("a", f"a/{i}", "x" if i < 90 else f"y{i}") for i in range(100)], "class string, path string, sha256 string")
    rows = spark.createDataFrame([("b", "t/1", "x"), ("a", "t/2", "x"), ("a", "t/3", "y95"), ("a", "t/4", "z"), ("a", "t/5", None)], "class string, path string, sha256 string")
    for block in (7, 89, 90, 1000):
        found = P.leak_pairs(rows, train, block)
        got = sorted((r.kind, r.test_path, r.train_path) for r in found.collect())
        assert got == sorted([("cross_class_exact", "t/1", f"a/{i}") for i in range(90)] + [("exact", "t/2", f"a/{i}") for i in range(90)] + [("exact", "t/3", "a/95")])
