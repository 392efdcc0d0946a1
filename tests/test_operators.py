import pytest
from pyspark.sql import functions as F

from tesserae.operators import audit as A
from tesserae.operators import curation as C
from tesserae.operators import evaluation as E
from tesserae.operators import features as V
from tesserae.sources import files


def test_dedup_keeps_the_first_and_audits_the_rest(spark):
    rows = spark.createDataFrame([(2, "x", "b", "p2"), (1, "x", "a", "p1"), (3, "y", "a", "p3")], "id long, sha string, cls string, path string")
    assert {r.id for r in C.dedup_first(rows, "sha", ["id"]).collect()} == {1, 3}
    audit = C.dedup_audit(rows, "sha", ["id"], "path", "cls").collect()
    assert [(r.kept_path, r.removed_path, r.cross_class) for r in audit] == [("p1", "p2", True)]


def test_pairs_find_every_pair_within_the_threshold(spark):
    import random

    rnd = random.Random(3)
    base = [rnd.getrandbits(60) for _ in range(30)]
    hashes = base + [b ^ sum(1 << i for i in rnd.sample(range(60), rnd.randint(0, 8))) for b in base]
    rows = spark.createDataFrame([(i, "a", h) for i, h in enumerate(hashes)], "id long, label string, h long")
    got = {(r.l, r.r) for r in C.near_pairs(rows, 6).collect()}
    first = {h: i for i, h in reversed(list(enumerate(hashes)))}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 0 < (hashes[i] ^ hashes[j]).bit_count() <= 6 and first[hashes[i]] == i and first[hashes[j]] == j}
    assert got == want
    assert {(r.id, r.class_id) for r in C.near_members(rows).collect()} == {(i, first[h]) for i, h in enumerate(hashes)}
    for agree in (3, 4):
        one = C.hash_classes(rows)
        assert {(r.l, r.r) for r in C.hash_pairs(one, one, 6, 60, agree).where("l < r").collect()} == want


def test_groups_are_components_and_null_hashes_share_minus_one(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 0b111), (3, "a", 0b111111111), (4, "a", (1 << 59) - 1), (5, "a", None), (6, "b", 0)], "id long, label string, h long")
    got = {r.id: r.group_id for r in C.near_groups(rows, 6).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] == 1 and got[5] == -1 and got[6] == 0


def test_split_quotas(spark):
    rows = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(11)], "id long, label string")
    out = C.stratified_split(rows, "label", "id", 0.2)
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 2, ("a", "train"): 8, ("b", "train"): 1}
    again = C.stratified_split(rows.repartition(7), "label", "id", 0.2)
    assert set(out.collect()) == set(again.collect())


def test_grouped_split_moves_whole_groups_and_meets_the_share(spark):
    sizes = spark.createDataFrame([("a", i, n) for i, n in enumerate([30, 20, 10, 10, 10, 5, 5, 5, 5])], "label string, group_id long, n long")
    out = C.grouped_split(sizes, 0.2).join(sizes, ["label", "group_id"])
    test = out.where("split = 'test'").agg(F.sum("n")).first()[0]
    assert out.count() == 9 and 10 <= test <= 35


def test_fingerprints_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)], "c string, sha string")
    for f in (C.manifest_fingerprint, C.merkle_fingerprint):
        assert f(rows, ["c", "sha"]).first() == f(rows.repartition(5).orderBy(F.desc("sha")), ["c", "sha"]).first()


def sides(spark):
    kind = "class string, path string, filename string, sha256 string, h long"
    train = spark.createDataFrame([("a", "t1", "f1", "x", 0), ("b", "t2", "f2", "y", 1 << 40), ("a", "t3", "f3", "", 7)], kind)
    test = spark.createDataFrame([("a", "q1", "g1", "x", 0), ("a", "q2", "g2", "y", 5), ("a", "q3", "f3", "z", 0b111), ("a", "q4", "g4", "", (1 << 58) - 1)], kind)
    return test, train


def test_planted_leaks(spark):
    test, train = sides(spark)
    assert {(r.kind, r.test_path) for r in A.exact_leaks(test, train).collect()} == {("exact", "q1"), ("cross_class_exact", "q2")}
    assert [(r.test_path, r.train_path) for r in A.filename_leaks(test, train).collect()] == [("q3", "t3")]
    assert {(r.test_path, r.train_path, r.distance) for r in A.near_leaks(test, train).collect()} == {("q3", "t3", 0)}
    with pytest.raises(A.LeakageError):
        A.gate(A.leak_summary(A.exact_leaks(test, train), 4))


def test_integrity_states(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, v string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "k string, v string")
    assert {r.k: r.state for r in A.integrity_diff(before, after, "k", "v").collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "added"}


def test_metrics_nulls(spark):
    classes = spark.createDataFrame([(c,) for c in range(3)], "cls long")
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "truth long, pred long")
    cm = E.confusion_matrix(rows, classes)
    assert cm.count() == 9
    loose, strict = ({r.cls: r for r in E.per_class(cm, s).collect()} for s in (False, True))
    assert loose[2].precision is None and loose[2].recall is None and loose[2].f1 is None
    assert loose[0].precision == 0.5 and loose[1].precision == 0.0
    never = E.per_class(E.confusion_matrix(rows.where("pred <> 1"), classes), True)
    assert {r.cls: r.precision for r in never.collect()}[1] is None
    assert strict[0].recall == 0.5


def test_auc(spark):
    rows = spark.createDataFrame([(0, True, 0.9), (0, False, 0.9), (0, False, 0.1), (1, True, 0.3)], "cls long, positive boolean, score double")
    assert {r.cls: r.auc for r in E.auc_one_vs_rest(rows).collect()} == {0: 0.75, 1: None}


def test_neighbours_across_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    got = {(r.q, r.rank): r.g for r in V.neighbours(rows, rows, 3, block=16).collect()}
    for i in range(60):
        assert [got[(i, k)] for k in (1, 2, 3)] == np.argsort(-cos[i])[:3].tolist()


def test_files(spark, tmp_path):
    (tmp_path / "train" / "a").mkdir(parents=True)
    (tmp_path / "train" / "a" / "one.TXT").write_text("x")
    (tmp_path / "train" / "a" / "two.bin").write_text("x")
    assert files.list_files(spark, str(tmp_path), [".txt"]).count() == 1
    with pytest.raises(ValueError):
        files.collect_sources({}, {})


def test_early_stop(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.6), (4, 0.1), (5, 0.2)], "epoch long, acc double")
    out = {r.epoch: r for r in A.running_best(history, "epoch", "acc", 2).collect()}
    assert [out[e].improved for e in range(1, 6)] == [True, False, True, False, False]
    assert [out[e].stale for e in range(1, 6)] == [0, 1, 0, 1, 2] and out[1].stop_epoch == 5
