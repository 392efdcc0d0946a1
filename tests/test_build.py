"""The build in both modes, the gate, skipped classes, hash trees, changed planes and late rows of a stream."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import planes
from tesserae.functions import scalar as S
from tesserae.operators import audit as A
from tesserae.operators import build as B
from tesserae.operators import curation as C
from tesserae.operators import trees as H
from tesserae.streaming import pipelines as P

ALIASES = {"a": "A", "b": "B"}


def rows(spark, n=60, unknown=()):
    data = [(i, "a" if i % 2 else "b", f"p{i}", None if i == 5 else hashlib.sha256(str(i % 50).encode()).hexdigest(), (i % 50) * 0x1357924680ACE % (1 << 60)) for i in range(n)]
    data += [(1000 + i, u, f"u{i}", "x", 0) for i, u in enumerate(unknown)]
    return spark.createDataFrame(data, "id long, label string, path string, sha256 string, h long")


def test_build_in_both_modes(spark):
    aliases = C.alias_table(spark, ALIASES)
    for grouped in (True, False):
        made = B.build_dataset(rows(spark), aliases, "crop", grouped=grouped)
        report = {r.metric: r.value for r in made.report.collect()}
        manifest = made.manifest.collect()
        assert (report["raw"], report["unreadable"], report["unknown"]) == ("60", "1", "0")
        assert int(report["unique"]) == len(manifest) == 50 and int(report["removed"]) == made.duplicates.count() == 9  # 55 is kept, as 5 cannot be read
        assert int(report["train"]) + int(report["test"]) == 50 == sum(int(v) for k, v in report.items() if k.startswith(("train_", "test_")) and k != "test_fraction")
        assert ("warning" in report) == (not grouped) and all((r.group_id is None) != grouped for r in manifest)
        assert len(report["fingerprint"]) == 64
        again = {r.metric: r.value for r in B.build_dataset(rows(spark).repartition(7), aliases, "crop", grouped=grouped).report.collect()}
        assert again == report
        if grouped:
            sides = {}
            for r in manifest:
                assert sides.setdefault((r["class"], r.group_id), r.split) == r.split


def test_unknown_labels_stop_the_build_and_empty_tables_do_not(spark):
    aliases = C.alias_table(spark, ALIASES)
    with pytest.raises(B.UnknownLabels):
        B.build_dataset(rows(spark, 10, ["zzz"]), aliases, "crop")
    made = B.build_dataset(rows(spark, 10, ["zzz"]), aliases, "crop", strict=False)
    assert [r.id for r in made.quarantine.collect()] == [1000] and made.manifest.where("id = 1000").isEmpty()
    assert B.build_dataset(rows(spark).limit(0), aliases, "crop", grouped=False).manifest.count() == 0


def test_gate(spark):
    hits = lambda kinds: A.leak_summary(spark.createDataFrame([(k, 2) for k in kinds], "kind string, n_train long"), 10)
    some, none = (spark.createDataFrame([(n,)], "candidates long") for n in (4, 0))
    found = {r.check: (r.ok, r.detail) for r in A.gate_report(hits(["near", "exact"]), none).collect()}
    assert found == {"blocking_hits": (False, "2"), "near_candidates_checked": (False, "0"), "gate": (False, "closed")}
    assert {r.check: r.ok for r in A.gate_report(hits(["near"]), some).collect()} == {"blocking_hits": True, "near_candidates_checked": True, "gate": True}
    with pytest.raises(A.LeakageError):
        A.gate(hits(["cross_class_exact"]))
    assert A.gate(hits(["exact"]), allow=True).count() == 4


def test_skipped_classes_have_reasons(spark):
    data = [("full", False)] * 5 + [("few", False), ("few", True)] + [("copies", True)] * 2
    frame = spark.createDataFrame(data, "label string, augmented boolean")
    classes = spark.createDataFrame([(c,) for c in ("full", "few", "copies", "absent")], "label string")
    got = {r.label: (r.real, r.existing, r.target, r.generated, r.reason) for r in C.augmentation_report(frame, "label", "augmented", classes).collect()}
    assert got == {"full": (5, 0, 5, 0, "at target"), "few": (1, 1, 5, 3, None), "copies": (0, 2, 5, 0, "no source rows to augment from"), "absent": (0, 0, 5, 0, "no rows")}
    fixed = {r.label: r.generated for r in C.augmentation_report(frame, "label", "augmented", classes, target=6).collect()}
    assert fixed == {"full": 1, "few": 4, "copies": 0, "absent": 0}


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trees_find_what_differs(spark, depth):
    data = [(f"k{i}", None if i % 9 == 0 else f"v|{i % 7}\\") for i in range(300)]
    before = spark.createDataFrame(data, "path string, sha string")
    changed = [(k, "new" if i == 17 else v) for i, (k, v) in enumerate(data) if i != 40] + [("added", None)]
    after = spark.createDataFrame(changed, "path string, sha string").repartition(5)
    got = {(r.path, r.state, r.value_before, r.value_after) for r in H.diff(before, after, "path", "sha", depth).collect()}
    assert got == {("k17", "changed", data[17][1], "new"), ("k40", "removed", data[40][1], None), ("added", "added", None, None)}
    assert H.diff(before, before.repartition(3), "path", "sha", depth).count() == 0
    root = lambda t: t.where("level = 0").first()
    one, two, other = (root(H.tree(t, ["path"], ["sha"], depth)) for t in (before, before.repartition(6), after))
    assert one == two and one.digest != other.digest and one.n == 300
    places = H.differing_leaves(H.tree(before, ["path"], ["sha"], depth), H.tree(after, ["path"], ["sha"], depth), depth)
    assert places.count() <= 3
    assert H.depth_of(64) == 0 and H.depth_of(65) == 1 and H.depth_of(64 * 256 + 1) == 3


def test_planes(spark):
    side = 5
    v = np.random.default_rng(4).normal(size=side * side)
    p = v.reshape(side, side)
    frame = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    run = lambda f: np.array(frame.select(f(F.col("v")).alias("w")).first().w).reshape(side, side)
    assert np.allclose(run(lambda c: planes.flip_sides(c, side)), p[:, ::-1]) and np.allclose(run(lambda c: planes.flip_over(c, side)), p[::-1])
    assert np.allclose(run(lambda c: planes.gain(c, F.lit(0.5))), p / 2) and np.allclose(run(lambda c: planes.contrast(c, F.lit(2.0))), p.mean() + 2 * (p - p.mean()))
    assert np.allclose(run(lambda c: planes.rotate(c, side, F.lit(90.0))), np.rot90(p, -1)) and np.allclose(run(lambda c: planes.rotate(c, side, F.lit(0.0))), p)
    assert np.allclose(run(lambda c: planes.crop(c, side, F.lit(side), F.lit(0), F.lit(0))), p)
    part = run(lambda c: planes.crop(c, side, F.lit(1), F.lit(3), F.lit(2)))
    assert np.allclose(part, p[2, 3])
    w = math.exp(-1 / (2 * 0.7**2))
    padded = np.pad(p, 1, mode="edge")
    rows_ = (w * padded[:, :-2] + padded[:, 1:-1] + w * padded[:, 2:]) / (1 + 2 * w)
    assert np.allclose(run(lambda c: planes.blur(c, side, F.lit(0.7))), (w * rows_[:-2] + rows_[1:-1] + w * rows_[2:]) / (1 + 2 * w))
    a, b = (run(lambda c: planes.augmented(c, side, lambda name: F.lit(int(hashlib.md5((name + salt).encode()).hexdigest()[:8], 16) / 2**32))) for salt in ("x", "x"))  # noqa: B023
    assert np.allclose(a, b) and a.shape == p.shape and S.mean is not None


def test_late_rows_and_forgotten_digests(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [("a", 1, at(10)), ("a", 0, at(12)), ("b", 2, at(20))],
        [("a", 3, at(50)), ("c", 4, at(100))],
        [("d", 5, at(5)), ("b", 6, at(95)), ("e", 7, at(200))],  # d comes after the watermark of 90
        [("a", 8, at(210))],  # the first a has been let go
    ]
    kept = []
    for batch in batches:
        spark.createDataFrame(batch, "sha256 string, id long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with P.rocksdb(spark):
            stream = P.read(spark, f"{tmp_path}/in", "sha256 string, id long, at timestamp")
            P.run_available(P.first_rows(stream, "10 seconds", 100), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        rows_ = {(r.sha256, r.id) for r in spark.read.schema("sha256 string, id long, at timestamp").parquet(f"file://{tmp_path}/out").collect()}
        kept.append(rows_ - set().union(*kept))
    assert kept == [{("a", 1), ("b", 2)}, {("c", 4)}, {("e", 7)}, {("a", 8)}]
