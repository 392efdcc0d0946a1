"""Ranks, quotas, the neighbour index, sketches and draws against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import curation as C
from tesserae.operators import distributions as D
from tesserae.operators import evaluation as E
from tesserae.operators import neighbours as N
from tesserae.operators import ranks as R


def test_running_sums_and_ranks_cross_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, k int, id int, x int")
    got = {r.id: r for r in R.running(frame, ["g"], [F.desc("k"), "id"], ["x"], parts=7).collect()}
    ranks = {r.id: (r.rank, r["size"]) for r in R.ranked(frame, ["g"], [F.desc("k"), "id"], parts=7).collect()}
    for g in ("a", "b", None):
        total = 0
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for place, r in enumerate(mine, 1):
            assert (got[r[2]].below_x, got[r[2]].all_x) == (total, sum(m[3] for m in mine)) and ranks[r[2]] == (place, len(mine))
            total += r[3]
    averages = {r.id: r.avg for r in R.average_ranks(frame, ["g"], "k", "avg", parts=5).collect()}
    for g, k, i, _ in rows:
        mine = [r[1] for r in rows if r[0] == g]
        assert averages[i] == sum(v < k for v in mine) + (mine.count(k) + 1) / 2


@pytest.mark.parametrize("digits", [1, 4])
def test_quota_by_hash(spark, digits):
    rows = [(g, i) for g, n in (("a", 300), ("b", 7), ("c", 1), (None, 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, id int").repartition(5)
    marked = R.first_by_hash(frame, "g", "id", lambda n: F.floor(n * 0.3).cast("long"), seed=9, digits=digits)
    import hashlib

    h = lambda i: (hashlib.sha256(f"9|{i}".encode()).hexdigest(), i)
    want = {(g, i) for g in ("a", "b", "c", None) for i in sorted((r[1] for r in rows if r[0] == g), key=h)[: int(sum(r[0] == g for r in rows) * 0.3)]}
    assert {(r.g, r.id) for r in marked.where("_first").collect()} == want and marked.count() == len(rows)
    assert R.first_by_hash(frame.limit(0), "g", "id", lambda n: n).count() == 0


def greedy(sizes, share):
    """The walk over all groups, one by one."""
    total = sum(sizes)
    want = max(1, round(total * share)) if len(sizes) > 1 else 0
    a = b = 0
    out = []
    for n in sizes:
        test = want > 0 and a * (total - want) <= b * want
        a, b = (a + n, b) if test else (a, b + n)
        out.append(test)
    return out


def test_grouped_split_is_the_walk(spark):
    rng = random.Random(5)
    rows = [("x", i, rng.choice([1, 1, 1, 1, 2, 2, 3, 5, 8, 40])) for i in range(300)] + [("y", 0, 9)] + [("z", i, 4) for i in range(11)] + [("w", 0, 500), ("w", 1, 1), ("w", 2, 1)]
    groups = spark.createDataFrame(rows, "label string, group_id long, n long")
    for share in (0.2, 0.5, 0.9):
        got = {(r.label, r.group_id): r.split for r in C.grouped_split(groups, share).collect()}
        assert len(got) == len(rows)
        import hashlib

        for label in "xyzw":
            mine = sorted((r for r in rows if r[0] == label), key=lambda r: (-r[2], hashlib.sha256(f"42|{label}|{r[1]}".encode()).hexdigest(), r[1]))
            assert [got[label, r[1]] == "test" for r in mine] == greedy([r[2] for r in mine], share), (label, share)


def test_curves_do_not_depend_on_the_number_of_ranges(spark):
    rng = random.Random(6)
    rows = [(c, rng.random() < 0.4, round(rng.random(), 1 + c)) for c in range(3) for _ in range(200)] + [(7, True, 0.5)]
    scores = spark.createDataFrame(rows, "cls int, positive boolean, score double")
    got = {r.cls: r.auc for r in E.auc_one_vs_rest(scores).collect()}
    for c in range(3):
        pos, neg = ([s for k, p, s in rows if k == c and p is side] for side in (True, False))
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert abs(got[c] - wins / (len(pos) * len(neg))) < 1e-12
    assert got[7] is None
    curve = defaultdict(list)
    for r in E.roc_curve(scores).collect():
        curve[r.cls].append((r.threshold, r.fpr, r.tpr))
    for c in range(3):
        pos, neg = ([s for k, p, s in rows if k == c and p is side] for side in (True, False))
        assert sorted(curve[c]) == sorted((t, sum(n >= t for n in neg) / len(neg), sum(p >= t for p in pos) / len(pos)) for t in {*pos, *neg})


def exact_nearest(ids, labels, m, k, scope):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    out = {}
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and (scope == "any" or (labels[a] == labels[b]) == (scope == "own"))), key=lambda b: (-round(cos[a, b], 12), ids[b]))
        out[ids[a]] = [ids[b] for b in order[:k]]
    return out


@pytest.mark.parametrize("scope", ["any", "own", "other"])
def test_index_is_exact_with_the_certain_bound(spark, scope, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)  # cells are dealt out as blocks
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    m = np.concatenate([centres[i % 6] + rng.normal(scale=0.2 if i % 2 else 1.5, size=12) for i in range(300)]).reshape(300, 12)
    m[10:150] = m[10]  # a hot cell of copies
    ids, labels = list(range(300)), [i % 4 for i in range(300)]
    frame = spark.createDataFrame([(i, labels[i], m[i].tolist()) for i in ids], "id long, label long, v array<double>")
    want = exact_nearest(ids, labels, m, 5, scope)
    for cells in (1, 15):
        index = N.build(frame, cells)
        got = defaultdict(list)
        for r in N.search(index, frame, 5, scope).orderBy("q", "rank").collect():
            got[r.q].append(r.g)
        alike = lambda q, g: round(float(m[q] @ m[g] / np.linalg.norm(m[q]) / np.linalg.norm(m[g])), 9)
        assert all([alike(q, g) for g in got[q]] == [alike(q, g) for g in want[q]] for q in ids)


def test_index_recall_and_share_of_cells(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    index = N.build(vectors, 22)
    exact = {(r.q, r.g) for r in N.search(index, vectors, 10).collect()}
    near = {(r.q, r.g) for r in N.search(index, vectors, 10, spread=0.35).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert index.cells.counts.sum() == vectors.count()
    some = np.stack(vectors.limit(100).toPandas()["v"]).astype(float)
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    loose, tight = index.cells.bounds(some, 1.0), index.cells.bounds(some, 0.35)
    assert (tight <= loose + 1e-9).all() and (tight < 0.5).mean() > (loose < 0.5).mean()
    assert N.search(N.build(vectors.limit(0)), vectors, 3).count() == 0 and N.search(index, vectors.limit(0), 3).count() == 0


def test_sketches_stay_within_their_bound(spark):
    rows = spark.range(120_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 16).alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"))
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    for r in D.quantiles(D.merged(D.sketches(rows, ["g", "bucket"], "x"), ["g"]), ["g"], shares).collect():
        values = np.sort([v.x for v in rows.where(F.col("g") == r.g).collect()])
        assert r.n == len(values)
        assert all(abs(np.searchsorted(values, r[name]) / len(values) - p) <= 2.3 / D.SKETCH for name, p in shares.items())


def test_histograms_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(90, 8))
    frame = spark.createDataFrame([(i, i % 3, m[i].tolist()) for i in range(90)], "id long, label long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    found = D.cosine_histograms(frame, bins=200, block=16)
    for r in D.histogram_summary(found, ["q_label", "g_label"], [0.1, 0.5, 0.9], bins=200).collect():
        x = np.sort([cos[a, b] for a in range(90) for b in range(90) if a != b and a % 3 == r.q_label and b % 3 == r.g_label])
        assert r.n == len(x) and np.allclose([r["mean"], r.sd, r.min, r.max], [x.mean(), x.std(), x.min(), x.max()])
        assert all(abs(r[f"p{p}"] - x[int(np.ceil(len(x) * p / 100)) - 1]) <= 1 / 200 + 1e-12 for p in (10, 50, 90))


def test_draws_have_their_size_and_distribution(spark):
    counts = np.array([40, 0, 25, 100, 7])
    shares = [D.drawn_sizes(counts, 30, 4000, 3, part) for part in range(5)]
    assert (sum(shares) == 30).all() and all((s <= c).all() for s, c in zip(shares, counts, strict=True))
    assert np.allclose([s.mean() for s in shares], 30 * counts / counts.sum(), atol=0.25)
    x = np.arange(50, dtype=float)
    sums = D.subset_sums(x, np.array([0, 1, 50, 49, *[20] * 3000]), np.random.default_rng(1), step=500)
    assert sums[0] == 0 and sums[1] in x and sums[2] == x.sum() and x.sum() - sums[3] in x
    assert abs(sums[4:].mean() - 20 * x.mean()) < 4 * np.sqrt(20 * x.var() * 30 / 49 / 3000)
    assert abs(sums[4:].var() / (20 * x.var() * 30 / 49) - 1) < 0.15
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 400).astype(float)
    values[:25] += 70
    frame = spark.createDataFrame([(i, float(v), i < 25) for i, v in enumerate(values)], "key long, x double, own boolean")
    row = D.permutation_p(frame, F.col("own"), 20_000).first()
    plain = np.mean([rng.permutation(values)[:25].sum() >= values[:25].sum() for _ in range(20_000)])
    assert row.n == 25 and row.observed == values[:25].mean() and abs(row.p_value - plain) < 6 * np.sqrt(max(plain, 1e-3) / 20_000)
    assert D.permutation_p(frame, F.lit(False), 10).collect() == []
