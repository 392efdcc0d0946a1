import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators import curation as C


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Healthy ", "healthy"), ("BLACK ROT", "black_rot"), ("__leaf__", "leaf"), ("a  b\tc", "a_b_c"), ("", "")],
)
def test_label_key(spark, raw, want):
    assert one(spark, x=S.label_key(F.lit(raw))).x == want


def test_labels_prefix_and_quarantine(spark):
    rows = spark.createDataFrame([(1, "Crop EN"), (2, "en"), (3, "crop_xx"), (4, None)], "id long, raw string")
    out = {r.id: r.canonical for r in C.normalise_labels(rows, "raw", C.alias_table(spark, {"en": "English"}), "crop").collect()}
    assert out == {1: "English", 2: "English", 3: None, 4: None}


def test_hashes(spark):
    plane = F.array(*(F.lit(float(i)) for i in range(64)))
    r = one(spark, a=S.mean_hash(plane), d=S.gradient_hash(plane, 8), m=S.median_hash(plane))
    assert r.a == sum(1 << i for i in range(32, 63)) - (1 << 63)
    assert r.d == 0
    assert r.m & 1 == 0
    assert one(spark, h=S.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))).h == 64


def test_unknown_hash_is_an_error_and_null_stays_null(spark):
    with pytest.raises(ValueError, match="unknown hash"):
        S.plane_hash("nope", F.lit(None))
    assert one(spark, h=S.plane_hash("mean", F.lit(None).cast("array<double>"))).h is None


def test_vectors(spark):
    r = one(spark, s=S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), g=S.sigmoid(F.lit(-800.0)), z=S.minmax_scale(F.array(F.lit(2.0), F.lit(2.0))), c=S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), e=S.entropy(F.array(F.lit(1.0), F.lit(1.0))))
    assert r.s == [0.5, 0.5] and r.g == 0.0 and r.z == [0.0, 0.0] and r.c is None and math.isclose(r.e, math.log(2))


def test_first_index_wins_ties(spark):
    assert one(spark, r=F.get(S.ranked(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))), F.lit(0))["index"]).r == 0


def test_undefined_is_null(spark):
    r = one(spark, d=S.safe_div(F.lit(1.0), F.lit(0.0)), t=S.format_value(F.lit(0.5)))
    assert r.d is None and r.t == "0.5000"
