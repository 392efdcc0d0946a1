"""Vector analytics: class centroids, neighbours, similarity distributions, hard examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators.neighbours import Index, build, search

BLOCK = 2048


def centroids(vectors: DataFrame) -> DataFrame:
    """(cls, centroid): the mean of the L2-normalised vectors of each label."""
    each = vectors.select("label", F.posexplode(S.l2_normalise(S.doubles(F.col("v")))).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.col("label").alias("cls"), F.transform("s", lambda x: x["m"]).alias("centroid"))


def model_row(model: DataFrame) -> DataFrame:
    """The centroids as one row, sorted by class: a model of classes x dimensions, broadcast to the rows it scores."""
    return model.agg(F.sort_array(F.collect_list(F.struct("cls", "centroid"))).alias("model"))


def class_cosines(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Adds cosines: array of (cls, cos) in class order. Centroids are a dimension: one small row a class, gathered once.

    Vectors of an Arrow batch are normalised and multiplied with all centroids in one matrix product.
    """
    rows = model.orderBy("cls").collect()
    if not rows:
        return vectors.withColumn("cosines", F.expr("cast(null as array<struct<cls:bigint,cos:double>>)")).limit(0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    centres = unit(np.array([r["centroid"] for r in rows], float))

    def cosines(v: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in v:
            m = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, centres.shape[1]))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(centres)), pa.array((unit(m) @ centres.T).ravel()))

    cosines.__annotations__ = {"v": Iterator[pa.Array], "return": Iterator[pa.Array]}
    classes = F.array(*(F.lit(r["cls"]) for r in rows))
    found = F.arrow_udf(cosines, "array<double>")(S.doubles(F.col("v")))
    return vectors.withColumn("cosines", F.zip_with(classes, found, lambda c, x: F.struct(c.alias("cls"), x.alias("cos"))))


def score(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(id, truth, classes, probabilities, pred, confidence, second, second_p, margin)."""
    scored = class_cosines(vectors, model)
    probabilities = S.softmax(F.transform("cosines", lambda c: c["cos"]))
    rows = scored.select("id", F.col("label").alias("truth"), "cosines", F.transform("cosines", lambda c: c["cls"]).alias("classes"), probabilities.alias("probabilities"))
    rows = rows.withColumn("top", F.slice(S.ranked(F.col("probabilities")), 1, 2))
    at = lambda k, f: F.get("top", F.lit(k))[f]
    return rows.select("id", "truth", "cosines", "classes", "probabilities", F.get("classes", at(0, "index")).alias("pred"), at(0, "value").alias("confidence"), F.get("classes", at(1, "index")).alias("second"), at(1, "value").alias("second_p"), (at(0, "value") - at(1, "value")).alias("margin"))


def neighbours(queries: DataFrame, gallery: DataFrame, k: int, scope: str = "any", index: Index | None = None, block: int | None = None) -> DataFrame:
    """(q, rank, g, cos, q_label, g_label): the k nearest gallery rows by cosine, ties by id, never the row itself; exact.

    scope: any, own (same label) or other. Rows are (id, label, v). An index of the gallery can be used again.
    """
    return search(index or build(gallery), queries, k, scope, block=block)


def all_cosines(queries: DataFrame, gallery: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, g, cos, q_label, g_label) of every ordered pair of different rows; for distributions over bounded galleries."""
    blocks = max(1, -(-gallery.count() // block))
    packed = gallery.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("gb")).agg(F.collect_list(F.struct("id", "label", S.doubles(F.col("v")).alias("v"))).alias("rows"))
    dealt = queries.select("id", "label", S.doubles(F.col("v")).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("gb"))
    joined = dealt.hint("shuffle_merge").join(packed, "gb")
    pairs = joined.select(F.col("id").alias("q"), F.col("label").alias("q_label"), "v", F.inline("rows").alias("g", "g_label", "w")).where("q <> g")
    return pairs.select("q", "g", "q_label", "g_label", S.cosine(F.col("v"), F.col("w")).alias("cos"))


def spread(x: Column, percentiles: list[float]) -> list[Column]:
    """Exact percentiles with linear interpolation."""
    return [F.percentile(x, F.lit(p)).alias(f"p{p * 100:g}".replace(".", "_")) for p in percentiles]


def principal_components(vectors: DataFrame, k: int = 3) -> DataFrame:
    """(id, c1..ck, explained_1..k): the covariance is summed in Spark, its eigenvectors are found on the driver (dimensions x dimensions)."""
    rows = vectors.select("id", S.doubles(F.col("v")).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(float)
                part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    sums = rows.mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()["x"].to_numpy()
    d = int((-1 + (4 * len(sums) - 3) ** 0.5) / 2)
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    values, axes = np.linalg.eigh(sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    axes, values = axes[:, ::-1][:, :k], values[::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    coordinate = lambda j: S.dot(F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b), F.array(*map(F.lit, axes[:, j].tolist())))
    return rows.select("id", *(F.round(coordinate(j), 6).alias(f"c{j + 1}") for j in range(k)), *(F.lit(round(float(values[j] / values.sum()), 6)).alias(f"explained_{j + 1}") for j in range(k)))
