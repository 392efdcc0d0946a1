"""Ranks, running sums and quotas without one task a group.

A window over a group runs in one task, whatever the size of the group. Here rows are dealt out by ranges of (group, order),
so that a large group lies in many tasks; each task adds up its own rows, the sums of the tasks before it are added as offsets
(a table of at most one row for each group and range), and a window never spans more than a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators.store import materialise


def _same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equal keys, nulls included: left column to right column."""
    out = F.lit(True)
    for a, b in keys.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def running(rows: DataFrame, by: list[str], order: list[str | Column], sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds below_<c>, the sum of c over the rows of the group that come before, and all_<c>, its sum over the group.

    Rows with equal order need another column in `order` to have a place of their own; they stay in one task. Null is a group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    pieces = placed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_sum_{c}") for c in sums))
    group = Window.partitionBy(*by)  # at most `parts` rows
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *(F.col(c).alias(f"_of_{c}") for c in by), F.col("_range").alias("_of_range"),
        *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(f"_sum_{c}").over(group).alias(f"all_{c}") for c in sums),
    )
    offsets = materialise(offsets)
    joined = placed.join(offsets, _same(placed, offsets, {**{c: f"_of_{c}" for c in by}, "_range": "_of_range"}))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*(joined[c] for c in rows.columns), *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{c}")).alias(f"below_{c}") for c in sums), *(f"all_{c}" for c in sums))


def ranked(rows: DataFrame, by: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """Adds `rank`, from 1, in the group and `size`, the rows of the group."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"], parts)
    return out.withColumns({"rank": F.col("below__one") + 1, "size": F.col("all__one")}).drop("_one", "below__one", "all__one")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the rank of a value in its group as `name`; equal values share the mean of their places."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    places = running(counts, by, [value], ["_n"], parts)
    places = materialise(places.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, value]), (F.col("below__n") + (F.col("_n") + 1) / 2).alias(name)))
    return rows.join(places, _same(rows, places, {c: f"_of_{c}" for c in [*by, value]})).select(*(rows[c] for c in rows.columns), name)


def first_by_hash(rows: DataFrame, label: str, key: str, quota: Callable[[Column], Column], seed: int = 42, digits: int = 4) -> DataFrame:
    """Adds `_first`: whether a row is among the first quota(n) of the n rows of its label by keyed hash.

    No row moves: a histogram of the leading hash digits (16^digits rows a label at most) finds the digits in which the quota
    ends, the rows of those digits alone are ranked, and the last one that counts is the label's bound. Rows of one key stay
    together. Null is a label.
    """
    place = F.struct(S.hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    slim = rows.select(F.col(label).alias("_label"), place.alias("_place"))
    digit = F.substring(F.col("_place.h"), 1, digits)
    counts = slim.groupBy("_label", digit.alias("_digits")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("_label")
    below = F.coalesce(F.sum("n").over(of.orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.select(F.col("_label").alias("_l"), F.col("_digits").alias("_d"), "n", below.alias("below"), quota(F.sum("n").over(of)).alias("quota"))
    ends = materialise(ends.where((F.col("below") < F.col("quota")) & (F.col("quota") <= F.col("below") + F.col("n"))))  # one row a label
    edge = slim.withColumn("_digits", digit)
    edge = edge.join(ends, edge["_label"].eqNullSafe(ends["_l"]) & (edge["_digits"] == ends["_d"]))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_place"))
    bounds = edge.select("_label", "_place", (F.col("quota") - F.col("below")).alias("rest"), rank.alias("rank")).where(F.col("rank") <= F.col("rest"))
    bounds = materialise(bounds.groupBy(F.col("_label").alias("_l")).agg(F.max("_place").alias("_last")))
    joined = rows.join(bounds, rows[label].eqNullSafe(bounds["_l"]), "left")
    return joined.select(*(rows[c] for c in rows.columns), F.coalesce(place <= F.col("_last"), F.lit(False)).alias("_first"))
