"""Hash trees of manifests: one digest for a table of any size, and a comparison that opens only what differs.

Rows are put under the hex digits of a hash of their key. A leaf holds about `LEAF` rows, so the depth of the tree follows the
rows; a node's digest is that of the sorted digests under it, at most 16 of them. No task sees more than a leaf or 16 nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.store import materialise

LEAF = 64


def depth_of(rows: int) -> int:
    """Digits of a leaf: 16^depth leaves of about LEAF rows."""
    depth = 0
    while rows > LEAF * 16**depth:
        depth += 1
    return depth


def _line(names: list[str]) -> Column:
    """A row's columns as one text: nulls are told from empty texts, and separators in values are marked."""
    safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), safe(c)), F.lit("~")) for c in names))


def _place(key: list[str], depth: int) -> Column:
    return F.substring(F.sha2(_line(key).cast("binary"), 256), 1, depth) if depth else F.lit("")


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n").cast("binary"), 256)


def leaves(rows: DataFrame, key: list[str], columns: list[str], depth: int) -> DataFrame:
    """(place, n, digest): the leaves that hold rows. A row counts with its key and columns."""
    lines = rows.select(_place(key, depth).alias("place"), F.sha2(_line([*key, *columns]).cast("binary"), 256).alias("line"))
    return lines.groupBy("place").agg(F.count(F.lit(1)).alias("n"), _digest(F.col("line")).alias("digest"))


def tree(rows: DataFrame, key: list[str], columns: list[str], depth: int | None = None) -> DataFrame:
    """Written (level, place, n, digest) of all nodes from the leaves up to the root, whose place is ''."""
    depth = depth_of(rows.count()) if depth is None else depth
    level = materialise(leaves(rows, key, columns, depth).select(F.lit(depth).alias("level"), "place", "n", "digest"))
    nodes = level
    for up in range(depth - 1, -1, -1):
        parts = level.groupBy(F.substring("place", 1, up).alias("place") if up else F.lit("").alias("place"))
        level = parts.agg(F.sum("n").alias("n"), _digest(F.concat_ws("|", "place", "digest")).alias("digest")).select(F.lit(up).alias("level"), "place", "n", "digest")
        level = materialise(level)
        nodes = nodes.unionByName(level)
    return nodes


def differing_leaves(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """Written (place) of the leaves in which two written trees of one depth differ; under equal nodes nothing is compared."""
    places = None
    for level in range(depth + 1):
        b, a = (t.where(F.col("level") == level).select("place", F.col("digest").alias(name)) for t, name in ((before, "b"), (after, "a")))
        if places is not None:
            open_ = places.withColumnRenamed("place", "up")
            up = lambda t: t.join(open_, F.substring(t["place"], 1, level - 1) == open_["up"], "left_semi") if level > 1 else t  # noqa: B023, E731
            b, a = up(b), up(a)
        places = materialise(b.join(a, "place", "full").where(~F.col("b").eqNullSafe(F.col("a"))).select("place"))
        if places.isEmpty():
            break
    return places


def diff(before: DataFrame, after: DataFrame, key: str, value: str, depth: int | None = None) -> DataFrame:
    """(key, state, value_before, value_after) of the rows that were changed, added or removed.

    Both trees are built once and can be stored; rows are read again only from the leaves that differ.
    """
    depth = depth_of(max(before.count(), after.count())) if depth is None else depth
    places = differing_leaves(tree(before, [key], [value], depth), tree(after, [key], [value], depth), depth)
    inside = lambda rows, name: rows.select(key, F.col(value).alias(f"value_{name}"), F.lit(True).alias(f"in_{name}"), _place([key], depth).alias("place")).join(places, "place", "left_semi").drop("place")
    state = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").otherwise("changed")
    same = F.col("in_before").isNotNull() & F.col("in_after").isNotNull() & F.col("value_before").eqNullSafe(F.col("value_after"))
    return inside(before, "before").join(inside(after, "after"), key, "full").where(~same).select(key, state.alias("state"), "value_before", "value_after")
