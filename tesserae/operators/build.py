"""The dataset build: labels, quarantine, dedup, near-duplicate groups, split, manifest, audit and report, in both modes."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tesserae.operators import curation as C
from tesserae.operators.store import materialise
from tesserae.operators.trees import tree

UNGROUPED = "near copies were not grouped: they can lie on both sides of the split"


def written_with(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written rows, and aggregates that were observed while they were written: no second pass."""
    seen = Observation()
    out = materialise(rows.observe(seen, *(m.alias(name) for name, m in metrics.items())))
    try:
        counts = seen.get
    except Py4JJavaError:  # of a plan that is known to be empty nothing is observed
        counts = out.agg(*(m.alias(name) for name, m in metrics.items())).first().asDict()
    return out, {name: counts[name] or 0 for name in metrics}


@dataclass(frozen=True)
class Build:
    """manifest (split, class, id, sha256, group_id or null), duplicates (removed rows with what was kept), quarantine
    (rows of unknown label), report (metric, value)."""

    manifest: DataFrame
    duplicates: DataFrame
    quarantine: DataFrame
    report: DataFrame


class UnknownLabels(ValueError):
    """Rows have labels that no alias maps to a class."""


def build_dataset(rows: DataFrame, aliases: DataFrame, prefix: str, test: float = 0.2, seed: int = 42, grouped: bool = True, threshold: int = 6, strict: bool = True) -> Build:
    """Build a dataset from rows (id, label, path, sha256, h).

    Unknown labels stop the build, or with strict=False go to quarantine. Unreadable rows (null sha256) are counted and left
    out. Of equal digests the first id stays. Groups of near copies go to one side as a whole; ungrouped, each class is split
    row by row, and the report says what that means.
    """
    named = C.normalise_labels(rows, "label", aliases, prefix)
    unknown = F.col("canonical").isNull()
    bad = ~unknown & F.col("sha256").isNull()
    named, seen = written_with(named, raw=F.count(F.lit(1)), unknown=F.count_if(unknown), unreadable=F.count_if(bad))
    if strict and seen["unknown"]:
        raise UnknownLabels(f"{seen['unknown']} rows have unknown labels")
    readable = named.where(~unknown & F.col("sha256").isNotNull()).select("id", F.col("canonical").alias("class"), "path", "sha256", "h")
    duplicates, removed = written_with(C.dedup_audit(readable, "sha256", ["id"], "path", "class"), removed=F.count(F.lit(1)), cross_class_removed=F.count_if("cross_class"))
    kept, unique = written_with(C.dedup_first(readable, "sha256", ["id"]), unique=F.count(F.lit(1)))
    facts: dict[str, object] = {"mode": "grouped" if grouped else "ungrouped", "test_fraction": test, "seed": seed, **seen, **removed, **unique}
    if grouped:
        groups = materialise(C.near_groups(kept.select("id", F.col("class").alias("label"), "h"), threshold))
        sizes, numbers = written_with(groups.groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n")), groups=F.count(F.lit(1)), rows_in_groups=F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)))
        facts |= {"threshold": threshold, **numbers}
        sides = materialise(C.grouped_split(sizes, test, seed))
        grouping = groups.hint("shuffle_merge").join(sides, ["label", "group_id"]).select("id", "group_id", "split")
        split = kept.hint("shuffle_merge").join(grouping.hint("shuffle_merge"), "id")
    else:
        split = C.stratified_split(kept, "class", "id", test, seed).withColumn("group_id", F.lit(None).cast("long"))
    manifest, sums = written_with(split.select("split", "class", "id", "sha256", "group_id"), train=F.count_if(F.col("split") == "train"), test=F.count_if(F.col("split") == "test"))
    facts |= sums
    facts["fingerprint"] = tree(manifest, ["id"], ["split", "class", "sha256"]).where("level = 0").agg(F.max("digest")).first()[0]  # one digest
    if not grouped:
        facts["warning"] = UNGROUPED
    lines = rows.sparkSession.createDataFrame([(k, str(v)) for k, v in facts.items() if v is not None], "metric string, value string")
    per_class = manifest.groupBy("class", "split").count().select(F.concat("split", F.lit("_"), "class").alias("metric"), F.col("count").cast("string").alias("value"))
    return Build(manifest, duplicates, named.where(unknown), lines.unionByName(per_class))
