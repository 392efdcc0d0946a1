"""Reading class trees and manifests, and writing manifests. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "split string, class string, filename string, sha256 string"


def list_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path and length of the files below a folder with one of the extensions (any case); contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return with_extension(listed, "path", extensions)


def with_extension(rows: DataFrame, path: str, extensions: list[str]) -> DataFrame:
    return rows.withColumn("extension", F.lower(F.regexp_extract(path, r"\.[^.]+$", 0))).where(F.col("extension").isin([e.lower() for e in extensions]))


def collect_sources(trees: dict[str, DataFrame], pools: dict[str, DataFrame]) -> DataFrame:
    """Trees with their own labels, and flat pools whose rows all get the pool's name as label."""
    if not trees and not pools:
        raise ValueError("no source")
    parts = [*trees.values(), *(p.withColumns({"label": F.lit(n), "source_group": F.lit("pool")}) for n, p in pools.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_tree(rows: DataFrame, path: str) -> DataFrame:
    """split, class and filename from the last three parts of a path."""
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)$", k)
    return rows.select(path, part(1).alias("split"), part(2).alias("class"), part(3).alias("filename"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV sorted by split, class and filename."""
    rows.select("split", "class", "filename", "sha256").orderBy("split", "class", "filename").write.mode("overwrite").csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").csv(path, header=True)
