"""Streaming forms of deduplication, the leakage gate and scoring. Sinks are exactly-once file sinks or foreachBatch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesserae.functions import scalar as S
from tesserae.operators.store import materialise

#: Training copies of a digest that one task has at once for an arriving copy.
PAIRS = 256


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup(stream: DataFrame, digest: str, at: str, delay: str) -> DataFrame:
    """The first row of each digest within the watermark; the state is bounded by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([digest])


def leak_gate(stream: DataFrame, train: DataFrame) -> DataFrame:
    """Arriving rows (class, path, sha256) that are copies of training rows: one row for each train class, as in the batch form."""
    known = train.where("sha256 <> ''").groupBy("sha256", F.col("class").alias("train_cls")).agg(F.min("path").alias("train_path"), F.count(F.lit(1)).alias("n_train"))
    kind = F.when(F.col("class") == F.col("train_cls"), "exact").otherwise("cross_class_exact")
    return stream.join(known, "sha256").select(kind.alias("kind"), F.col("class").alias("cls"), F.col("path").alias("test_path"), "train_path", "n_train", "sha256")


def leak_pairs(stream: DataFrame, train: DataFrame, block: int = PAIRS) -> DataFrame:
    """Arriving rows (class, path, sha256) with every training row of their digest: one row a pair of copies.

    Training rows of a digest with more than `block` of them are dealt out over parts, and an arriving copy meets them part by part.
    """
    known = train.where("sha256 <> ''").select("sha256", F.col("class").alias("train_cls"), F.col("path").alias("train_path"))
    counts = known.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = materialise(counts.select("sha256", F.ceil(F.col("n") / block).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = materialise(known.join(hot, "sha256", "left").withColumn("part", F.pmod(F.xxhash64("train_path"), parts)).drop("parts"))
    each = stream.join(hot, "sha256", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    kind = F.when(F.col("class") == F.col("train_cls"), "exact").otherwise("cross_class_exact")
    return each.join(dealt.hint("shuffle_merge"), ["sha256", "part"]).select(kind.alias("kind"), F.col("class").alias("cls"), F.col("path").alias("test_path"), "train_path", "sha256")


def leak_members(hits: DataFrame, train: DataFrame) -> DataFrame:
    """The training rows (train_cls, train_path, sha256) that the written rows of the gate count."""
    known = train.select(F.col("class").alias("train_cls"), F.col("path").alias("train_path"), "sha256")
    return known.hint("shuffle_merge").join(hits.select("sha256").distinct().hint("shuffle_merge"), "sha256", "left_semi").select("train_cls", "train_path", "sha256")


def score(stream: DataFrame, model: list[tuple[int, list[float]]]) -> DataFrame:
    """Rows (id, label, v) against class centroids held as literals: classes x dimensions numbers."""
    cosines = F.array(*(S.cosine(S.doubles(F.col("v")), F.array(*map(F.lit, c))) for _, c in model))
    top = F.get(S.ranked(S.softmax(cosines)), F.lit(0))
    names = F.array(*(F.lit(int(k)).cast("long") for k, _ in model))
    scored = stream.select("id", F.col("label").alias("truth"), top.alias("top"))
    return scored.select("id", "truth", F.get(names, F.col("top.index")).alias("pred"), F.col("top.value").alias("confidence"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop, into Parquet files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same by foreachBatch; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class FirstOfDigest(StatefulProcessor):
    """The first row of each digest, by event time and id; the digest is forgotten once the watermark is `keep` seconds past it."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(((r["at"], r["id"]) for r in rows), default=None)  # one batch's rows of one digest, read one by one
        if first is None or self.seen.exists():
            return
        self.seen.update((first[1],))
        self.handle.registerTimer(int(first[0].replace(tzinfo=timezone.utc).timestamp() + self.keep) * 1000)
        yield Row(sha256=key[0], id=first[1], at=first[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, delay: str, keep: int) -> DataFrame:
    """Of rows (sha256, id, at) the first of each digest. Rows later than the watermark are dropped, and the state holds the
    digests of the last `keep` seconds before it. Needs the RocksDB state store, see `rocksdb`."""
    return stream.withWatermark("at", delay).groupBy("sha256").transformWithState(
        statefulProcessor=FirstOfDigest(keep), outputStructType="sha256 string, id long, at timestamp", outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
