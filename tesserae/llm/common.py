"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task code travels with the job, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules["tesserae"])

#: Bytes of text that one numpy pass works on; a longer text is cut into pieces of about this size.
PASS_BYTES = 1_000_000
#: Where a piece may end early, at a better place.
_BACKWARDS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins a true size.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tesserae/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, key: str, most: int = 5_000) -> DataFrame:
    """Inner join of two written frames on a key; a key of more than `most` left rows is dealt over several tasks."""
    most = max(most, left.count() // 50_000)  # so at most 50,000 keys are broadcast
    heavy = materialise(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    copied = right.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.hint("shuffle_merge").join(copied.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus == remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) without copying, and its n + 1 offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        _, at = text_buffer(batch.column(column))
        for start, stop in runs(at, limit):
            yield batch.slice(start, stop - start)
        trim()


def runs(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes, or of one row."""
    start, rows = 0, len(at) - 1
    while start < rows:
        stop = min(rows, max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1))
        yield start, stop
        start = stop


def pieces(texts: pa.Array, inside: np.ndarray, overlap: int = 0, prefer: np.ndarray | None = None, limit: int = PASS_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, int, bool]]:
    """(texts, their rows, words before, whether the last text ends here): all texts in passes of about `limit` bytes.

    A longer text comes in pieces that end between words (runs of the bytes in the table `inside`), where possible after
    a byte of the table `prefer`; each further piece begins with the last `overlap` words of the one before.
    """
    data, at = text_buffer(texts)
    for start, stop in runs(at, limit):
        if at[stop] - at[start] <= limit:
            yield texts.slice(start, stop - start), np.arange(start, stop), 0, True
            continue
        begin, words = int(at[start]), 0
        end_of_text = _last_word(data, inside, begin, int(at[stop]))
        if end_of_text == begin:
            yield pa.array([""]), np.array([start]), 0, True
        while begin < end_of_text:
            size = limit
            while True:
                end = min(begin + size, end_of_text)
                if end < end_of_text:
                    end = _border(data, inside, prefer, begin, end, end_of_text)
                first = spans(inside[data[begin:end]], np.array([0, end - begin]))[0] if end < end_of_text else ()
                if end == end_of_text or len(first) > overlap:
                    break
                size += limit
            piece = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - begin], np.int32)), pa.py_buffer(data[begin:end]))
            yield piece, np.array([start]), words, end == end_of_text
            if end == end_of_text:
                break
            words += len(first) - overlap
            begin = begin + int(first[-overlap]) if overlap else end


def _last_word(data: np.ndarray, inside: np.ndarray, begin: int, end: int) -> int:
    """The end of the last word of a text; its begin where it has none."""
    while end > begin:
        here = np.flatnonzero(inside[data[max(begin, end - _BACKWARDS) : end]])
        if len(here):
            return max(begin, end - _BACKWARDS) + int(here[-1]) + 1
        end = max(begin, end - _BACKWARDS)
    return begin


def _border(data: np.ndarray, inside: np.ndarray, prefer: np.ndarray | None, begin: int, end: int, most: int) -> int:
    """An end of a piece near `end`."""
    if prefer is not None:
        low = max(begin, end - _BACKWARDS)
        good = np.flatnonzero(prefer[data[low:end]])
        if len(good):
            return low + int(good[-1]) + 1
    while end < most:
        out = np.flatnonzero(~inside[data[end : end + _BACKWARDS]])
        if len(out):
            return min(most, end + int(out[0]))
        end += _BACKWARDS
    return most


def trim() -> None:
    """Give unused memory of a reused worker back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_text(run: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function of texts: `run` maps a batch of texts (nulls: empty) to as many values; all else of a row stays with Spark."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield run(pc.fill_null(text, ""))
            trim()

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, kind)


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, which also end where a text ends."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def with_columns(batch: pa.RecordBatch, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII blank bytes: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 16


def _powers(factor: int) -> np.ndarray:
    steps = np.full(_STEP + 1, factor, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE), _powers(_BACK)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of many byte spans (starts and ends rising) from a polynomial prefix sum, a step of bytes at a time."""
    out, opened = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    carry, top, bottom, mask = 0, 1, 1, (1 << 64) - 1
    with np.errstate(over="ignore"):
        for low in range(0, len(data), _STEP):
            here = data[low : low + _STEP]
            total = np.zeros(len(here) + 1, np.uint64)
            np.cumsum(_BYTE[here] * _UP[: len(here)], out=total[1:])
            total = total * np.uint64(top) + np.uint64(carry)
            a, b = np.searchsorted(start, (low, low + len(here)))
            opened[a:b] = total[start[a:b] - low]
            out[a:b] = _DOWN[start[a:b] - low] * np.uint64(bottom)
            a, b = np.searchsorted(end, (low, low + len(here)), "right")  # a span that ends with the step is closed here
            out[a:b] *= total[end[a:b] - low] - opened[a:b]
            carry = int(total[-1])
            top, bottom = top * pow(_BASE, _STEP, 1 << 64) & mask, bottom * pow(_BACK, _STEP, 1 << 64) & mask
        return mix64(out + (end - start).astype(np.uint64))
