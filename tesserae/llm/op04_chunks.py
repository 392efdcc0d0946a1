"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the top bits of a gear hash of the last 32 bytes are zero, so
chunks follow the content and find their ends again after an insertion. Chunks are
between `MIN_BYTES` and `MAX_BYTES` long and end between characters. Equal chunks
(by 128-bit digest) are repeats of the one in the smallest doc_id, and within a
document of the first one. Neighbouring repeats are joined to spans; spans of at
least `least_bytes` are reported, so that short common phrases stay.

The digests are counted with map-side aggregation; the table of repeated digests
is written out and joined back, where adaptive execution splits a hot digest. No
group is ever gathered.

Defined results: null or empty text: no chunk; a null doc_id is never reported nor
kept; equal texts of one doc_id are one document, different ones are documents of
their own, the smaller text hash first; ties do not arise; no rows: no rows; further columns are ignored (or, in `deduplicate`, kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, runs, table, text_buffer, trim

#: About 2^MASK_BITS bytes beyond the minimum on average.
MASK_BITS, MIN_BYTES, MAX_BYTES = 4, 8, 256
#: Bytes of the shortest reported run of repeats. Up to a chunk is lost at each of its ends.
LEAST_BYTES = 200
#: Bytes of text of a pass, or of a step through a long text.
LIMIT = 1_000_000
_GEAR = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, at: np.ndarray, seen: int = 0, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of concatenated texts.

    Of one text, the first `seen` bytes may be chunked already, and if it is not `whole`, more bytes follow: then chunks
    that these could change are left out.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # 32 silent bytes before each text: its hashes do not see the text before it
    place = np.arange(n) + 32 * np.repeat(np.arange(1, len(at)), np.diff(at))
    h, width = np.zeros(n + 32 * (len(at) - 1), np.uint32), 1
    h[place] = _GEAR[data]
    while width < 32:  # h[i] = sum of gear << age over the last `width` bytes
        older = h[:-width] << np.uint32(width)
        h[width:] += older
        width *= 2
    h = h[place]
    ends_char = np.append((data[1:] & 0xC0) != 0x80, True)
    wish = np.flatnonzero((h >> np.uint32(32 - MASK_BITS) == 0) & ends_char) + 1
    ends: list[int] = []
    starts: list[int] = []
    low = np.searchsorted(wish, at[:-1], "right").tolist()
    wanted, edge = wish.tolist(), at.tolist()
    k, many = 0, len(wanted)
    for d in range(len(edge) - 1):
        here, stop = edge[d] + seen, edge[d + 1]
        k = low[d]
        while here < stop if whole else here + MAX_BYTES < stop:
            while k < many and wanted[k] < here + MIN_BYTES:
                k += 1
            end = min(wanted[k] if k < many else stop, stop)
            if end > here + MAX_BYTES:
                end = here + MAX_BYTES
                while not ends_char[end - 1]:
                    end -= 1
            starts.append(here)
            ends.append(end)
            here = end
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _digested(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def chunked(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, digests, start and end in code points, bytes) of the chunks of some whole texts at a time; a long one is cut in steps."""
    data, at = text_buffer(texts)
    for a, b in runs(at, LIMIT):
        part, edge = data[at[a] : at[b]], at[a : b + 1] - at[a]
        if len(part) <= LIMIT:
            start, end = cuts(part, edge)
            owner = np.searchsorted(edge[1:], start, "right")
            chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
            base = chars[edge[owner]]
            yield a + owner, _digested(part, start, end), chars[start] - base, chars[end] - base, end - start
            continue
        found, here, counted = [], 0, 0
        while here < len(part):
            begin, stop = max(0, here - 31), min(here + LIMIT, len(part))
            window = part[begin:stop]
            start, end = cuts(window, np.array([0, len(window)]), here - begin, stop == len(part))
            chars = np.append(0, np.cumsum((window & 0xC0) != 0x80)) + counted
            chars -= chars[here - begin] - counted
            found.append((_digested(window, start, end), chars[start], chars[end], end - start))
            here, counted = begin + int(end[-1]), int(chars[end[-1]])
        digests, first, last, size = (np.concatenate(x) for x in zip(*found, strict=True))
        yield np.full(len(size), a), digests, first, last, size


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id and version (a hash of the text: rows of one id may differ), the digest (d1, d2), start and end in code points, bytes, and whether the document had the chunk before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, both, start, end, size in chunked(batch.column("text")):
                order = np.lexsort((start, both[:, 1], both[:, 0], owner))
                again = np.zeros(len(start), bool)
                if len(start):
                    o, x, y = owner[order], both[order, 0], both[order, 1]
                    again[order[1:]] = (o[1:] == o[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(owner)) for c in ("doc_id", "version")), pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.array(c.astype(np.int32)) for c in (start, end, size)), pa.array(again)],
                    names=["doc_id", "version", "d1", "d2", "start", "end", "n_bytes", "again"],
                )
            trim()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.withColumn("version", F.hash("text")).mapInArrow(run, "doc_id long, version int, d1 long, d2 long, start int, end int, n_bytes int, again boolean")


def repeated_spans(documents: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, version, start, end, kept_doc_id: the spans that repeat an earlier text, and a document that keeps all chunks of it.

    Neighbouring repeats count together for `least_bytes`, also where other documents keep them; such a run is several rows.
    """
    cut = chunks(documents)
    text = ["doc_id", "version"]
    counted = cut.groupBy("d1", "d2").agg(F.min(F.struct(*text)).alias("kept"), F.count("*").alias("n"))
    known = materialise(counted.where("n > 1").select("d1", "d2", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.version").alias("kept_version")))
    repeats = cut.hint("shuffle_merge").join(known, ["d1", "d2"]).where("again or doc_id > kept_doc_id or (doc_id = kept_doc_id and version > kept_version)")
    repeats = repeats.groupBy(*text, "start", "end").agg(F.min("kept_doc_id").alias("kept_doc_id"), F.max("n_bytes").alias("n_bytes"))
    w = Window.partitionBy(*text).orderBy("start", "end")
    apart = F.coalesce(F.lag("end").over(w), F.lit(-1)) < F.col("start")
    other = apart | (F.lag("kept_doc_id").over(w) != F.col("kept_doc_id"))
    marked = repeats.withColumns({"apart": apart.cast("int"), "other": other.cast("int")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"run": F.sum("apart").over(upto), "span": F.sum("other").over(upto)})
    joined = marked.groupBy(*text, "run", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_bytes").alias("n_bytes"), F.min("kept_doc_id").alias("kept_doc_id"))
    total = F.sum("n_bytes").over(Window.partitionBy(*text, "run"))
    return joined.withColumn("total", total).where(F.col("total") >= least_bytes).select(*text, "start", "end", "kept_doc_id")


def deduplicate(documents: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The documents with their repeated spans cut out of `text`; all other columns stay as they are."""
    spans = materialise(repeated_spans(documents, least_bytes))
    gone = spans.groupBy(F.col("doc_id").alias("id"), "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    names = [f"c{i}" for i in range(len(documents.columns))]
    text, key = (F.col(names[documents.columns.index(c)]) for c in ("text", "doc_id"))
    step = lambda acc, g: F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, g["start"] - acc["at"])).alias("kept"), g["end"].alias("at"))
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate("gone", zero, step, lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    joined = documents.toDF(*names).hint("shuffle_merge").join(gone.hint("shuffle_merge"), (key.cast("long") == F.col("id")) & (F.hash(text.cast("string")) == F.col("version")), "left")
    out = F.when(F.col("gone").isNull(), text).otherwise(cut)
    return joined.select(*(out.alias(n) if c == "text" else F.col(n) for n, c in zip(names, documents.columns, strict=True))).toDF(*documents.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"), "kept_doc_id")
