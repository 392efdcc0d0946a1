"""Filter interaction audit: what each of five filters removes, in all 120 orders, with duplicates found by radix tries.

Filters A to D are column functions. For E, the copies, texts are partitioned by
adaptive prefixes: a prefix is the range of all texts that begin with it, and a range
of more than `RANGE_BYTES` bytes (less where a task's share is less) is split by the next longer prefixes, until it is
small or one text alone. One pass adds up the bytes of all prefixes of 8, 128,
2,048 ... characters; only the hashes of the prefixes that must be split are gathered
(at most `MOST_RANGES` for each length, as the size of a range grows with the input
beyond that) and broadcast.

Whole texts are inserted into compressed tries: an edge is a slice of a stored text, a
terminal holds the least id of its text, and a second traversal tells each row
whether a smaller id has its text. Tries are built three times, each from what is left:

1. over each 32 MB that a task reads, so that of the copies in a task one goes on;
2. for each range; a range that is one very frequent text is dealt out by id first;
3. only where such texts were dealt out, over the few rows of each part.

A row that has a smaller copy needs no text from there on. Flags become 5-bit masks,
which are counted by language, mask and labels; orders are worked out on these counts
alone (at most 128 a language), so the work on documents does not depend on them.

Defined results: null text: empty; null lang: part ''; null doc_id: greater than all
others; a row is no copy of a row with its own doc_id; several labels of a document:
1 where any says 1; repeated rows count as often as they occur; no rows: no rows;
further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, table, text_buffer, trim

FILTERS = "ABCDE"
#: Bytes of text of a range, at most and at least, and of the tries over what a task reads. Between these two a range is half a task's share.
RANGE_BYTES, LEAST_RANGE_BYTES, LOCAL_BYTES = 16 << 20, 1 << 20, 32 << 20
#: Ranges gathered for each prefix length.
MOST_RANGES = 200_000
#: Characters of the shortest prefix, and how many times longer the next one is.
FIRST, LONGER = 8, 16
LAST_ID = (1 << 63) - 1


class Trie:
    """A compressed radix trie over whole texts as bytes; terminals hold least ids.

    A node is [label, least id or None, children by first byte]. Labels are slices of inserted texts.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [b"", None, {}]

    def insert(self, text: bytes, doc_id: int) -> list:
        """The terminal of the text, which now holds the least of its ids."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            children = node[2]
            child = children.get(text[at])
            if child is None:
                child = children[text[at]] = [text[at:] if at else text, doc_id, {}]
                return child
            label = child[0]
            if not text.startswith(label, at):
                shared = _shared(label, text[at : at + len(label)])
                upper = [label[:shared], None, {label[shared]: child}]
                child[0] = label[shared:]
                children[text[at]] = child = upper
            node, at = child, at + len(child[0])
        if node[1] is None or doc_id < node[1]:
            node[1] = doc_id
        return node


def _shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix of two texts of which neither is a prefix of the other, or b of a."""
    n = min(len(a), len(b))
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(other[0]) if len(other) else n


def split_ranges(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes of the prefixes that are split, parts for each where it is one text, number of ranges of full size)."""
    size = F.octet_length("text").cast("long") + 16
    every = F.array_append("prefixes", F.lit(None))  # null: all texts
    sums = texts.select(size.alias("bytes"), F.explode(every).alias("prefix")).groupBy("prefix").agg(F.sum("bytes").alias("bytes"))
    sums = materialise(sums.where((F.col("bytes") > LEAST_RANGE_BYTES) | F.col("prefix").isNull()))
    total = next((r["bytes"] for r in sums.where(F.col("prefix").isNull()).collect()), 0)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST_RANGE_BYTES, min(RANGE_BYTES, total // (2 * tasks)), total // MOST_RANGES)
    wide = sums.where((F.col("bytes") > limit) & F.col("prefix").isNotNull()).orderBy("prefix").toArrow()  # at most MOST_RANGES for each length
    parts = -(-wide["bytes"].to_numpy() // limit)
    return wide["prefix"].to_numpy().astype(np.int64), parts.astype(np.int64), -(-total // limit)


def prefixes(text: Column) -> Column:
    """Hashes of the prefixes of 8, 128, 2,048 ... characters, up to the whole text."""
    sizes = [FIRST * LONGER**k for k in range(8)]  # the last is longer than any string
    longer = sum((F.char_length(text) > s).cast("int") for s in sizes[:-1])
    hashes = F.array(*(F.when(longer >= k, F.xxhash64(F.lit(k), F.substring(text, 1, min(s, (1 << 31) - 1)))) for k, s in enumerate(sizes)))
    return F.slice(hashes, F.lit(1), longer + 1)


class Tries:
    """Settles rows (doc_id, part, mask, n, text): flags copies of smaller ids and adds up repeated rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, rows: list[tuple], size: int) -> None:
        self.rows += rows
        self.size += size

    def settle(self) -> tuple[list[tuple], list[tuple]]:
        """(rows that are copies, the others: one for each text, part and least id); the held rows are let go."""
        trie, copies, kept = Trie(), [], {}
        terminals = [trie.insert(r[4], LAST_ID if r[0] is None else r[0]) for r in self.rows]
        for r, terminal in zip(self.rows, terminals, strict=True):
            if (LAST_ID if r[0] is None else r[0]) > terminal[1]:
                copies.append((r[0], r[1], r[2] | 16, r[3], None, *r[5:]))
                continue
            key = (id(terminal), r[1])
            kept[key] = (*r[:3], r[3] + kept[key][3], *r[4:]) if key in kept else r
        self.rows, self.size = [], 0
        return copies, list(kept.values())


_ROW = [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string()), ("range", pa.int64()), ("salt", pa.int64()), ("frequent", pa.bool_())]
_SHAPE = "doc_id long, part string, mask int, n long, text string, range long, salt long, frequent boolean"


def _batch(rows: list[tuple], texts: bool = False) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], kind) if name != "text" else pa.array([r[4] if texts else None for r in rows], pa.binary()).cast(pa.string()) for i, (name, kind) in enumerate(_ROW)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in _ROW])


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], int]:
    data, at = text_buffer(batch.column("text"))
    whole = data.tobytes()
    return [whole[a:b] for a, b in itertools.pairwise(at.tolist())], len(whole)


def _first_unsplit(hashes: pa.ListArray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: its first prefix that is not split, or the whole text; whether that is split; its place in `split`."""
    at, flat = hashes.offsets.to_numpy().astype(np.int64), hashes.values.to_numpy()
    place = np.searchsorted(split, flat)
    known = np.zeros(len(flat), bool)
    inside = place < len(split)
    known[inside] = split[place[inside]] == flat[inside]
    unsplit = np.flatnonzero(~known)
    nearest = np.append(unsplit, len(flat))[np.searchsorted(unsplit, at[:-1])]
    pick = np.minimum(nearest, at[1:] - 1)
    return flat[pick], known[pick], place[pick]


def local_tries(rows: DataFrame, split: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Tries over each part of what a task reads; what is left gets its range, and a salt where that is one frequent text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries()

        def settled() -> Iterator[pa.RecordBatch]:
            copies, left = tries.settle()
            for some, texts in ((copies, False), (left, True)):
                for at in range(0, len(some), 4096):
                    yield _batch(some[at : at + 4096], texts)
            trim()

        for batch in batches:
            range_, frequent, place = _first_unsplit(batch.column("prefixes"), split)
            ids = batch.column("doc_id").to_pylist()
            texts, size = _texts(batch)
            salts = [i % int(parts[p]) if f and i is not None else 0 for i, f, p in zip(ids, frequent.tolist(), place.tolist(), strict=True)]
            kept = zip(ids, batch.column("part").to_pylist(), batch.column("mask").to_pylist(), itertools.repeat(1), texts, range_.tolist(), salts, frequent.tolist(), strict=False)
            tries.add(list(kept), size)
            if tries.size >= LOCAL_BYTES:
                yield from settled()
        yield from settled()

    return rows.select("doc_id", "part", "mask", "prefixes", "text").mapInArrow(run, _SHAPE)


def range_tries(rows: DataFrame, tasks: int, salted: bool) -> DataFrame:
    """Tries over ranges; with `salted`, what is left of a frequent text keeps its text for one more step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries()

        def settled(last: int | None) -> Iterator[pa.RecordBatch]:
            copies, left = tries.settle()
            yield _batch(copies)
            done = [r for r in left if r[5] != last]
            yield _batch([r for r in done if not (salted and r[7])])
            yield _batch([r for r in done if salted and r[7]], True)
            again = [r for r in left if r[5] == last]
            tries.add(again, sum(len(r[4]) for r in again))
            trim()

        for batch in batches:
            empty = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            if empty.any():
                yield batch.filter(pa.array(empty)).select([name for name, _ in _ROW])
                batch = batch.filter(pa.array(~empty))
            if batch.num_rows == 0:
                continue
            texts, size = _texts(batch)
            values = [batch.column(name).to_pylist() if name != "text" else texts for name, _ in _ROW]
            tries.add(list(zip(*values, strict=True)), size)
            if tries.size >= LOCAL_BYTES:
                yield from settled(tries.rows[-1][5])
        yield from settled(None)

    # rows without a text are dealt out by their ids: they are no part of a range any more
    to = F.when(F.col("text").isNotNull(), F.xxhash64("range", "salt") if salted else F.xxhash64("range")).otherwise(F.xxhash64("doc_id", "part", "mask"))
    dealt = rows.withColumn("to", to).repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "to").sortWithinPartitions("to", "range")
    return dealt.drop("to").mapInArrow(run, _SHAPE)


def failures(text: Column) -> Column:
    """The bits of filters A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct"))), 1)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = F.transform(
        F.array(counts),
        lambda n: (n["all"] < 200).cast("int") + (F.lit(100) * n["distinct"] < F.lit(50) * n["all"]).cast("int") * 2,
    )
    return F.element_at(bits, 1) + (F.lit(100) * capitals > F.lit(3) * F.char_length(text)).cast("int") * 4 + text.rlike(r"[#$%&*|]").cast("int") * 8


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): which filters each document fails; equal rows are added up."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("prefixes", prefixes(F.col("text")))
    split, parts, tasks = split_ranges(rows)
    flagged = range_tries(local_tries(rows.withColumn("mask", failures(F.col("text"))), split, parts), tasks, salted=bool(len(split)))
    if len(split):
        flagged = materialise(flagged)
        rest = flagged.where(F.col("text").isNotNull())
        flagged = flagged.where(F.col("text").isNull()).unionByName(range_tries(rest, 1, salted=False))
    return flagged.select("doc_id", "part", "mask", "n")


def audit(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts for all 120 orders."""
    per = masked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    labelled = per.hint("shuffle_merge").join(says.hint("shuffle_merge"), "doc_id", "left")
    marks = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    counts = labelled.groupBy("part", "mask", *marks).agg(F.sum("n").alias("n"))
    bit = lambda step: F.expr(f"shiftleft(1, ascii(substring(filter_order, {step}, 1)) - 65)")
    orders = F.split(F.lit(",".join("".join(o) for o in itertools.permutations(FILTERS))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*(F.lit(i) for i in range(1, 6)))))
    before = sum((F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, 5)), F.lit(0))
    steps = steps.withColumn("bit", bit("step")).withColumn("before", before)
    fails, first = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    # of the 120 orders, a document's k failing filters come first equally often
    share = F.sum(F.when(fails, F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)).cast("long")
    return (
        steps.groupBy("part", "filter_order", "step")
        .agg(
            n(first & ~fails).alias("kept"), n(first & fails).alias("removed"), n(fails & ~first).alias("redundant"), n(F.col("mask") == F.col("bit")).alias("unique_fails"),
            n(first & fails & (F.col("quality") == 1)).alias("good_lost"), n(first & fails & (F.col("toxic") == 1)).alias("toxic_lost"), share.alias("shapley"),
        )
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (
  SELECT doc_id, part, (len(words) < 200)::INT + (100 * len(list_distinct(words)) < 50 * len(words))::INT * 2
    + (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT * 4 + regexp_matches(text, '[#$%&*|]')::INT * 8 + coalesce(doc_id > least, least IS NOT NULL)::INT * 16 AS mask
  FROM w),
says AS (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM m LEFT JOIN says USING (doc_id) GROUP BY ALL),
o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step:step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k:k]) - 65))), 0)::INT AS before
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
j AS (SELECT *, (mask & bit) <> 0 AS fails, (mask & before) = 0 AS first FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (first AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (first AND fails), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND NOT first), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (first AND fails AND quality = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (first AND fails AND toxic = 1), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM j GROUP BY ALL
"""
