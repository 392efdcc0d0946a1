"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A text is cut into paragraphs: at line ends, and in long lines after a sentence of
60 characters or more, so that the cuts depend on the text around them alone. A
paragraph and the number of times it occurs hash to a 64-bit digest whose low 16
bits check the others. Each digest is added to one cell of each of three
subtables; a cell keeps the count and the XOR of its digests. The table of the
smallest size is the fingerprint, written as hex.

Two versions are compared by subtracting tables cell by cell: shared digests
vanish, and peeling the cells that hold one digest recovers the differing digests
of both sides. Where peeling gets stuck, tables eight times as large, with other
cells, are subtracted, until twice as many cells as digests are there; the few
pairs that still fail are compared by their digests. All steps sort arrays within
a row, so a row costs n log n in its paragraphs, and no step shuffles.

The likeness of two fingerprints is shared / all distinct digests (1 for two
texts without any).

`with_next` finds the next document in descending doc_id without a global window:
bounds cut the ids into buckets, each bucket also gets the first row of the bucket
that follows, and a window runs per bucket.

Defined results: null text: empty; null doc_id: after all others; equal ids:
ordered by a hash of the text, then the text; one row: it is its own next; no
rows: no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import table

#: Where paragraphs are cut.
CUT = r"\n|(?<=[.!?])(?<=[^.!?\n]{60}.)[ \t]+"
SUBTABLES = 3
#: Cells of a subtable of the fingerprint; each retry has GROWTH times as many.
BASE_CELLS = 8
GROWTH = 8
ROUNDS = 24
#: A difference that fills more of its cells than this is not peeled but retried.
FULL = 0.85
ROWS_A_BUCKET, MOST_BUCKETS = 2000, 100_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _run_starts(sorted_: Column, key: Callable[[Column], Column]) -> Column:
    return F.filter(_indices(F.size(sorted_)), lambda i: (i == 0) | (key(F.get(sorted_, i)) != key(F.get(sorted_, i - 1))))


def digests(text: Column) -> Column:
    """One checked 64-bit digest per distinct paragraph and its count."""
    pieces = F.filter(F.split(text, CUT), lambda p: p != "")

    def counted(d: Column) -> Column:
        return let(
            _run_starts(d, lambda x: x),
            lambda s: F.transform(s, lambda at, k: checked(F.xxhash64(F.get(d, at), F.coalesce(F.get(s, k + 1), F.size(d)) - at))),
        )

    return let(F.sort_array(F.transform(pieces, lambda p: F.xxhash64(p))), counted)


def checked(h: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(h, 16), 16)
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(0xFFFF)))


def _is_checked(k: Column) -> Column:
    return checked(k) == k


def _cell(key: Column, sub: int, level: Column, cells: Column) -> Column:
    return (F.pmod(F.xxhash64(key, level * SUBTABLES + sub), cells) + cells * sub).cast("int")


def _entries(keys: Column, sign: Column | int, level: Column, cells: Column) -> Column:
    n = F.lit(sign) if isinstance(sign, int) else sign
    add = lambda k: F.array(*(F.struct(_cell(k, j, level, cells).alias("cell"), n.cast("int").alias("n"), k.alias("k")) for j in range(SUBTABLES)))
    return F.flatten(F.transform(keys, add))


def _combine(entries: Column) -> Column:
    """Add up the entries of each cell; empty cells go."""

    def cell(e: Column, s: Column, at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(s, k + 1), F.size(e))
        add = lambda a, x: F.struct(a["cell"].alias("cell"), (a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"))
        # most cells have one entry, or two
        return (
            F.when(stop == at + 1, F.get(e, at)).when(stop == at + 2, add(F.get(e, at), F.get(e, at + 1)))
            .otherwise(F.aggregate(F.slice(e, at + 2, stop - at - 1), F.get(e, at), add))
        )

    added = let(F.sort_array(entries), lambda e: let(_run_starts(e, lambda x: x["cell"]), lambda s: F.transform(s, lambda at, k: cell(e, s, at, k))))
    return F.filter(added, lambda c: (c["n"] != 0) | (c["k"] != 0))


def sketch(keys: Column, level: Column | int = 0) -> Column:
    """The table of a set of digests: array of (cell, n, k)."""
    level = F.lit(level) if isinstance(level, int) else level
    return _combine(_entries(keys, 1, level, _cells(level)))


def _cells(level: Column) -> Column:
    return (F.lit(BASE_CELLS) * F.pow(F.lit(float(GROWTH)), level)).cast("long")


def fingerprint(sketched: Column) -> Column:
    """Cells as hex: 2 digits of the cell, 8 of the count, 16 of the digests."""
    code = lambda c: F.concat(F.lpad(F.hex(c["cell"]), 2, "0"), F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"))
    return F.lower(F.array_join(F.transform(sketched, code), ""))


_NO_KEYS = "cast(array() as array<bigint>)"


def peel(difference: Column, level: Column) -> Column:
    """(rest, plus, minus): the digests that peeling recovers on either side, and the cells left over."""
    start = F.struct(difference.alias("rest"), F.expr(_NO_KEYS).alias("plus"), F.expr(_NO_KEYS).alias("minus"))

    def turn(acc: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(acc["rest"], lambda c: (F.abs(c["n"]) == 1) & _is_checked(c["k"])), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def take(p: Column) -> Column:
            out = F.flatten(F.transform(p, lambda c: _entries(F.array(c["k"]), -c["n"], level, _cells(level))))
            side = lambda sign: F.transform(F.filter(p, lambda c: c["n"] == sign), lambda c: c["k"])
            return F.when(F.size(p) == 0, acc).otherwise(
                F.struct(_combine(F.concat(acc["rest"], out)).alias("rest"), F.concat(acc["plus"], side(1)).alias("plus"), F.concat(acc["minus"], side(-1)).alias("minus"))
            )

        return F.when((F.size(acc["rest"]) == 0) | (F.size(acc["rest"]) > F.lit(FULL * SUBTABLES) * _cells(level)), acc).otherwise(let(pure, take))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, _: turn(acc))


def subtract(a: Column, b: Column) -> Column:
    """The difference of two tables of the same level."""
    negated = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["k"].alias("k")))
    return _combine(F.concat(a, negated))


def differing(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """(plus, minus): the digests only in a and only in b; base_a and base_b are their fingerprints' tables."""
    total = F.size(a) + F.size(b)
    # up to a level with twice as many cells as digests, and one more
    last = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(total, F.lit(1)) * 2.0 / (BASE_CELLS * SUBTABLES)) / F.log(F.lit(float(GROWTH))))).cast("int") + 1
    start = F.struct(F.lit(False).alias("done"), F.expr(_NO_KEYS).alias("plus"), F.expr(_NO_KEYS).alias("minus"))

    def attempt(acc: Column, level: Column) -> Column:
        first = subtract(base_a, base_b)
        later = _combine(F.concat(_entries(a, 1, level, _cells(level)), _entries(b, -1, level, _cells(level))))
        tried = peel(F.when(level == 0, first).otherwise(later), level)
        done = lambda p: F.struct((F.size(p["rest"]) == 0).alias("done"), p["plus"].alias("plus"), p["minus"].alias("minus"))
        return F.when(acc["done"], acc).otherwise(let(tried, done))

    found = F.aggregate(F.sequence(F.lit(0), last), start, attempt)
    exact = F.struct(F.lit(True).alias("done"), F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    return let(found, lambda r: F.when(r["done"], r).otherwise(exact))


def likeness(a: Column, difference: Column) -> Column:
    """Shared over all distinct digests; `difference` is worked out once."""

    def share(only: Column) -> Column:
        shared, union = F.size(a) - F.size(only["plus"]), F.size(a) + F.size(only["minus"])
        return F.when(union == 0, F.lit(1.0)).otherwise(shared.cast("double") / union)

    return let(difference, share)


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds up to the id; -1 for a null id. Two short searches instead of a long one."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.size(F.filter(longs(bounds[::step]), lambda b: b <= doc_id))
    fine = F.get(F.array(*(longs(bounds[i : i + step]) for i in range(0, len(bounds), step))), coarse - 1)
    return F.when(doc_id.isNull(), -1).when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= doc_id)))


def with_next(documents: DataFrame, carried: list[str]) -> DataFrame:
    """The rows (doc_id, text, carried columns) with next_<column> of the next row in descending doc_id, wrapping around."""
    spark = documents.sparkSession
    ids = documents.select("doc_id")
    rows = ids.count()
    parts = min(MOST_BUCKETS, -(-rows // ROWS_A_BUCKET))
    bounds = []
    if parts > 1:
        at = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("p")).first()["p"]
        bounds = sorted(set(at or []))
    bucket = _bucket(F.col("doc_id"), bounds)
    heads = sorted(ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).collect(), reverse=True)  # one row a bucket
    order = [F.col("again"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    columns = ["text", *carried]
    every = documents.select("doc_id", *columns, bucket.alias("bucket"), F.lit(False).alias("again"))
    if heads:
        goes_to = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
        target = spark.createDataFrame(goes_to, "head long, bucket int")  # at most MOST_BUCKETS rows
        known = [h for h, _ in goes_to if h is not None]
        first = documents.where(F.col("doc_id").isin(known) | F.col("doc_id").isNull())
        firsts = first.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *columns)).alias("row"))
        copies = firsts.join(F.broadcast(target), firsts["doc_id"].eqNullSafe(target["head"])).select("doc_id", *(F.col(f"row.{c}").alias(c) for c in columns), "bucket", F.lit(True).alias("again"))
        every = every.unionByName(copies)
    w = Window.partitionBy("bucket").orderBy(*order)
    led = every.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return led.where(~F.col("again")).drop("bucket", "again")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    led = with_next(documents.withColumn("keys", digests(F.col("text"))), ["keys"])

    def compared(r: Column) -> Column:
        text, n = r["text"], F.char_length(r["text"])
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(r["next_text"], F.lit(1), half))
        first = let(
            F.struct(n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("sha"), r["keys"].alias("a"), digests(edited).alias("e"), r["next_keys"].alias("x")),
            lambda t: F.struct(
                t["n_chars"].alias("n_chars"), t["sha"].alias("sha"), t["a"].alias("a"), t["e"].alias("e"), t["x"].alias("x"),
                sketch(t["a"]).alias("sa"), sketch(t["e"]).alias("se"), sketch(t["x"]).alias("sx"),
            ),
        )
        return let(
            first,
            lambda t: F.struct(
                t["n_chars"].alias("n_chars"), t["sha"].alias("edited_sha256"), fingerprint(t["sa"]).alias("fingerprint"), fingerprint(t["se"]).alias("edited_fingerprint"),
                likeness(t["a"], differing(t["a"], t["e"], t["sa"], t["se"])).alias("near_edited"), likeness(t["a"], differing(t["a"], t["x"], t["sa"], t["sx"])).alias("near_next"),
            ),
        )

    row = F.struct("text", "keys", "next_text", "next_keys")
    return led.select("doc_id", F.inline(F.array(compared(row))))
