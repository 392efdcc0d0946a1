"""Column functions: labels, hashes, vectors, probabilities and formats. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


# labels and paths
def label_key(raw: Column) -> Column:
    """Trimmed, lower-cased, blanks to underscores, no underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "_"), r"^_+|_+$", "")


def without_prefix(key: Column, prefix: str) -> Column:
    return F.regexp_replace(F.regexp_replace(key, prefix, ""), r"^_+", "")


def relative_path(path: Column, root: str) -> Column:
    """Forward slashes, without the root."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + root.rstrip("/") + "/", "")


def file_stem(name: Column) -> Column:
    """The leading name part before the trailing index."""
    return F.regexp_extract(name, r"^(.*?)_?\d*(?:\.[^.]*)?$", 1)


def file_index(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1).try_cast("long")


# hashes of numeric planes and texts
def bits_to_long(flags: Column) -> Column:
    """An array of booleans to a long, the first at bit 0."""
    value = F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(value, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def mean_hash(plane: Column) -> Column:
    """Bit i: value i is above the mean."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    return let(plane, lambda p: let(mean(p), lambda m: bits_to_long(F.transform(p, lambda x: x > m))))


def median_hash(block: Column) -> Column:
    """Bit i: coefficient i is above the median of all coefficients but the first."""
    rest = lambda b: F.sort_array(F.slice(b, 2, F.size(b) - 1))
    middle = lambda r: F.when(F.size(r) % 2 == 1, F.get(r, F.floor(F.size(r) / 2).cast("int"))).otherwise((F.get(r, F.floor(F.size(r) / 2).cast("int") - 1) + F.get(r, F.floor(F.size(r) / 2).cast("int"))) / 2)
    return let(block, lambda b: let(let(rest(b), middle), lambda m: bits_to_long(F.transform(b, lambda x: x > m))))


def gradient_hash(plane: Column, width: int) -> Column:
    """Bit: a value is above its right neighbour, row by row."""
    pairs = lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / width).cast("int") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda c: F.get(p, r * width + c) > F.get(p, r * width + c + 1))))
    return let(plane, lambda p: bits_to_long(pairs(p)))


HASHES = {"mean": mean_hash, "median": median_hash, "gradient": lambda p: gradient_hash(p, 8)}


def plane_hash(name: str, plane: Column) -> Column:
    """A hash by name; an unknown name is an error, a null plane gives null."""
    if name not in HASHES:
        raise ValueError(f"unknown hash {name!r}; known: {', '.join(sorted(HASHES))}")
    return F.when(plane.isNotNull(), HASHES[name](plane))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# vectors
def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    return let(v, lambda x: let(norm(x), lambda n: F.transform(x, lambda y: F.try_divide(y, n))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(v: Column) -> Column:
    """Shifted by the maximum."""
    shifted = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda y: F.exp(y - m)))
    return let(let(v, shifted), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def ranked(values: Column) -> Column:
    """Structs (value, index) from the largest; the first index wins ties."""
    return F.transform(F.reverse(F.sort_array(F.transform(values, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))), lambda s: F.struct(s["p"].alias("value"), (-s["i"]).alias("index")))


def minmax_scale(v: Column) -> Column:
    """(x - low) / (high - low); zeros where constant."""
    return let(v, lambda x: let(F.array_min(x), lambda lo: let(F.array_max(x), lambda hi: F.transform(x, lambda y: F.when(hi > lo, (y - lo) / (hi - lo)).otherwise(0.0)))))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def deviation(v: Column) -> Column:
    """Population standard deviation."""
    return let(v, lambda x: let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda y: (y - m) * (y - m))))))


def entropy(weights: Column) -> Column:
    """-sum p ln p of positive weights, in nats."""
    share = lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(w, lambda x: x / s))
    return F.aggregate(F.transform(let(weights, share), lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


# undefined is null, and formats
def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def format_value(x: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", x), F.lit("N/A"))


def format_percent(x: Column) -> Column:
    return F.coalesce(F.format_string("%.3f%%", x * 100), F.lit("N/A"))


def confidence_band(confidence: Column, margin: Column, high: float = 0.70, narrow: float = 0.25) -> Column:
    return F.when(confidence >= high, "high").when(margin < narrow, "ambiguous").otherwise("moderate")


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hash_order(key: Column, seed: int | str = 42) -> Column:
    """A random order that does not depend on partitioning."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"), 256)
