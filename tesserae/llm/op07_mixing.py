"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The
exponent is bisected (a section search on sums that Spark computes over the table
of sources) to the flattest mix whose largest repetition stays within
`max_epochs`, or to a target entropy.

Budgets: the total is as large as it must be for every source to be read once in
full; a source of weight w and t tokens gets w x total tokens, that is total x w / t
epochs. Each source is put in a keyed permutation; its last epoch is cut where the
tokens before a document reach the budget. A drawn document's `position` is the part
of its source's budget before it, so cutting positions into blocks of about
`block_tokens` gives every block every source by its weight; `shuffle_key` permutes
within the block.

The permutation's prefix sums come from keyed-hash buckets of about `BUCKET` rows:
bucket totals are summed per source over the small table of buckets, and rows
within their bucket, so a source with a third of all rows is many buckets.

Defined results: null text: no tokens; null source: a source of its own; documents
without tokens are drawn once an epoch like others; sources without tokens: one
epoch, weight 0; one source: weight 1, one epoch; equal ids: told apart by a hash of
the text; repeated rows: each is drawn; no rows: no rows; further columns are kept
by `mix`, but for those of the names that it adds, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, table

BUCKET = 4096
SECTIONS, SEARCHES = 16, 6


def exponent(sources: DataFrame, max_epochs: float, target_entropy: float | None = None) -> float:
    """Of written (t = tokens > 0) rows: the exponent in [0, 1] whose weights meet the target."""
    whole = sources.agg(F.sum("t").cast("double"), F.max("t").cast("double"), F.min("t").cast("double")).first()
    if not whole[0] or whole[1] == whole[2]:
        return 1.0
    low, high = 0.0, 1.0
    share = F.col("t") / F.lit(whole[0])
    for _ in range(SEARCHES):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        if target_entropy is None:  # repetition of the smallest source when the largest is read once; falls with the exponent
            fits = [(whole[1] / whole[2]) ** (1 - a) <= max_epochs for a in tried]
        else:  # entropy of the weights; falls with the exponent
            sums = sources.agg(*(f for a in tried for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))))).first()
            entropy = [math.log(sums[2 * i]) - a * sums[2 * i + 1] / sums[2 * i] for i, a in enumerate(tried)]
            fits = [h <= target_entropy for h in entropy]
        first = next((i for i, ok in enumerate(fits) if ok), SECTIONS)
        low, high = tried[max(0, first - 1)], tried[first]
    return high


def budgets(documents: DataFrame, max_epochs: float, target_entropy: float | None = None) -> DataFrame:
    """Written rows of mix_key, docs, t, weight, epochs for each source."""
    counted = materialise(documents.groupBy("mix_key").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("t")))
    real = counted.where("t > 0")
    a = exponent(real, max_epochs, target_entropy)
    raised = F.pow(F.col("t").cast("double"), F.lit(a))
    norm, largest = real.agg(F.sum(raised), F.max(F.col("t") / raised)).first()  # total = largest t / weight
    weight = F.when(F.col("t") > 0, raised / F.lit(norm or 1.0)).otherwise(0.0)
    epochs = F.when(F.col("t") > 0, F.greatest(F.lit(1.0), F.lit((largest or 1.0)) * raised / F.col("t"))).otherwise(1.0)
    return materialise(counted.select("mix_key", "docs", "t", weight.alias("weight"), epochs.alias("epochs")))


def mix(documents: DataFrame, max_epochs: float = 2.0, target_entropy: float | None = None, block_tokens: int = 1_000_000, seed: str = "mix") -> DataFrame:
    """The drawn documents: all columns, and mix_tokens, weight, epoch, position, block, shuffle_key."""
    if max_epochs < 1:
        raise ValueError("max_epochs is at least 1")
    added = ("mix_tokens", "weight", "epoch", "position", "block", "shuffle_key")
    kept = [c for c in documents.columns if c not in added]
    names = [f"c{i}" for i in range(len(kept))]
    column = {c: F.col(n) for c, n in zip(kept, names, strict=True)}
    tokens = F.regexp_count(F.coalesce(column["text"], F.lit("")), F.lit(r"\S+")).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), column["source"].cast("string")), F.lit("null"))
    sized = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    sized = sized.select(*names, tokens.alias("n_tokens"), key.alias("mix_key"), F.xxhash64(F.lit(seed), column["doc_id"], column["text"]).alias("hash"))
    small = sized.select("mix_key", "n_tokens", "hash")
    plan = budgets(small, max_epochs, target_entropy)
    # buckets in the order of the hash
    place = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    bucket = F.floor(place * F.ceil(F.col("docs") / BUCKET)).cast("long").alias("bucket")
    known = plan.select("mix_key", "docs", "t", "weight", "epochs")
    known = F.broadcast(known) if _is_small(known) else known.hint("shuffle_merge")
    totals = small.join(known, "mix_key").groupBy("mix_key", bucket).agg(F.sum("n_tokens").alias("in_bucket"))
    by_source = Window.partitionBy("mix_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(totals.select("mix_key", "bucket", F.coalesce(F.sum("in_bucket").over(by_source), F.lit(0)).alias("before_bucket")))
    rows = sized.join(known, "mix_key").withColumn("bucket", bucket)
    rows = rows.join(before.hint("shuffle_merge"), ["mix_key", "bucket"])
    within = Window.partitionBy("mix_key", "bucket").orderBy("hash", column["doc_id"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before_bucket") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    t = F.greatest(F.col("t"), F.lit(1)).cast("double")
    # the epochs of a document: all full ones, and the last while the tokens before it are within the budget
    times = F.when(F.col("t") > 0, F.ceil(F.col("epochs") - F.col("before") / t)).otherwise(F.lit(1)).cast("int")
    drawn = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1)))
    position = (F.col("epoch") + F.col("before") / t) / F.col("epochs")
    total = plan.agg(F.sum(F.col("epochs") * F.col("t"))).first()[0] or 0.0
    blocks = max(1, math.ceil(total / block_tokens))
    return drawn.select(
        *names, F.col("n_tokens"), "weight", "epoch", position.alias("position"), F.least(F.floor(position * blocks), F.lit(blocks - 1)).cast("long").alias("block"),
        F.xxhash64(F.lit(seed), F.col("epoch"), F.col("hash")).alias("shuffle_key"),
    ).toDF(*kept, *added)


def _is_small(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the written table of sources may be broadcast."""
    return sources.limit(most + 1).count() <= most


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(documents).select("doc_id", "source", "mix_tokens", "weight", "epoch", "position", "block", "shuffle_key")
