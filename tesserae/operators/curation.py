"""Labels, deduplication, near-duplicate groups, splits and manifests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.functions import vectorised as U
from tesserae.operators.ranks import first_by_hash, ranked
from tesserae.operators.store import materialise


# labels
def alias_table(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "alias string, canonical string")


def normalise_labels(rows: DataFrame, raw: str, aliases: DataFrame, prefix: str) -> DataFrame:
    """Adds label_key and canonical (null: unknown); the alias table is a dimension and broadcast."""
    keyed = rows.withColumn("label_key", S.label_key(F.col(raw)))
    second = aliases.select(F.col("alias").alias("alias2"), F.col("canonical").alias("canonical2"))
    found = keyed.join(F.broadcast(aliases), F.col("label_key") == F.col("alias"), "left")
    found = found.join(F.broadcast(second), S.without_prefix(F.col("label_key"), prefix) == F.col("alias2"), "left")
    return found.withColumn("canonical", F.coalesce("canonical", "canonical2")).drop("alias", "alias2", "canonical2")


# deduplication
def dedup_first(rows: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The first row of each digest: an aggregate with map-side partials, no sort."""
    others = [c for c in rows.columns if c not in order]
    first = rows.groupBy(F.col(digest).alias("_digest")).agg(F.min(F.struct(*order, *others)).alias("row"))
    return first.select(*(F.col(f"row.{c}").alias(c) for c in rows.columns))


def dedup_audit(rows: DataFrame, digest: str, order: list[str], path: str, label: str) -> DataFrame:
    """Each removed row with the row that was kept."""
    kept = dedup_first(rows.select(digest, *dict.fromkeys([*order, path, label])), digest, order)
    kept = kept.select(F.col(digest).alias("_d"), *(F.col(c).alias(f"_{c}") for c in order), F.col(path).alias("kept_path"), F.col(label).alias("kept_class"))
    joined = rows.join(kept, F.col(digest) == F.col("_d"))
    different = F.lit(False)
    for c in order:
        different = different | (F.col(c) != F.col(f"_{c}"))
    return joined.where(different).select(F.col(digest), "kept_path", "kept_class", F.col(path).alias("removed_path"), F.col(label).alias("removed_class"), (F.col("kept_class") != F.col(label)).alias("cross_class"))


# near duplicates
def simhash60(text: Column) -> Column:
    """60-bit similarity hash over the distinct 3-word shingles, within the row: no explode, no shuffle. Null text: null."""
    lowered = F.lower(text)
    few = F.size(F.array_remove(F.split(lowered, r"[ \t\n\x0B\f\r]+", 4), "")) < 3
    return U.simhash60(lowered, F.when(few, text))  # the text itself counts only where it has fewer than three words


def bands_that_agree(rows: int) -> int:
    """How many bands make a join key: keys of about 15, 20 or 24 bits, so that chance groups stay small."""
    return 2 if rows <= 2_000_000 else 3 if rows <= 200_000_000 else 4


def hash_pairs(left: DataFrame, right: DataFrame, threshold: int, bits: int = 64, agree: int | None = None) -> DataFrame:
    """(l, r, distance) of written rows (id, label, h) of one label within the threshold.

    Pigeonhole: of threshold + agree bands at least `agree` are equal, so the join key is a choice of that many bands.
    """
    agree = agree or bands_that_agree(max(left.count(), right.count()))
    bands = threshold + agree
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    part = lambda i: F.shiftright("h", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    def joined(some: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in some:
            out = F.shiftleft(out, edges[i + 1] - edges[i]).bitwiseOR(part(i))
        return out

    keys = [F.struct(F.lit(k).alias("band"), joined(some).alias("x")) for k, some in enumerate(combinations(range(bands), agree))]
    keyed = lambda rows, side: rows.select(F.col("id").alias(side), "label", F.col("h").alias(f"h_{side}"), F.inline(F.array(*keys)))
    a, b = keyed(left, "l"), keyed(right, "r")
    near = S.hamming(F.col("h_l"), F.col("h_r")) <= threshold
    found = a.hint("shuffle_merge").join(b.hint("shuffle_merge"), ["label", "band", "x"]).where(near)
    return found.select("l", "r", S.hamming(F.col("h_l"), F.col("h_r")).alias("distance")).distinct()


def hash_classes(rows: DataFrame) -> DataFrame:
    """Written (id, label, h): the smallest id of each label and hash, which stands for its copies."""
    return materialise(rows.groupBy("label", "h").agg(F.min("id").alias("id")).select("id", "label", "h"))


def near_pairs(rows: DataFrame, threshold: int, bits: int = 60) -> DataFrame:
    """All pairs l < r of one label within the threshold, of distinct hashes: between the classes of equal hashes, each by
    its smallest id. `near_members` gives the copies of each."""
    one = hash_classes(rows)
    return hash_pairs(one, one, threshold, bits).where("l < r")


def near_members(rows: DataFrame) -> DataFrame:
    """(id, label, class_id): the class of equal hashes of each row."""
    return rows.hint("shuffle_merge").join(hash_classes(rows).withColumnRenamed("id", "class_id").hint("shuffle_merge"), ["label", "h"]).select("id", "label", "class_id")


def near_stars(rows: DataFrame, threshold: int, bits: int = 60) -> DataFrame:
    """Links (l, r) with the same connected parts as all pairs: copies hang on the one that stands for their hash."""
    one = hash_classes(rows)
    copies = rows.hint("shuffle_merge").join(one.withColumnRenamed("id", "l").hint("shuffle_merge"), ["label", "h"]).where("id <> l").select("l", F.col("id").alias("r"))
    return hash_pairs(one, one, threshold, bits).where("l < r").select("l", "r").unionByName(copies)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all linked nodes: the smallest label spreads, and pointers jump, until nothing changes."""
    edges = materialise(links.select("l", "r").unionByName(links.select(F.col("r").alias("l"), F.col("l").alias("r"))).distinct())
    roots = materialise(edges.groupBy(F.col("l").alias("node")).agg(F.least(F.min("r"), F.col("l")).alias("root")))
    while True:
        spread = edges.join(roots.withColumnRenamed("node", "r"), "r").groupBy(F.col("l").alias("node")).agg(F.min("root").alias("seen"))
        stepped = roots.join(spread, "node").select("node", F.least("root", "seen").alias("root"))
        jumped = stepped.join(stepped.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("new"))
        changed = materialise(jumped.join(roots, "node"))
        done = changed.where("new <> root").isEmpty()
        roots = changed.select("node", F.col("new").alias("root"))
        if done:
            return roots


def near_groups(rows: DataFrame, threshold: int, bits: int = 60) -> DataFrame:
    """(id, label, group_id): dense group numbers by first member within a label; -1 where there is no hash.

    A label with fewer than two hashes has one group 0.
    """
    hashed = rows.where("h is not null")
    roots = components(near_stars(hashed, threshold, bits))
    rooted = rows.join(roots, rows["id"] == roots["node"], "left").select("id", "label", "h", F.coalesce("root", "id").alias("root"))
    reps = rooted.where("h is not null").select("label", "root").distinct()
    numbered = materialise(ranked(reps, ["label"], ["root"]).select("label", "root", (F.col("rank") - 1).alias("group_id")))
    return rooted.join(numbered, ["label", "root"], "left").select("id", "label", F.when(F.col("h").isNull(), -1).otherwise(F.col("group_id")).cast("long").alias("group_id"))


# splits
def stratified_split(rows: DataFrame, label: str, key: str, test: float, seed: int = 42, names: tuple[str, str] = ("test", "train"), least: int = 1) -> DataFrame:
    """Adds `split`: bround(n * test) rows of each label, at least `least`, never all, by hash order."""
    quota = lambda n: F.least(F.greatest(F.bround(n * test, 0).cast("long"), F.lit(least)), n - 1)
    return first_by_hash(rows, label, key, quota, seed).withColumn("split", F.when(F.col("_first"), names[0]).otherwise(names[1])).drop("_first")


def grouped_split(groups: DataFrame, test: float, seed: int = 42) -> DataFrame:
    """(label, group_id, n) to (label, group_id, split): whole groups, the largest first, each to the side with the larger
    deficit relative to its target; ties go to test.

    Groups of one size are a run. In a run of size n that begins with a rows in test and b in train, of the first j groups
    floor((n * train + b * test - a * train + n * j * test) / (n * (test + train))) go to test, within 0 and j, where test and
    train are the targets: the walk keeps a * train - b * test within the last step. So only runs, of which a label with N rows
    has at most sqrt(2 N), are walked one after the other, and each group needs its place in its run alone.
    """

    def walk(runs):
        runs = runs.sort_values("n", ascending=False)
        sizes, many = [int(n) for n in runs["n"]], [int(m) for m in runs["m"]]
        total = sum(n * m for n, m in zip(sizes, many, strict=True))
        want = max(1, round(total * test)) if sum(many) > 1 else 0
        a = b = 0
        start = []
        for n, m in zip(sizes, many, strict=True):
            start.append((a, b))
            to_test = min(max((n * (total - want) + b * want - a * (total - want) + n * m * want) // (n * total), 0), m) if want else 0
            a, b = a + n * to_test, b + n * (m - to_test)
        runs["a"], runs["b"] = [x for x, _ in start], [x for _, x in start]
        runs["want"], runs["total"] = want, total
        return runs[["label", "n", "a", "b", "want", "total"]]

    runs = groups.groupBy("label", "n").agg(F.count(F.lit(1)).alias("m")).groupBy("label").applyInPandas(walk, "label string, n long, a long, b long, want long, total long")
    placed = ranked(groups.withColumn("o", S.hash_order(F.concat_ws("|", "label", "group_id"), seed)), ["label", "n"], ["o", "group_id"])
    joined = placed.select("label", "group_id", "n", "rank").hint("shuffle_merge").join(runs.hint("shuffle_merge"), ["label", "n"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    rest = big("total") - big("want")
    lead = big("n") * rest + big("b") * big("want") - big("a") * rest

    def tests(j: Column) -> Column:
        whole = F.floor((lead + big("n") * big("want") * j.cast("decimal(18,0)")) / (big("n") * big("total"))).cast("long")
        return F.least(F.greatest(whole, F.lit(0)), j)

    to_test = (F.col("want") > 0) & (tests(F.col("rank")) > tests(F.col("rank") - 1))
    return joined.select("label", "group_id", F.when(to_test, "test").otherwise("train").alias("split"))


def sample_per_class(rows: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """The first min(k, n) rows of each label by hash order."""
    return first_by_hash(rows, label, key, lambda n: F.least(F.lit(k), n), seed).where("_first").drop("_first")


# augmentation
def augmentation_report(rows: DataFrame, label: str, augmented: str, classes: DataFrame, target: int | None = None, extra: int = 0) -> DataFrame:
    """(label, real, existing, target, generated, reason) of each expected class.

    The target is fixed, or the size of the largest class and `extra`; augmented rows count for it and are never sources, so
    a class without other rows is skipped with a reason.
    """
    counts = rows.groupBy(label).agg(F.count_if(~F.col(augmented)).alias("real"), F.count_if(augmented).alias("existing"))
    full = classes.select(label).distinct().join(counts, label, "left").select(label, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("real", "existing")))
    there = F.col("real") + F.col("existing")
    if target is None:
        aim = materialise(full.agg((F.coalesce(F.max(there), F.lit(0)) + extra).alias("target")))  # one row
        full = full.join(F.broadcast(aim))
    else:
        full = full.withColumn("target", F.lit(target).cast("long"))
    generated = F.when(F.col("real") == 0, 0).otherwise(F.greatest(F.col("target") - there, F.lit(0))).cast("long")
    reason = F.when(F.col("target") <= there, "at target").when(there == 0, "no rows").when(F.col("real") == 0, "no source rows to augment from")
    return full.select(label, "real", "existing", "target", generated.alias("generated"), reason.alias("reason"))


# manifests
def manifest_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The exact form: SHA-256 of the rows sorted as tuples, one line each. One task holds the lines, so it is for manifests."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda r: F.concat_ws("|", *(r[c] for c in columns)))
    return rows.agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("fingerprint"))


def merkle_fingerprint(rows: DataFrame, columns: list[str], depth: int = 2) -> DataFrame:
    """The form for any size: a digest for each of 16^depth hash buckets, then the digest of these (another value than the exact form)."""
    line = F.concat_ws("|", *columns)
    own = F.sha2(line.cast("binary"), 256)
    leaves = rows.select(own.alias("d")).groupBy(F.substring("d", 1, depth).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n").cast("binary"), 256).alias("d"))
    return leaves.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), "\n").cast("binary"), 256).alias("fingerprint"))


def unpivot_metrics(row: DataFrame, names: list[str]) -> DataFrame:
    """A one-row frame to (metric, value) lines."""
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value")) for n in names))))


def suffix_collisions(rows: DataFrame, keys: list[str], name: str, order: Column) -> DataFrame:
    """Names that occur again under the same keys get __1, __2, ... before the extension."""
    n = (F.col("rank") - 1).cast("string")
    renamed = F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lit("__"), n, F.regexp_extract(name, r"(\.[^.]*)?$", 1))
    placed = ranked(rows, [*keys, name], [order])
    return placed.withColumn("stored_name", F.when(F.col("rank") == 1, F.col(name)).otherwise(renamed)).drop("rank", "size")
