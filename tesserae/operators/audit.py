"""Train/test leakage, dataset validation, integrity and assertion checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.curation import hash_pairs, materialise

#: Most severe first.
SEVERITY = ("cross_class_exact", "exact", "near", "filename")


def exact_leaks(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows with train rows of the same digest: kind exact, or cross_class_exact where the classes differ.

    One row for each test row and train class, with the first train path and the number of train rows (n_train), so
    copies are never expanded into pairs. Rows: (class, path, sha256).
    """
    t = test.where("sha256 <> ''").select(F.col("class").alias("cls"), F.col("path").alias("test_path"), "sha256")
    r = train.where("sha256 <> ''").groupBy("sha256", F.col("class").alias("train_cls")).agg(F.min("path").alias("train_path"), F.count(F.lit(1)).alias("n_train"))
    kind = F.when(F.col("cls") == F.col("train_cls"), "exact").otherwise("cross_class_exact")
    return t.join(r, "sha256").select(kind.alias("kind"), "cls", "test_path", "train_path", "n_train", F.lit(None).cast("int").alias("distance"), "sha256")


def filename_leaks(test: DataFrame, train: DataFrame) -> DataFrame:
    """Same filename, other bytes, against the first train row of that name."""
    first = train.groupBy("filename").agg(F.min(F.struct("path", "sha256")).alias("row")).select("filename", F.col("row.path").alias("train_path"), F.col("row.sha256").alias("train_sha"))
    found = test.join(first, "filename").where(F.col("sha256") != F.col("train_sha"))
    return found.select(F.lit("filename").alias("kind"), F.col("class").alias("cls"), F.col("path").alias("test_path"), "train_path", F.lit(1).cast("long").alias("n_train"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("string").alias("sha256"))


def within_split_copies(rows: DataFrame) -> DataFrame:
    """(split, duplicates): surplus copies inside each side."""
    return rows.where("sha256 <> ''").groupBy("split", "sha256").count().groupBy("split").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def without_exact(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.join(train.where("sha256 <> ''").select("sha256"), "sha256", "left_anti")


def near_leaks(test: DataFrame, train: DataFrame, threshold: int = 6, bits: int = 60, cross_class: bool = False) -> DataFrame:
    """Per test row that has no exact hit: the nearest train row of its class within the threshold; ties go to the first path."""
    rows = materialise(without_exact(test, train).where("h is not null"))
    label = F.lit("") if cross_class else F.col("class")
    copies = train.where("h is not null").groupBy(label.alias("label"), "h").agg(F.min("path").alias("id"))
    pairs = hash_pairs(rows.select(F.col("path").alias("id"), label.alias("label"), "h"), materialise(copies), threshold, bits)
    best = pairs.groupBy("l").agg(F.min(F.struct("distance", "r")).alias("m"))
    return best.hint("shuffle_merge").join(rows.select(F.col("path").alias("l"), "class").hint("shuffle_merge"), "l").select(F.lit("near").alias("kind"), F.col("class").alias("cls"), F.col("l").alias("test_path"), F.col("m.r").alias("train_path"), F.lit(1).cast("long").alias("n_train"), F.col("m.distance").alias("distance"), F.lit(None).cast("string").alias("sha256"))


def severity(kind: Column) -> Column:
    out = F.when(kind == SEVERITY[0], 0)
    for i, k in enumerate(SEVERITY[1:], 1):
        out = out.when(kind == k, i)
    return out


def leak_summary(hits: DataFrame, test_rows: int | Column) -> DataFrame:
    """Count per kind (zero-filled), whether it blocks, and its share of the test rows."""
    kinds = hits.sparkSession.createDataFrame([(k, k in SEVERITY[:2]) for k in SEVERITY], "kind string, blocking boolean")
    counts = hits.groupBy("kind").agg(F.sum("n_train").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return kinds.join(counts, "kind", "left").select("kind", n.alias("hits"), "blocking", F.round(F.lit(100.0) * n / test_rows, 6).alias("percent_of_test"))


class LeakageError(ValueError):
    """Exact or cross-class copies cross the split."""


def gate(summary: DataFrame, allow: bool = False) -> DataFrame:
    """The summary, unless a blocking kind has hits."""
    if not allow and not summary.where("blocking and hits > 0").isEmpty():
        raise LeakageError("exact copies of test rows are in the training rows")
    return summary


def gate_report(summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """(check, ok, detail): no blocking hits; near copies were searched at all (no candidates: their count means nothing); and
    whether the gate is open. `summary` is of leak_summary, `candidates` one row with a count."""
    blocking = summary.agg(F.coalesce(F.sum(F.when(F.col("blocking"), F.col("hits"))), F.lit(0)).alias("n"))
    searched = candidates.select(F.col("candidates").alias("n"))
    line = lambda rows, check, ok: rows.select(F.lit(check).alias("check"), ok.alias("ok"), F.col("n").cast("string").alias("detail"))
    checks = line(blocking, "blocking_hits", F.col("n") == 0).unionByName(line(searched, "near_candidates_checked", F.col("n") > 0))
    gate_line = blocking.select(F.lit("gate").alias("check"), (F.col("n") == 0).alias("ok"), F.when(F.col("n") == 0, "open").otherwise("closed").alias("detail"))
    return checks.unionByName(gate_line)


def leakage_audit(test: DataFrame, train: DataFrame, allow: bool = False, threshold: int = 6, bits: int = 60) -> DataFrame:
    """All hit kinds with their counts, and the copies inside each side; raises where a blocking kind has hits and is not allowed."""
    n = test.count()
    hits = exact_leaks(test, train).unionByName(near_leaks(test, train, threshold, bits)).unionByName(filename_leaks(test, train))
    summary = gate(materialise(leak_summary(hits, n)), allow)
    inside = within_split_copies(test.withColumn("split", F.lit("test")).unionByName(train.withColumn("split", F.lit("train"))))
    share = F.round(F.lit(100.0) * F.col("duplicates") / n, 6)
    return summary.unionByName(inside.select(F.concat(F.lit("within_"), "split").alias("kind"), F.col("duplicates").alias("hits"), F.lit(False).alias("blocking"), share.alias("percent_of_test")))


def count_by_split_class(rows: DataFrame, classes: DataFrame, splits: list[str]) -> DataFrame:
    """Rows per split and class, zero-filled over the class dimension."""
    grid = classes.select("class", F.explode(F.array(*(F.lit(s) for s in splits))).alias("split"))
    counts = rows.groupBy("split", "class").count()
    return grid.hint("shuffle_merge").join(counts.hint("shuffle_merge"), ["split", "class"], "left").select("split", "class", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def class_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, class): missing classes are expected and not found, unexpected ones the reverse."""
    missing = expected.select("class").distinct().join(found.select("class"), "class", "left_anti").select(F.lit("missing").alias("kind"), "class")
    extra = found.select("class").distinct().join(expected.select("class"), "class", "left_anti").select(F.lit("unexpected").alias("kind"), "class")
    return missing.unionByName(extra)


def one_sided_classes(rows: DataFrame) -> DataFrame:
    sides = rows.groupBy("class").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return sides.where("n_train = 0 or n_test = 0")


def integrity_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    b = before.select(F.col(key), F.col(value).alias("value_before"), F.lit(True).alias("in_before"))
    a = after.select(F.col(key), F.col(value).alias("value_after"), F.lit(True).alias("in_after"))
    state = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(F.col("value_before").eqNullSafe(F.col("value_after")), "unchanged").otherwise("changed")
    return b.join(a, key, "full").select(key, state.alias("state"), "value_before", "value_after")


def assertions(*checks: DataFrame) -> DataFrame:
    """Union of (section, check, ok, detail) rows as PASS or FAIL lines."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("section", "check", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("result"), "detail")


def assertion(rows: DataFrame, section: str, check: str, bad: Column) -> DataFrame:
    """One line: no row is bad."""
    n = F.count_if(bad)
    return rows.agg(n.alias("n")).select(F.lit(section).alias("section"), F.lit(check).alias("check"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" violations")).alias("detail"))


def column_mismatches(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Every column in which two one-row frames differ, nulls compared as values."""
    pack = lambda df, name: df.select(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(name), F.lit(1).alias("one"))
    both = pack(left, "l").join(pack(right, "r"), "one")
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").alias("stored"), F.col(f"r.{c}").alias("expected")) for c in columns)))).where(~F.col("stored").eqNullSafe(F.col("expected")))


def running_best(history: DataFrame, epoch: str, value: str, patience: int) -> DataFrame:
    """best_before, improved (strictly better than all before, from 0.0), stale (epochs since), stopped.

    A history is one row per epoch, so the global window is small by nature.
    """
    w = Window.orderBy(epoch)
    before = F.coalesce(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = history.withColumn("best_before", F.greatest(before, F.lit(0.0))).withColumn("improved", F.col(value) > F.col("best_before"))
    last = F.last(F.when(F.col("improved"), F.col(epoch)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(epoch).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("stale", F.when(last.isNotNull(), F.col(epoch) - last).otherwise(F.col(epoch) - first + 1))
    stop = F.min(F.when(F.col("stale") >= patience, F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("stop_epoch", stop)
