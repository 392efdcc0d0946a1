"""Metrics of predictions. An undefined metric is null, never an invented number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators.ranks import running


def confusion_matrix(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(truth, pred, n), zero-filled over the class dimension."""
    other = classes.agg(F.collect_list("cls").alias("all"))  # a dimension
    grid = classes.select(F.col("cls").alias("truth")).join(F.broadcast(other)).select("truth", F.explode("all").alias("pred"))
    counts = predictions.groupBy("truth", "pred").count()
    return F.broadcast(grid).join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def normalised(confusion: DataFrame) -> DataFrame:
    """Shares of the truth rows; rows without truth stay 0."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    return confusion.select("truth", "pred", F.coalesce(S.safe_div(F.col("n").cast("double"), total), F.lit(0.0)).alias("share"))


def per_class(confusion: DataFrame, strict: bool = False) -> DataFrame:
    """precision, recall, f1, support of each class.

    A class without truth rows has nulls. One that was never predicted has precision 0, or with `strict` null.
    """
    cls = confusion.select(F.inline(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )))
    sums = cls.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    precision = F.when(F.col("support") > 0, S.safe_div(F.col("tp").cast("double"), F.col("predicted")))
    if not strict:
        precision = F.when(F.col("support") > 0, F.coalesce(precision, F.lit(0.0)))
    rows = sums.select("cls", "support", "predicted", precision.alias("precision"), S.safe_div(F.col("tp").cast("double"), F.col("support")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)))


def macro_weighted(classes: DataFrame) -> DataFrame:
    f1 = F.col("f1") * F.col("support")
    return classes.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), S.safe_div(F.sum(f1), F.sum(F.when(F.col("f1").isNotNull(), F.col("support")))).alias("weighted_f1"))


def auc_one_vs_rest(scores: DataFrame) -> DataFrame:
    """(cls, auc) of rows (cls, positive, score), by tie-averaged ranks; null where all rows are of one side."""
    per_score = scores.groupBy("cls", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("pos"))
    ranked = running(per_score, ["cls"], ["score"], ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("cls").agg(F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return sums.select("cls", S.safe_div(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """(cls, threshold, fpr, tpr) at every score."""
    per_score = scores.groupBy("cls", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    summed = running(per_score, ["cls"], [F.desc("score")], ["p", "q"])
    share = lambda c: S.safe_div((F.col(f"below_{c}") + F.col(c)).cast("double"), F.col(f"all_{c}"))
    return summed.select("cls", F.col("score").alias("threshold"), share("q").alias("fpr"), share("p").alias("tpr"))


def log_loss(p_truth: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean -ln p, optionally weighted."""
    loss = -F.log(p_truth)
    return F.avg(loss) if weight is None else S.safe_div(F.sum(weight * loss), F.sum(weight))
