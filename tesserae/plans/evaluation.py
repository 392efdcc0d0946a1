"""Queries: prediction tables, metrics, histories, probability checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators import audit as A
from tesserae.operators import curation as C
from tesserae.operators import evaluation as E
from tesserae.operators import features as V
from tesserae.plans.base import SCORES, query, table, vectors

R6 = lambda c: F.round(c, 6)


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return V.score(rows, C.materialise(V.centroids(rows)))


def predictions(spark, d) -> DataFrame:
    return C.materialise(scored(spark, d).select("id", "truth", "pred", "confidence", "second", "second_p", "margin"))


def class_scores(spark, d) -> DataFrame:
    """(cls, positive, score), one row per class and prediction."""
    rows = scored(spark, d).select("truth", F.inline(F.arrays_zip(F.col("classes").alias("cls"), F.col("probabilities").alias("p"))))
    return rows.select("cls", (F.col("cls") == F.col("truth")).alias("positive"), F.round("p", 9).alias("score"))


def classes(spark, d) -> DataFrame:
    return vectors(spark, d).select(F.col("label").alias("cls")).distinct()


@query("score_table", f"WITH {SCORES} SELECT id, truth, pred, round(confidence, 6) AS confidence, pred = 0 AS is_rejection, 'class ' || pred AS label FROM scored")
def score_table(spark, d):
    return scored(spark, d).select("id", "truth", "pred", R6("confidence").alias("confidence"), (F.col("pred") == 0).alias("is_rejection"), F.concat(F.lit("class "), F.col("pred").cast("string")).alias("label"))


@query("softmax", f"WITH {SCORES} SELECT id, cls, round(p, 6) AS p FROM probabilities")
def softmax(spark, d):
    return scored(spark, d).select("id", F.inline(F.arrays_zip(F.col("classes").alias("cls"), F.col("probabilities").alias("p")))).select("id", "cls", R6("p").alias("p"))


@query("top1", f"WITH {SCORES} SELECT id, pred, round(confidence, 6) AS confidence FROM scored")
def top1(spark, d):
    return scored(spark, d).select("id", "pred", R6("confidence").alias("confidence"))


@query("top2_margin", f"WITH {SCORES} SELECT id, second, round(second_p, 6) AS second_p, round(margin, 6) AS margin FROM scored")
def top2_margin(spark, d):
    return scored(spark, d).select("id", "second", R6("second_p").alias("second_p"), R6("margin").alias("margin"))


@query("rank_probabilities", f"WITH {SCORES} SELECT id, rk AS rank, cls, round(p, 6) AS p, rk = 1 AS predicted FROM ordered")
def rank_probabilities(spark, d):
    order = S.ranked(F.col("probabilities"))
    rows = scored(spark, d).select("id", "classes", F.posexplode(order).alias("k", "s"))
    return rows.select("id", (F.col("k") + 1).cast("long").alias("rank"), F.get("classes", F.col("s.index")).alias("cls"), R6("s.value").alias("p"), (F.col("k") == 0).alias("predicted"))


@query("confidence_band", f"WITH {SCORES} SELECT id, CASE WHEN confidence >= 0.107 THEN 'high' WHEN margin < 0.001 THEN 'ambiguous' ELSE 'moderate' END AS band FROM scored")
def confidence_band(spark, d):
    return scored(spark, d).select("id", S.confidence_band(F.col("confidence"), F.col("margin"), 0.107, 0.001).alias("band"))


@query("sigmoid", f"WITH {SCORES} SELECT id, cls, round(1 / (1 + exp(-10 * cos)), 6) AS s FROM cosines")
def sigmoid(spark, d):
    return scored(spark, d).select("id", F.inline("cosines")).select("id", "cls", R6(S.sigmoid(F.col("cos") * 10)).alias("s"))


@query("probability_sum_check", f"WITH {SCORES} SELECT id, round(sum(p), 6) AS probability_sum, abs(sum(p) - 1) > 1e-6 AS deviates FROM probabilities GROUP BY id")
def probability_sum_check(spark, d):
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return scored(spark, d).select("id", R6(total).alias("probability_sum"), (F.abs(total - 1) > 1e-6).alias("deviates"))


_CONF = SCORES + ", classes AS (SELECT DISTINCT label AS cls FROM v), cm AS (SELECT a.cls AS truth, b.cls AS pred, count(s.id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN scored s ON s.truth = a.cls AND s.pred = b.cls GROUP BY ALL)"


def confusion(spark, d, keep=None) -> DataFrame:
    rows = predictions(spark, d)
    return E.confusion_matrix(rows if keep is None else rows.where(keep), classes(spark, d))


@query("confusion_matrix", f"WITH {_CONF} SELECT truth, pred, n FROM cm")
def confusion_matrix(spark, d):
    return confusion(spark, d)


@query("confusion_normalised", f"WITH {_CONF} SELECT truth, pred, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM cm")
def confusion_normalised(spark, d):
    return E.normalised(confusion(spark, d)).select("truth", "pred", R6("share").alias("share"))


@query("accuracy", f"WITH {SCORES} SELECT count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored")
def accuracy(spark, d):
    return predictions(spark, d).agg(F.count(F.lit(1)).alias("n"), R6(F.avg((F.col("truth") == F.col("pred")).cast("double"))).alias("accuracy"))


#: Class 3 has no truth rows here, and class 7 is never predicted: both null policies show.
_KEEP = "truth <> 3 AND pred <> 7"
_CONF_KEEP = SCORES + f", classes AS (SELECT DISTINCT label AS cls FROM v), sk AS (SELECT * FROM scored WHERE {_KEEP}), cm AS (SELECT a.cls AS truth, b.cls AS pred, count(s.id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN sk s ON s.truth = a.cls AND s.pred = b.cls GROUP BY ALL)"
_PRF = _CONF_KEEP + """, tot AS (SELECT c.cls, (SELECT sum(n) FROM cm WHERE truth = c.cls) AS support, (SELECT sum(n) FROM cm WHERE pred = c.cls) AS predicted, (SELECT sum(n) FROM cm WHERE truth = c.cls AND pred = c.cls) AS tp FROM classes c),
pr AS (SELECT cls, CAST(support AS BIGINT) AS support, CASE WHEN support > 0 THEN coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) END AS p, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / nullif(predicted, 0) END AS strict_p, CAST(tp AS DOUBLE) / nullif(support, 0) AS r FROM tot),
prf AS (SELECT *, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CASE WHEN strict_p IS NULL OR r IS NULL THEN NULL WHEN strict_p + r > 0 THEN 2 * strict_p * r / (strict_p + r) ELSE 0 END AS strict_f1 FROM pr)"""
_PRF_OUT = lambda rows: rows.select("cls", "support", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


@query("prf_per_class", f"WITH {_PRF} SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def prf_per_class(spark, d):
    return _PRF_OUT(E.per_class(confusion(spark, d, _KEEP)))


@query("prf_strict_null", f"WITH {_PRF} SELECT cls, support, round(strict_p, 6) AS precision, round(r, 6) AS recall, round(strict_f1, 6) AS f1 FROM prf")
def prf_strict_null(spark, d):
    return _PRF_OUT(E.per_class(confusion(spark, d, _KEEP), strict=True))


@query("balanced_accuracy", f"WITH {_PRF} SELECT round(avg(r), 6) AS balanced_accuracy, count(r) AS classes_with_truth FROM prf")
def balanced_accuracy(spark, d):
    return E.per_class(confusion(spark, d, _KEEP)).agg(R6(F.avg("recall")).alias("balanced_accuracy"), F.count("recall").alias("classes_with_truth"))


@query("macro_weighted", f"WITH {_PRF} SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support) FILTER (f1 IS NOT NULL), 6) AS weighted_f1 FROM prf")
def macro_weighted(spark, d):
    out = E.macro_weighted(E.per_class(confusion(spark, d, _KEEP)))
    return out.select(*(R6(c).alias(c) for c in out.columns))


@query("safe_div", f"WITH {_PRF} SELECT cls, round(strict_p, 6) AS ratio FROM prf")
def safe_div(spark, d):
    return E.per_class(confusion(spark, d, _KEEP), strict=True).select("cls", R6("precision").alias("ratio"))


@query("format_value", f"WITH {_PRF} SELECT cls, coalesce(printf('%.4f', strict_p), 'N/A') AS precision_text, coalesce(printf('%.3f%%', r * 100), 'N/A') AS recall_text FROM prf")
def format_value(spark, d):
    rows = E.per_class(confusion(spark, d, _KEEP), strict=True)
    return rows.select("cls", F.when(F.col("precision").isNull(), "N/A").otherwise(S.format_value(F.col("precision"))).alias("precision_text"), F.when(F.col("recall").isNull(), "N/A").otherwise(S.format_percent(F.col("recall"))).alias("recall_text"))


@query("write_classification_report", f"WITH {_PRF} SELECT CAST(cls AS VARCHAR) AS name, coalesce(printf('%.4f', p), 'N/A') AS precision, coalesce(printf('%.4f', r), 'N/A') AS recall, coalesce(printf('%.4f', f1), 'N/A') AS f1, CAST(support AS VARCHAR) AS support FROM prf UNION ALL SELECT 'macro_f1', 'N/A', 'N/A', printf('%.4f', avg(f1)), 'N/A' FROM prf")
def write_classification_report(spark, d):
    text = lambda c: F.when(F.col(c).isNull(), "N/A").otherwise(S.format_value(F.col(c))).alias(c)
    rows = C.materialise(E.per_class(confusion(spark, d, _KEEP)))
    block = rows.select(F.col("cls").cast("string").alias("name"), text("precision"), text("recall"), text("f1"), F.col("support").cast("string").alias("support"))
    na = F.lit("N/A")
    scalar = E.macro_weighted(rows).select(F.lit("macro_f1").alias("name"), na.alias("precision"), na.alias("recall"), S.format_value(F.col("macro_f1")).alias("f1"), na.alias("support"))
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/tesserae/{uuid.uuid4().hex}"
    block.unionByName(scalar).write.csv(path, header=True)
    return spark.read.schema("name string, precision string, recall string, f1 string, support string").csv(path, header=True)


_CS = SCORES + ", cs AS (SELECT cls, cls = truth AS positive, round(p, 9) AS score FROM probabilities)"


@query("auc_ovr", f"WITH {_CS}, r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM cs) SELECT cls, round((sum(rk) FILTER (positive) - count_if(positive) * (count_if(positive) + 1) / 2.0) / nullif(count_if(positive) * count_if(NOT positive), 0), 6) AS auc FROM r GROUP BY cls")
def auc_ovr(spark, d):
    return E.auc_one_vs_rest(class_scores(spark, d)).select("cls", R6("auc").alias("auc"))


@query("roc_curve", f"WITH {_CS}, g AS (SELECT cls, score, count_if(positive) AS p, count_if(NOT positive) AS q FROM cs GROUP BY ALL) SELECT cls, score AS threshold, round(sum(q) OVER w / sum(q) OVER (PARTITION BY cls), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY cls), 6) AS tpr FROM g WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def roc_curve(spark, d):
    return E.roc_curve(class_scores(spark, d)).select("cls", "threshold", R6("fpr").alias("fpr"), R6("tpr").alias("tpr"))


@query("confidence_box", f"WITH {SCORES} SELECT cls, count(*) AS n, round(quantile_cont(p, 0.0), 6) AS q0, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75, round(quantile_cont(p, 1.0), 6) AS q100 FROM probabilities WHERE cls = truth GROUP BY cls")
def confidence_box(spark, d):
    rows = scored(spark, d).select("truth", F.inline(F.arrays_zip(F.col("classes").alias("cls"), F.col("probabilities").alias("p")))).where("cls = truth")
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *(R6(F.percentile("p", F.lit(q / 100))).alias(f"q{q}") for q in (0, 25, 50, 75, 100)))


@query("class_weights", f"WITH {SCORES}, c AS (SELECT truth AS cls, count(*) AS n FROM scored GROUP BY truth) SELECT cls, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, d):
    counts = vectors(spark, d).groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(total)).select("cls", "n", R6(F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


@query("log_loss", f"WITH {SCORES}, w AS (SELECT truth, count(*) AS n FROM scored GROUP BY truth), t AS (SELECT p.*, 500.0 / w.n AS wt FROM probabilities p JOIN w USING (truth)), s AS (SELECT id, sum(-ln(p)) / count(*) AS all_nll FROM probabilities GROUP BY id) SELECT round(avg(-ln(p)), 6) AS loss, round(sum(wt * -ln(p)) / sum(wt), 6) AS weighted_loss, round(avg(0.9 * -ln(p) + 0.1 * all_nll), 6) AS smoothed_loss FROM t JOIN s USING (id) WHERE cls = truth")
def log_loss(spark, d):
    rows = scored(spark, d)
    n = rows.groupBy("truth").agg((F.lit(500.0) / F.count(F.lit(1))).alias("wt"))
    p = F.try_element_at(F.map_from_arrays("classes", "probabilities"), F.col("truth"))
    every = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a - F.log(x)) / F.size("probabilities")
    joined = rows.join(F.broadcast(n), "truth").select(p.alias("p"), "wt", every.alias("every"))
    return joined.agg(R6(E.log_loss(F.col("p"))).alias("loss"), R6(E.log_loss(F.col("p"), F.col("wt"))).alias("weighted_loss"), R6(F.avg(-0.9 * F.log("p") + 0.1 * F.col("every"))).alias("smoothed_loss"))


_PRF_ALL = _PRF.replace(_CONF_KEEP, _CONF) + _CS.removeprefix(SCORES)


@query("evaluate", f"""WITH {_PRF_ALL}, rk AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM cs),
auc AS (SELECT cls, (sum(rk) FILTER (positive) - count_if(positive) * (count_if(positive) + 1) / 2.0) / nullif(count_if(positive) * count_if(NOT positive), 0) AS auc FROM rk GROUP BY cls),
per AS (SELECT cls, p, r, f1, CAST(support AS DOUBLE) AS support, auc FROM prf JOIN auc USING (cls)),
lines AS (SELECT 'accuracy' AS metric, NULL AS cls, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS value FROM scored
UNION ALL SELECT 'mean_confidence', NULL, avg(confidence) FROM scored
UNION ALL SELECT 'balanced_accuracy', NULL, avg(r) FROM per UNION ALL SELECT 'macro_precision', NULL, avg(p) FROM per UNION ALL SELECT 'macro_recall', NULL, avg(r) FROM per UNION ALL SELECT 'macro_f1', NULL, avg(f1) FROM per
UNION ALL SELECT 'weighted_f1', NULL, sum(f1 * support) / sum(support) FILTER (f1 IS NOT NULL) FROM per
UNION ALL SELECT 'precision', cls, p FROM per UNION ALL SELECT 'recall', cls, r FROM per UNION ALL SELECT 'f1', cls, f1 FROM per UNION ALL SELECT 'support', cls, support FROM per UNION ALL SELECT 'auc', cls, auc FROM per)
SELECT metric, cls, round(value, 6) AS value FROM lines""")
def evaluate(spark, d):
    """Every metric as a line (metric, cls, value); cls is null for metrics of all classes."""
    rows = C.materialise(predictions(spark, d))
    per = E.per_class(E.confusion_matrix(rows, classes(spark, d))).hint("shuffle_merge").join(E.auc_one_vs_rest(class_scores(spark, d)).hint("shuffle_merge"), "cls", "left")
    per = C.materialise(per)
    whole = rows.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    whole = whole.join(F.broadcast(E.macro_weighted(per))).withColumn("balanced_accuracy", F.col("macro_recall"))  # one row each
    line = lambda name, cls, value: F.struct(F.lit(name).alias("metric"), cls.alias("cls"), R6(value.cast("double")).alias("value"))
    names = ("accuracy", "mean_confidence", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")
    both = whole.select(F.inline(F.array(*(line(n, F.lit(None).cast("long"), F.col(n)) for n in names))))
    return both.unionByName(per.select(F.inline(F.array(*(line(n, F.col("cls"), F.col(n)) for n in ("precision", "recall", "f1", "support", "auc"))))))


# histories: one epoch a day of events
def history(spark, d) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.lit(1.0) - F.avg((F.col("event_type") == "error").cast("double")), 6).alias("val_acc"), F.round(F.avg("value"), 6).alias("loss"))
    first = days.agg(F.min("day").alias("first"))
    return days.join(F.broadcast(first)).select((F.datediff("day", "first") + 1).cast("long").alias("epoch"), "val_acc", "loss")


_HIST = "days AS (SELECT CAST(ts AS DATE) AS day, round(1.0 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS val_acc, round(avg(value), 6) AS loss FROM events GROUP BY 1), hist AS (SELECT CAST(date_diff('day', (SELECT min(day) FROM days), day) + 1 AS BIGINT) AS epoch, val_acc, loss FROM days)"
_BEST = _HIST + """, b AS (SELECT *, greatest(coalesce(max(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS best_before FROM hist),
i AS (SELECT *, loss > best_before AS improved FROM b), st AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch), (SELECT min(epoch) FROM hist) - 1) AS stale FROM i)"""


@query("running_best", f"WITH {_BEST} SELECT epoch, round(best_before, 6) AS best_before, improved FROM st")
def running_best(spark, d):
    return A.running_best(history(spark, d), "epoch", "loss", 5).select("epoch", R6("best_before").alias("best_before"), "improved")


@query("epochs_without_improvement", f"WITH {_BEST} SELECT epoch, stale FROM st")
def epochs_without_improvement(spark, d):
    return A.running_best(history(spark, d), "epoch", "loss", 5).select("epoch", "stale")


@query("early_stop_point", f"WITH {_BEST}, x AS (SELECT min(epoch) AS stop FROM st WHERE stale >= 5) SELECT epoch, loss, improved FROM st, x WHERE stop IS NULL OR epoch <= stop")
def early_stop_point(spark, d):
    return A.running_best(history(spark, d), "epoch", "loss", 5).where("stop_epoch is null or epoch <= stop_epoch").select("epoch", "loss", "improved")


@query("write_history", f"WITH {_HIST} SELECT epoch, printf('%.6f', val_acc) AS val_acc, printf('%.6f', loss) AS loss FROM hist")
def write_history(spark, d):
    rows = C.materialise(history(spark, d))
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/tesserae/{uuid.uuid4().hex}"
    rows.select("epoch", F.format_string("%.6f", "val_acc").alias("val_acc"), F.format_string("%.6f", "loss").alias("loss")).orderBy("epoch").write.csv(path, header=True)
    return spark.read.schema("epoch long, val_acc string, loss string").csv(path, header=True)


@query("epoch_aggregate", "WITH b AS (SELECT user_id % 50 AS batch, user_id % 3 = 0 AS mixed, count(*) AS n, avg(value) AS loss, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS acc FROM events GROUP BY ALL) SELECT round(sum(loss * n) / sum(n), 6) AS loss, round(sum(acc * n) FILTER (NOT mixed) / sum(n) FILTER (NOT mixed), 6) AS acc_clean, round(sum(acc * n) FILTER (mixed) / sum(n) FILTER (mixed), 6) AS acc_mixed, count_if(mixed) AS mixed_batches, count(*) AS batches FROM b")
def epoch_aggregate(spark, d):
    batches = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("batch"), (F.col("user_id") % 3 == 0).alias("mixed")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("loss"), F.avg((F.col("event_type") != "error").cast("double")).alias("acc"))
    weighted = lambda keep: S.safe_div(F.sum(F.when(keep, F.col("acc") * F.col("n"))), F.sum(F.when(keep, F.col("n"))))
    return batches.agg(R6(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), R6(weighted(~F.col("mixed"))).alias("acc_clean"), R6(weighted(F.col("mixed"))).alias("acc_mixed"), F.count_if("mixed").alias("mixed_batches"), F.count(F.lit(1)).alias("batches"))
