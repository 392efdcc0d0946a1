"""Queries: ground truth, integrity, assertions, profiles, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators import audit as A
from tesserae.operators import curation as C
from tesserae.operators import features as V
from tesserae.operators import trees as H
from tesserae.plans.base import SAMPLES, SCORES, SPLIT, query, samples, split_samples, table, vectors
from tesserae.streaming import pipelines as P

R6 = lambda c: F.round(c, 6)

# a prediction of `quality` from the length, adjudicated by the labels
_ADJ = """adj AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN d.doc_id % 7 = 0 THEN 'DISPUTED' WHEN d.doc_id % 3 = 0 THEN 'SUPPORTED' ELSE 'VERIFIED' END AS status, CAST(l.quality AS BIGINT) AS truth,
  CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS pred, round(0.5 + 0.5 * (d.n_chars % 100) / 100.0, 6) AS confidence, round((d.n_chars % 50) / 100.0, 6) AS margin FROM documents d LEFT JOIN labels l USING (doc_id)),
sc AS (SELECT *, CASE WHEN status IN ('VERIFIED', 'SUPPORTED') THEN truth = pred END AS correct FROM adj)"""


def adjudicated(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("truth"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "UNKNOWN").when(F.col("doc_id") % 7 == 0, "DISPUTED").when(F.col("doc_id") % 3 == 0, "SUPPORTED").otherwise("VERIFIED")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", status.alias("status"), "truth", (F.col("n_chars") > 400).cast("int").alias("pred"), R6(0.5 + 0.5 * (F.col("n_chars") % 100) / 100.0).alias("confidence"), R6((F.col("n_chars") % 50) / 100.0).alias("margin"))
    return rows.withColumn("correct", F.when(F.col("status").isin("VERIFIED", "SUPPORTED"), F.col("truth") == F.col("pred")))


@query("adjudicated_scoring", f"WITH {_ADJ} SELECT doc_id, status, pred, correct FROM sc")
def adjudicated_scoring(spark, d):
    return adjudicated(spark, d).select("doc_id", "status", "pred", "correct")


@query("status_counts", f"WITH {_ADJ}, st(status) AS (VALUES ('VERIFIED'), ('SUPPORTED'), ('DISPUTED'), ('UNKNOWN')) SELECT st.status, count(doc_id) AS n FROM st LEFT JOIN adj USING (status) GROUP BY st.status")
def status_counts(spark, d):
    kinds = spark.createDataFrame([(s,) for s in ("VERIFIED", "SUPPORTED", "DISPUTED", "UNKNOWN")], "status string")
    return F.broadcast(kinds).join(adjudicated(spark, d).groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("directional_errors", f"WITH {_ADJ} SELECT truth, pred, count(*) AS n, count_if(truth <> pred) AS errors FROM sc WHERE correct IS NOT NULL GROUP BY truth, pred")
def directional_errors(spark, d):
    return adjudicated(spark, d).where("correct is not null").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") != F.col("pred")).alias("errors"))


@query("predicted_distribution", f"WITH {_ADJ} SELECT pred, count(*) AS n FROM adj GROUP BY pred")
def predicted_distribution(spark, d):
    return adjudicated(spark, d).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_summary", f"WITH {_ADJ} SELECT round(min(confidence), 6) AS min, round(max(confidence), 6) AS max, round(avg(confidence), 6) AS mean, round(avg(margin), 6) AS mean_margin, count_if(confidence >= 0.7) AS high, count_if(confidence < 0.7 AND margin < 0.25) AS ambiguous, count_if(confidence >= 0.7 AND correct = false) AS high_wrong, count_if(confidence < 0.7 AND correct) AS low_right FROM sc")
def confidence_summary(spark, d):
    c = F.col("confidence")
    band = S.confidence_band(c, F.col("margin"))
    return adjudicated(spark, d).agg(R6(F.min(c)).alias("min"), R6(F.max(c)).alias("max"), R6(F.avg(c)).alias("mean"), R6(F.avg("margin")).alias("mean_margin"), F.count_if(band == "high").alias("high"), F.count_if(band == "ambiguous").alias("ambiguous"), F.count_if((c >= 0.7) & ~F.col("correct")).alias("high_wrong"), F.count_if((c < 0.7) & F.col("correct")).alias("low_right"))


@query("decision_category", f"WITH {_ADJ}, n AS (SELECT count(correct) AS labelled, count_if(truth = 1 AND correct IS NOT NULL) AS n1, count_if(truth = 0 AND correct IS NOT NULL) AS n0, count_if(NOT correct AND truth = 1) AS e10, count_if(NOT correct AND truth = 0) AS e01, count(DISTINCT truth) FILTER (NOT correct) AS failing FROM sc) SELECT labelled, e10, e01, CASE WHEN labelled < 5 OR n1 < 2 OR n0 < 2 THEN 'A' WHEN e10 >= 2 OR e01 >= 2 THEN 'C' WHEN failing >= 3 THEN 'D' ELSE 'B' END AS category FROM n")
def decision_category(spark, d):
    ok, t = F.col("correct"), F.col("truth")
    n = adjudicated(spark, d).agg(F.count("correct").alias("labelled"), F.count_if((t == 1) & ok.isNotNull()).alias("n1"), F.count_if((t == 0) & ok.isNotNull()).alias("n0"), F.count_if(~ok & (t == 1)).alias("e10"), F.count_if(~ok & (t == 0)).alias("e01"), F.count_distinct(F.when(~ok, t)).alias("failing"))
    category = F.when(F.expr("labelled < 5 or n1 < 2 or n0 < 2"), "A").when(F.expr("e10 >= 2 or e01 >= 2"), "C").when(F.expr("failing >= 3"), "D").otherwise("B")
    return n.select("labelled", "e10", "e01", category.alias("category"))


@query("adjudication_rules", f"WITH {_ADJ} SELECT 'label_needs_evidence' AS rule, count_if(correct IS NOT NULL AND status NOT IN ('VERIFIED', 'SUPPORTED')) AS violations FROM sc UNION ALL SELECT 'status_known', count_if(status NOT IN ('VERIFIED', 'SUPPORTED', 'DISPUTED', 'UNKNOWN')) FROM sc UNION ALL SELECT 'unknown_has_no_truth', count_if(status = 'UNKNOWN' AND truth IS NOT NULL) FROM sc")
def adjudication_rules(spark, d):
    rules = {
        "label_needs_evidence": F.expr("correct is not null and status not in ('VERIFIED', 'SUPPORTED')"),
        "status_known": F.expr("status not in ('VERIFIED', 'SUPPORTED', 'DISPUTED', 'UNKNOWN')"),
        "unknown_has_no_truth": F.expr("status = 'UNKNOWN' and truth is not null"),
    }
    counts = adjudicated(spark, d).agg(*(F.count_if(bad).alias(n) for n, bad in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))))


@query("metadata_coverage", "WITH m AS (SELECT CASE WHEN doc_id % 4 = 0 THEN lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN source END AS source FROM documents) SELECT count(*) AS n, round(avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS lang, round(avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS source, round(avg(CASE WHEN lang IS NOT NULL OR source IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS anything FROM m")
def metadata_coverage(spark, d):
    m = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 6 == 0, F.col("source")).alias("source"))
    share = lambda c: R6(F.avg(c.cast("double")))
    has = {n: F.col(n).isNotNull() for n in ("lang", "source")}
    return m.agg(F.count(F.lit(1)).alias("n"), share(has["lang"]).alias("lang"), share(has["source"]).alias("source"), share(has["lang"] | has["source"]).alias("anything"))


# integrity
_AFTER = f"{SAMPLES}, before AS (SELECT sample_id, path, sha256 FROM samples WHERE sample_id % 13 <> 1), after AS (SELECT path, CASE WHEN sample_id % 11 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM samples WHERE sample_id % 17 <> 2)"


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = samples(spark, d)
    changed = F.when(F.col("sample_id") % 11 == 0, F.sha2(F.col("sha256").cast("binary"), 256)).otherwise(F.col("sha256"))
    return rows.where("sample_id % 13 <> 1").select("path", "sha256"), rows.where("sample_id % 17 <> 2").select("path", changed.alias("sha256"))


_DIFF = _AFTER + ", df AS (SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN b.sha256 = a.sha256 THEN 'unchanged' ELSE 'changed' END AS state FROM before b FULL JOIN after a USING (path))"


@query("tree_diff", f"WITH {_DIFF} SELECT path, state FROM df WHERE state <> 'unchanged'")
def tree_diff(spark, d):
    """The rows that differ between two snapshots, read from the leaves in which their hash trees differ."""
    return H.diff(*snapshots(spark, d), "path", "sha256", depth=2).select("path", "state")


@query("manifest_tree", f"WITH {SAMPLES}, l AS (SELECT sha256('=' || replace(path, '|', '\\|') || '|=' || sha256) AS line, substr(sha256('=' || replace(path, '|', '\\|')), 1, 2) AS place FROM samples), l2 AS (SELECT place, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY place), l1 AS (SELECT substr(place, 1, 1) AS up, sum(n) AS n, sha256(string_agg(place || '|' || digest, chr(10) ORDER BY place || '|' || digest)) AS digest FROM l2 GROUP BY 1), l0 AS (SELECT '' AS place, sum(n) AS n, sha256(string_agg(up || '|' || digest, chr(10) ORDER BY up || '|' || digest)) AS digest FROM l1) SELECT 2 AS level, place, CAST(n AS BIGINT) AS n, digest FROM l2 UNION ALL SELECT 1, up, CAST(n AS BIGINT), digest FROM l1 UNION ALL SELECT 0, place, CAST(n AS BIGINT), digest FROM l0")
def manifest_tree(spark, d):
    """All nodes of the hash tree of the samples, two levels deep."""
    return H.tree(samples(spark, d).select("path", "sha256"), ["path"], ["sha256"], depth=2)


@query("integrity_diff", f"WITH {_DIFF} SELECT path, state FROM df")
def integrity_diff(spark, d):
    return A.integrity_diff(*snapshots(spark, d), "path", "sha256").select("path", "state")


@query("assertion_suite", f"WITH {_DIFF}, {SPLIT[len(SAMPLES) + 2 :]} SELECT 'integrity' AS section, 'nothing_removed' AS \"check\", CASE WHEN count_if(state = 'removed') = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count_if(state = 'removed') || ' violations' AS detail FROM df UNION ALL SELECT 'integrity', 'nothing_changed', CASE WHEN count_if(state = 'changed') = 0 THEN 'PASS' ELSE 'FAIL' END, count_if(state = 'changed') || ' violations' FROM df UNION ALL SELECT 'split', 'every_row_has_a_side', CASE WHEN count_if(split NOT IN ('test', 'train')) = 0 THEN 'PASS' ELSE 'FAIL' END, count_if(split NOT IN ('test', 'train')) || ' violations' FROM split")
def assertion_suite(spark, d):
    diff = A.integrity_diff(*snapshots(spark, d), "path", "sha256")
    return A.assertions(
        A.assertion(diff, "integrity", "nothing_removed", F.col("state") == "removed"),
        A.assertion(diff, "integrity", "nothing_changed", F.col("state") == "changed"),
        A.assertion(split_samples(spark, d), "split", "every_row_has_a_side", ~F.col("split").isin("test", "train")),
    )


@query("evidence_log_rollup", "SELECT event_type AS method, CASE WHEN value < 10 THEN 'failed' WHEN value < 50 THEN 'weak' ELSE 'confirmed' END AS outcome, count(*) AS attempts, count(DISTINCT user_id) AS targets FROM events GROUP BY ALL")
def evidence_log_rollup(spark, d):
    outcome = F.when(F.col("value") < 10, "failed").when(F.col("value") < 50, "weak").otherwise("confirmed")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("user_id").alias("targets"))


@query("lineage_match", "WITH s AS (SELECT CAST(count(*) AS VARCHAR) AS n_rows, CAST(count(DISTINCT lang) AS VARCHAR) AS classes, CAST(sum(n_chars) AS VARCHAR) AS total FROM documents), e AS (SELECT CAST(count(*) AS VARCHAR) AS n_rows, CAST(count(DISTINCT lang) AS VARCHAR) AS classes, CAST(sum(n_chars) AS VARCHAR) AS total FROM documents WHERE doc_id % 10 <> 0) SELECT 'n_rows' AS field, s.n_rows AS stored, e.n_rows AS expected FROM s, e WHERE s.n_rows IS DISTINCT FROM e.n_rows UNION ALL SELECT 'classes', s.classes, e.classes FROM s, e WHERE s.classes IS DISTINCT FROM e.classes UNION ALL SELECT 'total', s.total, e.total FROM s, e WHERE s.total IS DISTINCT FROM e.total")
def lineage_match(spark, d):
    facts = lambda rows: rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("classes"), F.sum("n_chars").alias("total"))
    docs = table(spark, d, "documents")
    return A.column_mismatches(facts(docs), facts(docs.where("doc_id % 10 <> 0")), ["n_rows", "classes", "total"])


@query("image_manifest_profile", f"WITH {SAMPLES} SELECT class, count(*) AS files, min(strlen(text)) AS min_bytes, max(strlen(text)) AS max_bytes, round(avg(strlen(text)), 6) AS mean_bytes, count(*) - count(DISTINCT sha256) AS duplicates FROM samples GROUP BY class")
def image_manifest_profile(spark, d):
    n = F.octet_length("text").cast("long")
    return samples(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.min(n).alias("min_bytes"), F.max(n).alias("max_bytes"), R6(F.avg(n)).alias("mean_bytes"), (F.count(F.lit(1)) - F.count_distinct("sha256")).alias("duplicates"))


# streams
def arriving_files(spark, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern matches a single file and a folder alike."""
    return P.read(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def _scratch(spark) -> str:
    C.materialise(spark.range(0))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tesserae/{uuid.uuid4().hex}"


@query("stream_dedup", "SELECT count(DISTINCT sha256(text)) AS n_kept FROM documents")
def stream_dedup(spark, d):
    """Documents as a stream whose event time is its id in seconds after a fixed moment; the delay covers the table."""
    stream = arriving_files(spark, d, "documents")
    rows = stream.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("at"))
    out = _scratch(spark)
    P.run_available(P.dedup(rows, "sha256", "at", "3650 days"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("doc_id long, sha256 string").parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("n_kept"))


_BATCHES, _DELAY, _KEEP = 5, 100, 300


def _first_rows_sql() -> str:
    """Batch by batch, as the stream sees it: the watermark of the batches before, rows not later than it, digests not known; after a batch, what its own watermark lets go."""
    out = [f"""lim AS (SELECT max(doc_id) + 1 AS n FROM documents), a AS (SELECT sha256(text) AS sha, doc_id AS id, (doc_id * 1000) // n AS ts,
  CASE WHEN doc_id % 7 = 3 THEN {_BATCHES - 1} ELSE least((doc_id * {_BATCHES}) // n, {_BATCHES - 1}) END AS batch FROM documents, lim), alive0 AS (SELECT '' AS sha, 0 AS ts WHERE false)"""]
    for b in range(_BATCHES):
        mark, after = (f"coalesce((SELECT max(ts) FROM a WHERE batch < {k}) - {_DELAY}, -1)" for k in (b, b + 1))
        out.append(f"new{b} AS (SELECT sha, arg_min(id, ts * 1000000000000 + id) AS id, min(ts) AS ts FROM a WHERE batch = {b} AND ts > {mark} AND sha NOT IN (SELECT sha FROM alive{b}) GROUP BY sha)")
        out.append(f"alive{b + 1} AS (SELECT sha, ts FROM (SELECT * FROM alive{b} UNION ALL SELECT sha, ts FROM new{b}) WHERE ts + {_KEEP} > {after})")
    rows = " UNION ALL ".join(f"SELECT sha AS sha256, id, CAST({b} AS INTEGER) AS batch FROM new{b}" for b in range(_BATCHES))
    return f"WITH {', '.join(out)} SELECT sha256, id FROM ({rows})"


@query("stream_first_rows", _first_rows_sql())
def stream_first_rows(spark, d):
    """Documents in five batches by id, every seventh in the last one: there most are late and dropped, and digests that the state has let go come again."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    batch = F.when(F.col("doc_id") % 7 == 3, _BATCHES - 1).otherwise(F.least(F.floor(F.col("doc_id") * _BATCHES / n), F.lit(_BATCHES - 1)))
    rows = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").cast("long").alias("id"), F.timestamp_seconds(F.floor(F.col("doc_id") * 1000 / n) + 1_700_000_000).alias("at"), batch.cast("int").alias("batch"))
    out = _scratch(spark)
    rows = C.materialise(rows)
    for b in range(_BATCHES):
        rows.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{out}/arrived")
        with P.rocksdb(spark):
            P.run_available(P.first_rows(P.read(spark, f"{out}/arrived", rows.drop("batch").schema, 1_000_000), f"{_DELAY} seconds", _KEEP), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("sha256 string, id long, at timestamp").parquet(f"{out}/rows").select("sha256", "id")


@query("stream_leak_gate", f"WITH {SPLIT} SELECT CASE WHEN t.class = r.class THEN 'exact' ELSE 'cross_class_exact' END AS kind, t.class AS cls, t.path AS test_path, r.path AS train_path, t.sha256 FROM samples t JOIN split r ON r.split = 'train' AND r.sha256 = t.sha256 WHERE t.sample_id % 5 = 0")
def stream_leak_gate(spark, d):
    """Every arriving copy with every training copy."""
    return gated(spark, d, P.leak_pairs)[0]


def gated(spark, d, gate=P.leak_gate) -> tuple[DataFrame, DataFrame]:
    """What the gate writes of the arriving rows, and the training rows."""
    docs = arriving_files(spark, d, "documents")
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    arriving = docs.where("doc_id % 5 = 0").select(F.col("source").alias("class"), F.concat("source", F.lit("/"), name).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    known = C.materialise(split_samples(spark, d).where("split = 'train'").select("sha256", "class", "path"))
    hits = gate(arriving, known)
    out = _scratch(spark)
    P.run_available(hits, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(hits.schema).parquet(f"{out}/rows"), known


@query("stream_leak_members", f"WITH {SPLIT} SELECT class AS train_cls, path AS train_path, sha256 FROM split WHERE split = 'train' AND sha256 IN (SELECT sha256 FROM samples WHERE sample_id % 5 = 0)")
def stream_leak_members(spark, d):
    """The training rows that arriving copies have, from the folded form of the gate."""
    return P.leak_members(*gated(spark, d))


@query("stream_score", f"WITH {SCORES} SELECT id, truth, pred, round(confidence, 6) AS confidence FROM scored")
def stream_score(spark, d):
    model = [tuple(r) for r in V.centroids(vectors(spark, d)).orderBy("cls").collect()]  # classes x dimensions
    stream = arriving_files(spark, d, "embeddings")
    rows = stream.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    scored = P.score(rows, model)
    out = _scratch(spark)
    P.run_batches(scored, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(scored.schema).parquet(f"{out}/rows").select("id", "truth", "pred", R6("confidence").alias("confidence"))
