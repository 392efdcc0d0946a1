"""Queries: scans and sinks, labels, hashes, deduplication, groups, splits, leakage, validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators import audit as A
from tesserae.operators import build as B
from tesserae.operators import curation as C
from tesserae.plans.base import GROUPS, HASHED, NEAR, SAMPLES, SPLIT, hashed, query, samples, split_samples, table
from tesserae.sources import files
from tesserae.sources.tree import ClassTree

R6 = lambda c: F.round(c, 6)
ALIASES = {"en": "English", "english": "English", "fr": "French", "francais": "French", "de": "German", "german": "German"}
_ALIAS_SQL = "aliases(alias, canonical) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in sorted(ALIASES.items())) + ")"
#: Labels with noise: case, blanks, a prefix, and one language that no alias knows.
_RAW = lambda: F.expr("CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN concat('  ', lang, ' ') WHEN 2 THEN concat('Crop ', lang) ELSE lang END")
_RAW_SQL = "raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN '  ' || lang || ' ' WHEN 2 THEN 'Crop ' || lang ELSE lang END AS raw FROM documents)"
_KEY_SQL = "regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', '_', 'g'), '^_+|_+$', '', 'g')"
_LABELS_SQL = f"""{_RAW_SQL}, {_ALIAS_SQL}, keyed AS (SELECT doc_id, raw, {_KEY_SQL} AS label_key FROM raw),
labels_of AS (SELECT k.doc_id, k.raw, k.label_key, coalesce(a.canonical, b.canonical) AS canonical FROM keyed k LEFT JOIN aliases a ON k.label_key = a.alias LEFT JOIN aliases b ON regexp_replace(regexp_replace(label_key, 'crop', '', 'g'), '^_+', '') = b.alias)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _RAW().alias("raw"))
    return C.normalise_labels(rows, "raw", C.alias_table(spark, ALIASES), "crop")


def _out(spark: SparkSession) -> str:
    C.materialise(spark.range(0))  # sets a checkpoint folder where there is none
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tesserae/{uuid.uuid4().hex}"


# scans, sources, sinks
@query("scan_samples", f"WITH {SAMPLES}, f AS (SELECT CASE WHEN sample_id % 3 = 0 THEN upper(path) WHEN sample_id % 3 = 1 THEN path ELSE replace(path, '.txt', '.bin') END AS path FROM samples) SELECT path, lower(regexp_extract(path, '\\.[^.]+$')) AS extension FROM f WHERE lower(regexp_extract(path, '\\.[^.]+$')) IN ('.txt', '.md')")
def scan_samples(spark, d):
    path = F.expr("CASE WHEN sample_id % 3 = 0 THEN upper(path) WHEN sample_id % 3 = 1 THEN path ELSE replace(path, '.txt', '.bin') END")
    return files.with_extension(samples(spark, d).select(path.alias("path")), "path", [".txt", ".md"]).orderBy(F.lower("path"))


@query("collect_sources", f"WITH {SPLIT} SELECT sample_id, class AS label, split AS source_group FROM split UNION ALL SELECT page_id AS sample_id, 'rejected' AS label, 'pool' AS source_group FROM pages")
def collect_sources(spark, d):
    s = split_samples(spark, d).select("sample_id", F.col("class").alias("label"), F.col("split").alias("source_group"))
    return files.collect_sources({"tree": s}, {"rejected": table(spark, d, "pages").select(F.col("page_id").alias("sample_id"))})


@query("scan_split_tree", f"""WITH {SPLIT}, p AS (SELECT split || '/' || path AS path FROM split), c AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS BIGINT) AS class_idx FROM (SELECT DISTINCT class FROM samples))
SELECT path, split_part(path, '/', 1) AS split, split_part(path, '/', 2) AS class, split_part(path, '/', 3) AS filename, class_idx FROM p JOIN c ON split_part(path, '/', 2) = c.class""")
def scan_split_tree(spark, d):
    tree = split_samples(spark, d).select(F.concat("split", F.lit("/"), "path").alias("path"))
    return files.split_tree(tree, "path").join(F.broadcast(class_index(samples(spark, d))), "class")


def class_index(rows: DataFrame) -> DataFrame:
    """The class dimension in its fixed order."""
    names = rows.select("class").distinct()
    return names.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("long").alias("class_idx"))


@query("read_manifest", f"WITH {SPLIT} SELECT path, split, class, CASE WHEN sample_id % 2 = 0 THEN 'stored' ELSE 'computed' END AS origin, sha256 FROM split")
def read_manifest(spark, d):
    rows = split_samples(spark, d)
    path = _out(spark)
    files.write_manifest(rows.where("sample_id % 2 = 0").select("split", "class", "filename", "sha256"), path)
    stored = files.read_manifest(spark, path)
    joined = rows.drop("sha256").join(stored, ["split", "class", "filename"], "left")
    return joined.select("path", "split", "class", F.when(F.col("sha256").isNotNull(), "stored").otherwise("computed").alias("origin"), F.coalesce("sha256", F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))


@query("write_manifest", f"WITH {SPLIT} SELECT split, class, filename, sha256 FROM split")
def write_manifest(spark, d):
    path = _out(spark)
    files.write_manifest(split_samples(spark, d).select("split", "class", "filename", "sha256"), path)
    return files.read_manifest(spark, path)


@query("write_duplicates_audit", f"WITH {SAMPLES}, k AS (SELECT *, first_value(path) OVER w AS kept_path, first_value(class) OVER w AS kept_class, row_number() OVER w AS rn FROM samples WINDOW w AS (PARTITION BY sha256 ORDER BY sample_id)) SELECT sha256, kept_path, kept_class, path AS removed_path, class AS removed_class, kept_class <> class AS cross_class FROM k WHERE rn > 1")
def write_duplicates_audit(spark, d):
    path = _out(spark)
    audit = C.dedup_audit(samples(spark, d), "sha256", ["sample_id"], "path", "class")
    audit.write.csv(path, header=True)
    return spark.read.schema(audit.schema).csv(path, header=True)


_DEDUP_SQL = f"WITH {SAMPLES}, k AS (SELECT *, first_value(class) OVER w AS kept_class, row_number() OVER w AS rn FROM samples WINDOW w AS (PARTITION BY sha256 ORDER BY sample_id))"
_SUMMARY = "count(*) AS raw, count(*) - count(sha256) AS unreadable, count_if(rn > 1) AS removed, count_if(rn > 1 AND kept_class <> class) AS cross_class_removed, count(DISTINCT sha256) AS uniq"


def dedup_counts(spark, d) -> DataFrame:
    rows = samples(spark, d)
    kept = C.dedup_first(rows.select("sha256", "sample_id", "class"), "sha256", ["sample_id"]).select("sha256", F.col("class").alias("kept_class"), F.col("sample_id").alias("kept_id"))
    joined = rows.select("sha256", "sample_id", "class").join(kept, "sha256", "left")
    removed = F.col("sample_id") != F.col("kept_id")
    return joined.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("sha256").isNull()).alias("unreadable"), F.count_if(removed).alias("removed"), F.count_if(removed & (F.col("kept_class") != F.col("class"))).alias("cross_class_removed"), F.count_if(~removed).alias("uniq"))


@query("dedup_summary", f"{_DEDUP_SQL} SELECT {_SUMMARY} FROM k")
def dedup_summary(spark, d):
    return dedup_counts(spark, d)


@query("write_dataset_report", f"{_DEDUP_SQL}, s AS (SELECT {_SUMMARY} FROM k) UNPIVOT (SELECT CAST(raw AS VARCHAR) AS raw, CAST(unreadable AS VARCHAR) AS unreadable, CAST(removed AS VARCHAR) AS removed, CAST(cross_class_removed AS VARCHAR) AS cross_class_removed, CAST(uniq AS VARCHAR) AS uniq FROM s) ON raw, unreadable, removed, cross_class_removed, uniq INTO NAME metric VALUE value")
def write_dataset_report(spark, d):
    path = _out(spark)
    C.unpivot_metrics(dedup_counts(spark, d), ["raw", "unreadable", "removed", "cross_class_removed", "uniq"]).coalesce(1).write.csv(path, header=True)
    return spark.read.schema("metric string, value string").csv(path, header=True)


@query("report_lookup", f"{_DEDUP_SQL} SELECT 'removed' AS metric, CAST(count_if(rn > 1) AS VARCHAR) AS value FROM k UNION ALL SELECT 'absent', NULL")
def report_lookup(spark, d):
    report = C.unpivot_metrics(dedup_counts(spark, d), ["raw", "removed"])
    wanted = spark.createDataFrame([("removed",), ("absent",)], "metric string")
    return F.broadcast(wanted).join(report, "metric", "left")


_LEAKS_SQL = SPLIT + """, t AS (SELECT * FROM split WHERE split = 'test' AND sha256 <> ''), r AS (SELECT * FROM split WHERE split = 'train'),
exact AS (SELECT CASE WHEN t.class = r.class THEN 'exact' ELSE 'cross_class_exact' END AS kind, t.class AS cls, t.path AS test_path, min(r.path) AS train_path, count(*) AS n_train, CAST(NULL AS INTEGER) AS distance, t.sha256 FROM t JOIN r USING (sha256) GROUP BY t.class, r.class, t.path, t.sha256)"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = split_samples(spark, d)
    return rows.where("split = 'test'"), rows.where("split = 'train'")


@query("leak_exact", f"WITH {_LEAKS_SQL} SELECT * FROM exact WHERE kind = 'exact'")
def leak_exact(spark, d):
    return A.exact_leaks(*sides(spark, d)).where("kind = 'exact'")


@query("leak_cross_class", f"WITH {_LEAKS_SQL} SELECT * FROM exact WHERE kind = 'cross_class_exact'")
def leak_cross_class(spark, d):
    return A.exact_leaks(*sides(spark, d)).where("kind = 'cross_class_exact'")


@query("write_leakage_report", f"WITH {_LEAKS_SQL} SELECT * FROM exact ORDER BY CASE kind WHEN 'cross_class_exact' THEN 0 ELSE 1 END, cls, test_path, train_path LIMIT 20000")
def write_leakage_report(spark, d):
    path = _out(spark)
    hits = A.exact_leaks(*sides(spark, d))
    ordered = hits.orderBy(A.severity(F.col("kind")), "cls", "test_path", "train_path").limit(20_000)  # the report is capped by design
    ordered.write.mode("overwrite").csv(path, header=True)
    return spark.read.schema(hits.schema).csv(path, header=True)


_FILE_SQL = SPLIT + """, f AS (SELECT *, class || '.txt' AS shared FROM split), first AS (SELECT shared, arg_min(path, path) AS train_path, arg_min(sha256, path) AS train_sha FROM f WHERE split = 'train' GROUP BY shared),
named AS (SELECT 'filename' AS kind, class AS cls, path AS test_path, train_path, CAST(1 AS BIGINT) AS n_train, CAST(NULL AS INTEGER) AS distance, CAST(NULL AS VARCHAR) AS sha256 FROM f JOIN first USING (shared) WHERE split = 'test' AND f.sha256 <> train_sha)"""


@query("leak_filename", f"WITH {_FILE_SQL} SELECT * FROM named")
def leak_filename(spark, d):
    test, train = (x.withColumn("filename", F.concat("class", F.lit(".txt"))) for x in sides(spark, d))
    return A.filename_leaks(test, train)


@query("suppress_exact", f"WITH {SPLIT} SELECT path, class FROM split WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM split WHERE split = 'train')")
def suppress_exact(spark, d):
    return A.without_exact(*sides(spark, d)).select("path", "class")


def hashed_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    h = hashed(spark, d).select(F.col("id").alias("sample_id"), "h")
    rows = C.materialise(split_samples(spark, d).select("sample_id", F.col("lang").alias("class"), "path", "sha256", "split").join(h, "sample_id"))
    return rows.where("split = 'test'"), rows.where("split = 'train'")


_NEAR_LEAK_SQL = f"""{HASHED}, {SPLIT}, hs AS (SELECT s.*, h.h FROM split s JOIN hashed h ON s.sample_id = h.id),
q AS (SELECT * FROM hs WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM hs WHERE split = 'train')),
m AS (SELECT q.lang AS cls, q.path AS test_path, r.path AS train_path, CAST(bit_count(xor(q.h, r.h)) AS INTEGER) AS distance, row_number() OVER (PARTITION BY q.path ORDER BY bit_count(xor(q.h, r.h)), r.path) AS rn FROM q JOIN hs r ON r.split = 'train' AND r.lang = q.lang AND bit_count(xor(q.h, r.h)) <= 6),
near AS (SELECT 'near' AS kind, cls, test_path, train_path, CAST(1 AS BIGINT) AS n_train, distance, CAST(NULL AS VARCHAR) AS sha256 FROM m WHERE rn = 1)"""


@query("leak_near", f"WITH {_NEAR_LEAK_SQL} SELECT * FROM near")
def leak_near(spark, d):
    return A.near_leaks(*hashed_sides(spark, d))


@query("near_candidates_checked", f"WITH {_NEAR_LEAK_SQL} SELECT CAST(count(*) AS BIGINT) AS candidates, count(*) > 0 AS meaningful FROM q WHERE h IS NOT NULL")
def near_candidates_checked(spark, d):
    checked = A.without_exact(*hashed_sides(spark, d)).agg(F.count("h").alias("candidates"))
    return checked.withColumn("meaningful", F.col("candidates") > 0)


_KINDS_SQL = "kinds(kind, blocking) AS (VALUES ('cross_class_exact', true), ('exact', true), ('near', false), ('filename', false))"


@query("leak_summary", f"WITH {_LEAKS_SQL}, {_KINDS_SQL} SELECT kind, CAST(coalesce(sum(n_train), 0) AS BIGINT) AS hits, blocking, round(100.0 * coalesce(sum(n_train), 0) / (SELECT count(*) FROM split WHERE split = 'test'), 6) AS percent_of_test FROM kinds LEFT JOIN exact USING (kind) GROUP BY kind, blocking")
def leak_summary(spark, d):
    test, train = sides(spark, d)
    return A.leak_summary(A.exact_leaks(test, train), test.count())


@query("leakage_audit", f"""WITH {_NEAR_LEAK_SQL}, {_KINDS_SQL}, t AS (SELECT * FROM hs WHERE split = 'test'),
exact AS (SELECT CASE WHEN t.lang = r.lang THEN 'exact' ELSE 'cross_class_exact' END AS kind FROM t JOIN hs r ON r.split = 'train' AND r.sha256 = t.sha256),
first AS (SELECT lang, arg_min(sha256, path) AS train_sha FROM hs WHERE split = 'train' GROUP BY lang), named AS (SELECT 'filename' AS kind FROM t JOIN first USING (lang) WHERE t.sha256 <> train_sha),
hits AS (SELECT kind FROM exact UNION ALL SELECT kind FROM near UNION ALL SELECT kind FROM named), inside AS (SELECT split, count(*) - 1 AS more FROM hs WHERE sha256 <> '' GROUP BY split, sha256)
SELECT k.kind, count(h.kind) AS hits, blocking, round(100.0 * count(h.kind) / (SELECT count(*) FROM t), 6) AS percent_of_test FROM kinds k LEFT JOIN hits h ON k.kind = h.kind GROUP BY k.kind, blocking
UNION ALL SELECT 'within_' || split, CAST(sum(more) AS BIGINT), false, round(100.0 * sum(more) / (SELECT count(*) FROM t), 6) FROM inside GROUP BY split""")
def leakage_audit(spark, d):
    test, train = (x.withColumn("filename", F.concat("class", F.lit(".txt"))) for x in hashed_sides(spark, d))
    return A.leakage_audit(test, train, allow=True)


@query("leakage_gate", f"""WITH {_NEAR_LEAK_SQL}, {_LEAKS_SQL.removeprefix(SPLIT).lstrip(', ').replace('t AS (', 'te AS (', 1).replace('r AS (', 'tr AS (', 1).replace('FROM t JOIN r USING', 'FROM te t JOIN tr r USING')}, b AS (SELECT CAST(coalesce(sum(n_train), 0) AS BIGINT) AS n FROM exact)
SELECT 'blocking_hits' AS check, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM b UNION ALL SELECT 'near_candidates_checked', count(*) > 0, CAST(count(*) AS VARCHAR) FROM q WHERE h IS NOT NULL UNION ALL SELECT 'gate', n = 0, CASE WHEN n = 0 THEN 'open' ELSE 'closed' END FROM b""")
def leakage_gate(spark, d):
    """Whether the audit lets the split pass; `audit.gate` raises where it does not."""
    test, train = hashed_sides(spark, d)
    t, r = sides(spark, d)
    return A.gate_report(C.materialise(A.leak_summary(A.exact_leaks(t, r), t.count())), A.without_exact(test, train).agg(F.count("h").alias("candidates")))


@query("within_split_dups", f"WITH {SPLIT}, g AS (SELECT split, sha256, count(*) AS n FROM split WHERE sha256 <> '' GROUP BY ALL) SELECT split, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g GROUP BY split")
def within_split_dups(spark, d):
    return A.within_split_copies(split_samples(spark, d))


# labels
@query("normalize_label", f"WITH {_LABELS_SQL} SELECT doc_id, raw, label_key, canonical FROM labels_of WHERE canonical IS NOT NULL")
def normalize_label(spark, d):
    return labelled(spark, d).where("canonical is not null")


@query("unknown_label_quarantine", f"WITH {_LABELS_SQL} SELECT label_key, count(*) AS n, min(doc_id) AS first_id FROM labels_of WHERE canonical IS NULL GROUP BY label_key")
def unknown_label_quarantine(spark, d):
    return labelled(spark, d).where("canonical is null").groupBy("label_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


_REJECT = ["not_a_text", "nontext", "irrelevant", "other", "unknown", "es"]


@query("rejection_spelling", f"WITH {_LABELS_SQL} SELECT doc_id, label_key IN ({', '.join(repr(x) for x in _REJECT)}) AS rejected FROM labels_of")
def rejection_spelling(spark, d):
    return labelled(spark, d).select("doc_id", F.col("label_key").isin(_REJECT).alias("rejected"))


@query("describe_class", f"WITH {_LABELS_SQL}, info(canonical, short, rejection) AS (VALUES ('English', 'EN', false), ('French', 'FR', false)) SELECT doc_id, coalesce(short, canonical, label_key) AS short, coalesce(rejection, true) AS is_rejection FROM labels_of LEFT JOIN info USING (canonical)")
def describe_class(spark, d):
    info = spark.createDataFrame([("English", "EN", False), ("French", "FR", False)], "canonical string, short string, rejection boolean")
    return labelled(spark, d).join(F.broadcast(info), "canonical", "left").select("doc_id", F.coalesce("short", "canonical", "label_key").alias("short"), F.coalesce("rejection", F.lit(True)).alias("is_rejection"))


@query("class_index", f"WITH {SAMPLES}, c AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS BIGINT) AS class_idx FROM (SELECT DISTINCT class FROM samples)) SELECT sample_id, class, class_idx FROM samples JOIN c USING (class)")
def class_index_query(spark, d):
    rows = samples(spark, d)
    return rows.select("sample_id", "class").join(F.broadcast(class_index(rows)), "class")


# files and digests
@query("content_digest", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("relpath", f"WITH {SAMPLES} SELECT sample_id, path AS rel FROM samples")
def relpath(spark, d):
    return samples(spark, d).select("sample_id", S.relative_path(F.concat(F.lit("/data\\set\\"), F.replace("path", F.lit("/"), F.lit("\\"))), "/data/set").alias("rel"))


@query("parse_filename", f"WITH {SAMPLES} SELECT sample_id, class AS stem, sample_id AS idx FROM samples")
def parse_filename(spark, d):
    return samples(spark, d).select("sample_id", S.file_stem(F.col("filename")).alias("stem"), S.file_index(F.col("filename")).alias("idx"))


@query("utc_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamp(spark, d):
    return table(spark, d, "events").select("event_id", S.utc_stamp(F.col("ts")).alias("stamp"))


@query("simhash60", f"WITH {HASHED} SELECT id, h FROM hashed")
def simhash60(spark, d):
    return hashed(spark, d).select("id", "h")


# deduplication and groups
@query("dedup_first", f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY sample_id) AS rn FROM samples) SELECT sample_id, class, sha256, path FROM k WHERE rn = 1")
def dedup_first(spark, d):
    return C.dedup_first(samples(spark, d).select("sample_id", "class", "sha256", "path"), "sha256", ["sample_id"])


@query("dedup_audit", f"WITH {SAMPLES}, k AS (SELECT *, first_value(path) OVER w AS kept_path, first_value(class) OVER w AS kept_class, row_number() OVER w AS rn FROM samples WINDOW w AS (PARTITION BY sha256 ORDER BY sample_id)) SELECT sha256, kept_path, kept_class, path AS removed_path, class AS removed_class, kept_class <> class AS cross_class FROM k WHERE rn > 1")
def dedup_audit(spark, d):
    return C.dedup_audit(samples(spark, d), "sha256", ["sample_id"], "path", "class")


_CLASSES = NEAR + ", c AS (SELECT label, h, min(id) AS class_id FROM hashed WHERE h IS NOT NULL GROUP BY ALL)"


@query("near_pairs", f"WITH {_CLASSES} SELECT DISTINCT p.label, x.class_id AS l, y.class_id AS r, p.distance FROM (SELECT label, l, r, distance FROM pairs UNION ALL SELECT label, r, l, distance FROM pairs) p JOIN hashed a ON a.id = p.l JOIN hashed b ON b.id = p.r JOIN c x ON x.label = a.label AND x.h = a.h JOIN c y ON y.label = b.label AND y.h = b.h WHERE x.class_id < y.class_id")
def near_pairs(spark, d):
    """Pairs between the classes of equal hashes; near_pair_members gives the rows of each class."""
    rows = hashed(spark, d).where("h is not null")
    return C.near_pairs(rows, 6).hint("shuffle_merge").join(rows.select(F.col("id").alias("l"), "label").hint("shuffle_merge"), "l").select("label", "l", "r", F.col("distance").cast("int").alias("distance"))


@query("near_pair_members", f"WITH {_CLASSES} SELECT id, label, class_id FROM hashed JOIN c USING (label, h)")
def near_pair_members(spark, d):
    return C.near_members(hashed(spark, d).where("h is not null"))


@query("near_dup_groups", f"WITH RECURSIVE {GROUPS} SELECT id, label, group_id FROM groups")
def near_dup_groups(spark, d):
    return C.near_groups(hashed(spark, d), 6)


@query("group_renumber", f"WITH RECURSIVE {GROUPS} SELECT label, group_id, min(id) AS first_member, count(*) AS n FROM groups GROUP BY label, group_id")
def group_renumber(spark, d):
    return C.near_groups(hashed(spark, d), 6).groupBy("label", "group_id").agg(F.min("id").alias("first_member"), F.count(F.lit(1)).alias("n"))


@query("group_stats", f"WITH RECURSIVE {GROUPS}, g AS (SELECT label, group_id, count(*) AS n FROM groups GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(sum(n) - count(*) AS BIGINT) AS rows_minus_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_larger_groups FROM g")
def group_stats(spark, d):
    g = C.near_groups(hashed(spark, d), 6).groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), (F.sum("n") - F.count(F.lit(1))).alias("rows_minus_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_larger_groups"))


def _walk(rows: str) -> str:
    """The grouped split of (label, group_id, n): the groups in order, each to the side that lacks more."""
    side = "CASE WHEN want_test > 0 AND (want_test - ht) / want_test >= CASE WHEN want_train > 0 THEN (want_train - hr) / want_train ELSE 0.0 END THEN 'test' ELSE 'train' END"
    return f"""ord AS (SELECT label, group_id, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, sha256('42|' || label || '|' || group_id)) AS rn, sum(n) OVER (PARTITION BY label) AS total, count(*) OVER (PARTITION BY label) AS k FROM ({rows})),
goal AS (SELECT *, CAST(CASE WHEN k > 1 THEN greatest(1, round_even(total * 0.2, 0)) ELSE 0 END AS DOUBLE) AS want_test, CAST(total - CASE WHEN k > 1 THEN greatest(1, round_even(total * 0.2, 0)) ELSE 0 END AS DOUBLE) AS want_train FROM ord),
walk AS (SELECT label, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS group_id, 0.0::DOUBLE AS ht, 0.0::DOUBLE AS hr, '' AS split FROM goal WHERE rn = 1
 UNION ALL SELECT label, rn, group_id, ht + CASE WHEN side = 'test' THEN n ELSE 0 END, hr + CASE WHEN side = 'train' THEN n ELSE 0 END, side FROM (SELECT g.label, g.rn, g.group_id, g.n, ht, hr, {side} AS side FROM walk w JOIN goal g ON g.label = w.label AND g.rn = w.rn + 1)),
sided AS (SELECT label, group_id, split FROM walk WHERE rn > 0)"""


_GROUPED = f"{GROUPS}, {_walk('SELECT label, group_id, count(*) AS n FROM groups GROUP BY ALL')}"


def grouped(spark, d) -> DataFrame:
    """Rows with group and side of the grouped split."""
    groups = C.materialise(C.near_groups(hashed(spark, d), 6))
    sizes = groups.groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.hint("shuffle_merge").join(C.materialise(C.grouped_split(sizes, 0.2)), ["label", "group_id"])


@query("grouped_split", f"WITH RECURSIVE {_GROUPED} SELECT id, label, group_id, split FROM groups JOIN sided USING (label, group_id)")
def grouped_split(spark, d):
    return grouped(spark, d).select("id", "label", "group_id", "split")


@query("group_overlap", f"WITH RECURSIVE {_GROUPED}, g AS (SELECT label, group_id, split FROM groups JOIN sided USING (label, group_id)) SELECT count(DISTINCT (label, group_id)) AS n_groups, count(DISTINCT (label, group_id)) FILTER (split = 'test') AS n_test, count(DISTINCT (label, group_id)) FILTER (split = 'test' AND (label, group_id) IN (SELECT (label, group_id) FROM g WHERE split = 'train')) AS on_both_sides FROM g")
def group_overlap(spark, d):
    """How many groups there are, how many are on the test side, and how many on both (none)."""
    sides_of = grouped(spark, d).groupBy("label", "group_id").agg(F.bool_or(F.col("split") == "test").alias("test"), F.bool_or(F.col("split") == "train").alias("train"))
    return sides_of.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("test").alias("n_test"), F.count_if(F.col("test") & F.col("train")).alias("on_both_sides"))


@query("split_partition_check", f"WITH {SPLIT}, o AS (SELECT sample_id FROM split WHERE split = 'test' INTERSECT SELECT sample_id FROM split WHERE split = 'train'), m AS (SELECT doc_id FROM documents EXCEPT ALL SELECT sample_id FROM split) SELECT (SELECT count(*) FROM o) AS overlap, (SELECT count(*) FROM m) AS missing, count(*) AS n_rows FROM documents")
def split_partition_check(spark, d):
    rows, ids = split_samples(spark, d), samples(spark, d).select("sample_id")
    test, train = (rows.where(F.col("split") == s).select("sample_id") for s in ("test", "train"))
    overlap = test.intersect(train).agg(F.count(F.lit(1)).alias("overlap"))
    missing = ids.exceptAll(test.unionByName(train)).agg(F.count(F.lit(1)).alias("missing"))
    return overlap.join(missing).join(ids.agg(F.count(F.lit(1)).alias("n_rows")))


@query("stratified_split", f"WITH {SPLIT} SELECT sample_id, class, split FROM split")
def stratified_split(spark, d):
    return split_samples(spark, d).select("sample_id", "class", "split")


@query("train_val_split", f"""WITH {SPLIT}, t AS (SELECT sample_id, class, row_number() OVER (PARTITION BY class ORDER BY sha256('7|' || sample_id), sample_id) AS rk, count(*) OVER (PARTITION BY class) AS n FROM split WHERE split = 'train')
SELECT class, n AS n_rows, count_if(rk <= q) AS n_val, n - count_if(rk <= q) AS n_train, n < 2 AS starved FROM (SELECT *, least(greatest(CAST(round_even(n * 0.15, 0) AS BIGINT), 1), n - 1) AS q FROM t) GROUP BY class, n""")
def train_val_split(spark, d):
    train = split_samples(spark, d).where("split = 'train'").drop("split")
    parts = C.stratified_split(train, "class", "sample_id", 0.15, seed=7, names=("val", "train"))
    counts = parts.groupBy("class").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n_train"))
    return counts.withColumn("starved", F.col("n_rows") < 2)


@query("val_from_test", f"WITH {SPLIT} SELECT class, count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_val, count_if(split = 'test') AS n_test, 'validation rows are the test rows: scores on them are biased' AS warning FROM split GROUP BY class")
def val_from_test(spark, d):
    """The mode in which the test side doubles as validation, with its warning on every row."""
    n = lambda side: F.count_if(F.col("split") == side)
    counts = split_samples(spark, d).groupBy("class").agg(n("train").alias("n_train"), n("test").alias("n_val"), n("test").alias("n_test"))
    return counts.withColumn("warning", F.lit("validation rows are the test rows: scores on them are biased"))


@query("sample_per_class", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || sample_id), sample_id) AS rk FROM samples) SELECT sample_id, class FROM r WHERE rk <= 10")
def sample_per_class(spark, d):
    return C.sample_per_class(samples(spark, d).select("sample_id", "class"), "class", "sample_id", 10)


# manifests
@query("fingerprint_manifest", f"WITH {SPLIT} SELECT sha256(string_agg(split || '|' || class || '|' || sha256, chr(10) ORDER BY split, class, sha256)) AS fingerprint FROM split")
def fingerprint_manifest(spark, d):
    return C.manifest_fingerprint(split_samples(spark, d), ["split", "class", "sha256"])


@query("fingerprint_merkle", f"WITH {SPLIT}, l AS (SELECT sha256(split || '|' || class || '|' || sha256) AS d FROM split), b AS (SELECT substr(d, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS fingerprint FROM b")
def fingerprint_merkle(spark, d):
    return C.merkle_fingerprint(split_samples(spark, d), ["split", "class", "sha256"])


@query("fingerprint_tree", f"WITH {SAMPLES} SELECT count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, sha256(string_agg(path || '|' || sha256, chr(10) ORDER BY path, sha256)) AS fingerprint FROM samples")
def fingerprint_tree(spark, d):
    rows = samples(spark, d)
    sizes = rows.agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.octet_length("text").cast("long")).alias("total_bytes"))
    return sizes.join(C.manifest_fingerprint(rows, ["path", "sha256"]))


@query("materialise_splits", f"WITH {SPLIT}, n AS (SELECT split, class, class || '.txt' AS name, row_number() OVER (PARTITION BY split, class ORDER BY sample_id) - 1 AS k, sample_id FROM split) SELECT split, class, CASE WHEN k = 0 THEN name ELSE class || '__' || k || '.txt' END AS stored_name, sample_id FROM n")
def materialise_splits(spark, d):
    rows = split_samples(spark, d).withColumn("name", F.concat("class", F.lit(".txt")))
    named = C.suffix_collisions(rows, ["split", "class"], "name", F.col("sample_id")).select("split", "class", "stored_name", "sample_id")
    path = _out(spark)
    named.write.partitionBy("split", "class").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(named.schema).parquet(path).select("split", "class", "stored_name", "sample_id")


@query("class_tree", f"WITH {SPLIT}, n AS (SELECT split, class, CASE WHEN sample_id % 5 = 0 THEN class || '.bin' WHEN sample_id % 5 = 1 THEN class || '.TXT' ELSE class || '.txt' END AS name, text, sample_id FROM split), k AS (SELECT *, row_number() OVER (PARTITION BY split, class, name ORDER BY sample_id) - 1 AS k FROM n) SELECT split || '/' || class || '/' || f AS path, split, class, f AS filename, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM (SELECT *, CASE WHEN k = 0 THEN name ELSE split_part(name, '.', 1) || '__' || k || '.' || split_part(name, '.', 2) END AS f FROM k) WHERE lower(name) LIKE '%.txt'")
def class_tree(spark, d):
    """Members are written as files under split/class, with suffixes where names collide, and the tree is listed again, by extension."""
    spark.dataSource.register(ClassTree)
    rows = split_samples(spark, d)
    name = F.concat("class", F.when(F.col("sample_id") % 5 == 0, ".bin").when(F.col("sample_id") % 5 == 1, ".TXT").otherwise(".txt"))
    named = C.suffix_collisions(rows.select("split", "class", "sample_id", "text", name.alias("name")), ["split", "class"], "name", F.col("sample_id"))
    root = _out(spark)
    named.select("split", "class", F.col("stored_name").alias("filename"), F.col("text").cast("binary").alias("content")).write.format("classtree").mode("overwrite").option("path", root).save()
    return spark.read.format("classtree").option("path", root).option("extensions", ".txt,.md").schema("path string, split string, class string, filename string, length long").load()


@query("build_dataset", f"""WITH RECURSIVE {GROUPS}, docs AS (SELECT doc_id, lang, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents WHERE lang <> 'es'),
kept AS (SELECT doc_id, lang AS label, sha, group_id FROM docs JOIN groups ON doc_id = id WHERE rn = 1), {_walk('SELECT label, group_id, count(*) AS n FROM kept GROUP BY ALL')},
manifest AS (SELECT split, kept.label AS class, sha, group_id FROM kept JOIN sided USING (label, group_id)),
l AS (SELECT sha256(split || '|' || class || '|' || sha) AS d FROM manifest), bk AS (SELECT substr(d, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l GROUP BY 1), f AS (SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS fingerprint FROM bk),
r AS (SELECT lang AS class, count(*) AS n_rows, count_if(rn > 1) AS duplicates FROM docs GROUP BY lang), c AS (SELECT class, count(DISTINCT group_id) AS n_groups, count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test FROM manifest GROUP BY class)
SELECT class, n_rows, duplicates, n_groups, n_train, n_test, fingerprint FROM r JOIN c USING (class), f""")
def build_dataset(spark, d):
    """The build as one plan: labels, quarantine, dedup, groups, grouped split, manifest fingerprint, and its report by class."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    known = C.normalise_labels(docs, "lang", C.alias_table(spark, ALIASES), "crop").where("canonical is not null").select("doc_id", "sha", F.col("lang").alias("label"))
    groups = C.near_groups(hashed(spark, d), 6).select(F.col("id").alias("doc_id"), "group_id")
    kept = C.materialise(C.dedup_first(known, "sha", ["doc_id"]).join(groups, "doc_id"))
    sizes = kept.groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n"))
    manifest = kept.hint("shuffle_merge").join(C.materialise(C.grouped_split(sizes, 0.2)), ["label", "group_id"])
    manifest = C.materialise(manifest.select("split", F.col("label").alias("class"), "sha", "group_id"))
    report = known.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n_rows"))
    sides_of = manifest.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    out = report.join(sides_of, "class").join(F.broadcast(C.merkle_fingerprint(manifest, ["split", "class", "sha"])))  # one row
    return out.select("class", "n_rows", (F.col("n_rows") - F.col("n")).alias("duplicates"), "n_groups", "n_train", "n_test", "fingerprint")


_BUILD_SQL = f"""{HASHED}, docs AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS lang, CASE WHEN doc_id % 29 <> 3 THEN sha256(text) END AS sha FROM documents),
ok AS (SELECT id, lang AS label, sha, row_number() OVER (PARTITION BY sha ORDER BY id) AS rn, first_value(lang) OVER (PARTITION BY sha ORDER BY id) AS kl FROM docs WHERE lang <> 'es' AND sha IS NOT NULL),
kept0 AS (SELECT id, label, sha FROM ok WHERE rn = 1), kh AS (SELECT kept0.*, hashed.h FROM kept0 JOIN hashed USING (id)),
kp AS (SELECT a.id AS l, b.id AS r, a.label FROM kh a JOIN kh b ON a.label = b.label AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 6),
kr AS (SELECT id AS node, id AS root FROM kh UNION SELECT e.r, kr.root FROM kr JOIN (SELECT l, r FROM kp UNION ALL SELECT r, l FROM kp) e ON kr.node = e.l),
kroot AS (SELECT node, min(root) AS root FROM kr GROUP BY node), kept AS (SELECT kh.id, kh.label, kh.sha, dense_rank() OVER (PARTITION BY kh.label ORDER BY root) - 1 AS group_id FROM kroot JOIN kh ON node = id),
{_walk('SELECT label, group_id, count(*) AS n FROM kept GROUP BY ALL')},
ug AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || id), id) AS rk, count(*) OVER (PARTITION BY label) AS cn FROM kept0),
m AS (SELECT 'grouped' AS mode, split, label FROM kept JOIN sided USING (label, group_id) UNION ALL SELECT 'ungrouped', CASE WHEN rk <= least(greatest(CAST(round_even(cn * 0.2, 0) AS BIGINT), 1), cn - 1) THEN 'test' ELSE 'train' END, label FROM ug),
gs AS (SELECT label, group_id, count(*) AS n FROM kept GROUP BY ALL),
f AS (SELECT 'raw' AS metric, CAST(count(*) AS VARCHAR) AS value FROM docs UNION ALL SELECT 'unknown', CAST(count_if(lang = 'es') AS VARCHAR) FROM docs UNION ALL SELECT 'unreadable', CAST(count_if(lang <> 'es' AND sha IS NULL) AS VARCHAR) FROM docs
  UNION ALL SELECT 'removed', CAST(count_if(rn > 1) AS VARCHAR) FROM ok UNION ALL SELECT 'cross_class_removed', CAST(count_if(rn > 1 AND kl <> label) AS VARCHAR) FROM ok UNION ALL SELECT 'unique', CAST(count_if(rn = 1) AS VARCHAR) FROM ok),
g AS (SELECT 'threshold' AS metric, '6' AS value UNION ALL SELECT 'groups', CAST(count(*) AS VARCHAR) FROM gs UNION ALL SELECT 'rows_in_groups', CAST(CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS VARCHAR) FROM gs)"""


@query("build_reports", f"""WITH RECURSIVE {_BUILD_SQL} SELECT mode, metric, value FROM f, (VALUES ('grouped'), ('ungrouped')) x(mode) UNION ALL SELECT 'grouped', metric, value FROM g
UNION ALL SELECT mode, split, CAST(count(*) AS VARCHAR) FROM m GROUP BY mode, split UNION ALL SELECT mode, split || '_' || label, CAST(count(*) AS VARCHAR) FROM m GROUP BY ALL
UNION ALL SELECT 'ungrouped', 'warning', 'near copies were not grouped: they can lie on both sides of the split' UNION ALL SELECT mode, metric, value FROM (VALUES ('grouped'), ('ungrouped')) x(mode), (VALUES ('test_fraction', '0.2'), ('seed', '42')) y(metric, value)""")
def build_reports(spark, d):
    """The build in both modes, with every 29th document unreadable: manifest and audit are written, the reports read back from CSV."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.when(F.col("doc_id") % 29 != 3, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    rows = C.materialise(docs.hint("shuffle_merge").join(hashed(spark, d).select("id", "h").hint("shuffle_merge"), "id"))
    out = None
    for grouped in (True, False):
        made = B.build_dataset(rows, C.alias_table(spark, ALIASES), "crop", grouped=grouped, strict=False)
        path = _out(spark)
        files.write_manifest(made.manifest.withColumn("filename", F.col("id").cast("string")), f"{path}/manifest")
        made.duplicates.write.csv(f"{path}/duplicates", header=True)
        made.report.coalesce(1).write.csv(f"{path}/report", header=True)
        lines = spark.read.schema("metric string, value string").csv(f"{path}/report", header=True).where("metric not in ('fingerprint', 'mode')").select(F.lit("grouped" if grouped else "ungrouped").alias("mode"), "metric", "value")
        out = lines if out is None else out.unionByName(lines)
    return out


# validation
_CLASSES_SQL = "expected(class) AS (VALUES ('src0'), ('src1'), ('src2'), ('none'))"
_SPLITS_SQL = "sides(split) AS (VALUES ('train'), ('test'))"


def expected(spark) -> DataFrame:
    return spark.createDataFrame([("src0",), ("src1",), ("src2",), ("none",)], "class string")


@query("count_by_split_class", f"WITH {SPLIT}, {_CLASSES_SQL}, {_SPLITS_SQL} SELECT d.split, e.class, count(s.sample_id) AS n FROM expected e CROSS JOIN sides d LEFT JOIN split s ON s.class = e.class AND s.split = d.split GROUP BY ALL")
def count_by_split_class(spark, d):
    return A.count_by_split_class(split_samples(spark, d), expected(spark), ["train", "test"])


@query("dataset_info", f"WITH {SPLIT} SELECT coalesce(class, 'TOTAL') AS class, count_if(split = 'train') AS train, count_if(split = 'test') AS test, count(*) AS total, round(count_if(split = 'test') / count(*), 6) AS test_fraction FROM split GROUP BY ROLLUP (class)")
def dataset_info(spark, d):
    out = split_samples(spark, d).rollup("class").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("total"))
    return out.select(F.coalesce("class", F.lit("TOTAL")).alias("class"), "train", "test", "total", R6(F.col("test") / F.col("total")).alias("test_fraction"))


@query("missing_classes", f"WITH {SAMPLES}, {_CLASSES_SQL} SELECT 'missing' AS kind, class FROM expected WHERE class NOT IN (SELECT class FROM samples) UNION ALL SELECT DISTINCT 'unexpected', class FROM samples WHERE class NOT IN (SELECT class FROM expected)")
def missing_classes(spark, d):
    return A.class_differences(expected(spark), samples(spark, d))


@query("one_sided_classes", f"WITH {SPLIT}, s AS (SELECT * FROM split WHERE NOT (class = 'src1' AND split = 'test')) SELECT class, count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test FROM s GROUP BY class HAVING count_if(split = 'train') = 0 OR count_if(split = 'test') = 0")
def one_sided_classes(spark, d):
    return A.one_sided_classes(split_samples(spark, d).where("not (class = 'src1' and split = 'test')"))


@query("found_classes", f"WITH {SPLIT} SELECT DISTINCT class FROM split")
def found_classes(spark, d):
    test, train = sides(spark, d)
    return test.select("class").union(train.select("class")).distinct()


_CORRUPT = lambda: F.expr("CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty: no bytes' WHEN length(html) > 20000 THEN 'size: too large' WHEN NOT contains(lower(html), '</html>') THEN 'decode: no closing tag' END")
_CORRUPT_SQL = "SELECT page_id, CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 19 = 0 THEN substr(html, 1, 40) ELSE html END AS html FROM pages"
_ERROR_SQL = "CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty: no bytes' WHEN length(html) > 20000 THEN 'size: too large' WHEN NOT contains(lower(html), '</html>') THEN 'decode: no closing tag' END"


def planted_pages(spark, d) -> DataFrame:
    html = F.expr("CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 19 = 0 THEN substr(html, 1, 40) ELSE html END")
    return table(spark, d, "pages").select("page_id", html.alias("html"))


@query("corrupt_scan", f"SELECT * FROM (SELECT page_id, {_ERROR_SQL} AS error FROM ({_CORRUPT_SQL})) WHERE error IS NOT NULL")
def corrupt_scan(spark, d):
    return planted_pages(spark, d).select("page_id", _CORRUPT().alias("error")).where("error is not null")


@query("write_corrupt_report", f"SELECT * FROM (SELECT CAST(page_id AS VARCHAR) AS path, 'train' AS split, {_ERROR_SQL} AS error FROM ({_CORRUPT_SQL})) WHERE error IS NOT NULL")
def write_corrupt_report(spark, d):
    path = _out(spark)
    bad = planted_pages(spark, d).select(F.col("page_id").cast("string").alias("path"), F.lit("train").alias("split"), _CORRUPT().alias("error")).where("error is not null")
    bad.write.csv(path, header=True)
    return spark.read.schema(bad.schema).csv(path, header=True)


@query("input_guards", f"SELECT page_id, CASE WHEN e IS NULL THEN 200 WHEN e LIKE 'size%' THEN 413 WHEN e LIKE 'empty%' THEN 400 ELSE 415 END AS status FROM (SELECT page_id, {_ERROR_SQL} AS e FROM ({_CORRUPT_SQL}))")
def input_guards(spark, d):
    status = F.expr("CASE WHEN e IS NULL THEN 200 WHEN e LIKE 'size%' THEN 413 WHEN e LIKE 'empty%' THEN 400 ELSE 415 END")
    return planted_pages(spark, d).select("page_id", _CORRUPT().alias("e")).select("page_id", status.alias("status"))


@query("unreadable_count", "SELECT count(*) AS n_rows, count_if(doc_id % 11 = 0) AS unreadable FROM documents")
def unreadable_count(spark, d):
    sha = F.when(F.col("doc_id") % 11 != 0, F.sha2(F.col("text").cast("binary"), 256))
    return table(spark, d, "documents").select(sha.alias("sha")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("sha").isNull()).alias("unreadable"))


@query("validate_dataset", f"""WITH {SPLIT}, {_CLASSES_SQL}, {_SPLITS_SQL}, c AS (SELECT d.split, e.class, count(s.sample_id) AS n FROM expected e CROSS JOIN sides d LEFT JOIN split s ON s.class = e.class AND s.split = d.split GROUP BY ALL)
SELECT 'empty_class' AS check_name, 'fatal' AS level, class || '/' || split AS subject FROM c WHERE n = 0
UNION ALL SELECT 'missing', 'fatal', class FROM expected WHERE class NOT IN (SELECT class FROM split)
UNION ALL SELECT DISTINCT 'unexpected', 'warning', class FROM split WHERE class NOT IN (SELECT class FROM expected)
UNION ALL SELECT 'one_sided', 'warning', class FROM split GROUP BY class HAVING count_if(split = 'train') = 0 OR count_if(split = 'test') = 0
UNION ALL SELECT 'corrupt', 'fatal', CAST(page_id AS VARCHAR) FROM (SELECT page_id, {_ERROR_SQL} AS error FROM ({_CORRUPT_SQL})) WHERE error IS NOT NULL""")
def validate_dataset(spark, d):
    rows = split_samples(spark, d)
    empty = A.count_by_split_class(rows, expected(spark), ["train", "test"]).where("n = 0").select(F.lit("empty_class").alias("check_name"), F.lit("fatal").alias("level"), F.concat("class", F.lit("/"), "split").alias("subject"))
    kinds = A.class_differences(expected(spark), rows).select(F.col("kind").alias("check_name"), F.when(F.col("kind") == "missing", "fatal").otherwise("warning").alias("level"), F.col("class").alias("subject"))
    lines = lambda rows, name, level, subject: rows.select(F.lit(name).alias("check_name"), F.lit(level).alias("level"), F.col(subject).cast("string").alias("subject"))
    sides_missing = lines(A.one_sided_classes(rows), "one_sided", "warning", "class")
    corrupt = lines(planted_pages(spark, d).where(_CORRUPT().isNotNull()), "corrupt", "fatal", "page_id")
    return empty.unionByName(kinds).unionByName(sides_missing).unionByName(corrupt)
