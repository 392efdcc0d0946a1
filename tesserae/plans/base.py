"""Registration of queries and the shared bindings of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import curation as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# samples: documents as files of a class tree, the source as class
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("class"), "lang", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        name.alias("filename"), F.concat("source", F.lit("/"), name).alias("path"),
    )


SAMPLES = """samples AS (SELECT doc_id AS sample_id, source AS class, lang, text, sha256(text) AS sha256,
  source || '_' || doc_id || '.txt' AS filename, source || '/' || source || '_' || doc_id || '.txt' AS path FROM documents)"""


def split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified_split(samples(spark, sf_dir), "class", "sample_id", 0.2)


SPLIT = (
    SAMPLES
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || sample_id), sample_id) AS rk, count(*) OVER (PARTITION BY class) AS cn FROM samples),
split AS (SELECT * EXCLUDE (rk, cn), CASE WHEN rk <= least(greatest(CAST(round_even(cn * 0.2, 0) AS BIGINT), 1), cn - 1) THEN 'test' ELSE 'train' END AS split FROM ranked)"""
)


# similarity hashes of the texts, the language as label
def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.materialise(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), C.simhash60(F.col("text")).alias("h")))


_BITS = ", ".join(f"sum(2 * ((x >> {i}) & 1) - 1) AS b{i}" for i in range(60))
_VALUE = " + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(60))
HASHED = f"""words AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [text] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
codes AS (SELECT doc_id, CAST('0x' || substr(sha256(s), 1, 15) AS BIGINT) AS x FROM shingles),
votes AS (SELECT doc_id, {_BITS} FROM codes GROUP BY doc_id),
hashed AS (SELECT d.doc_id AS id, d.lang AS label, CAST({_VALUE} AS BIGINT) AS h FROM documents d LEFT JOIN votes USING (doc_id))"""
NEAR = HASHED + """, pairs AS (SELECT a.id AS l, b.id AS r, a.label, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM hashed a JOIN hashed b ON a.label = b.label AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 6)"""
GROUPS = NEAR + """, reach AS (SELECT id AS node, id AS root FROM hashed UNION SELECT e.r, reach.root FROM reach JOIN (SELECT l, r FROM pairs UNION ALL SELECT r, l FROM pairs) e ON reach.node = e.l),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
groups AS (SELECT node AS id, label, CAST(dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS BIGINT) AS group_id FROM roots JOIN hashed ON node = id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").alias("v"))


VECTORS = "v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CENTROIDS = VECTORS + """, dims AS (SELECT id, label, unnest(v) / sqrt(list_dot_product(v, v)) AS x, unnest(range(1, len(v) + 1)) AS i FROM v),
means AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i), model AS (SELECT label AS cls, list(m ORDER BY i) AS centroid FROM means GROUP BY label)"""
SCORES = CENTROIDS + """, cosines AS (SELECT id, label AS truth, cls, list_cosine_similarity(v, centroid) AS cos FROM v, model),
shifted AS (SELECT *, exp(cos - max(cos) OVER (PARTITION BY id)) AS e FROM cosines),
probabilities AS (SELECT id, truth, cls, cos, e / sum(e) OVER (PARTITION BY id) AS p FROM shifted),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS rk FROM probabilities),
scored AS (SELECT id, truth, max(cls) FILTER (rk = 1) AS pred, max(p) FILTER (rk = 1) AS confidence, max(cls) FILTER (rk = 2) AS second, max(p) FILTER (rk = 2) AS second_p, max(p) FILTER (rk = 1) - max(p) FILTER (rk = 2) AS margin FROM ordered GROUP BY id, truth)"""
COS_PAIRS = VECTORS + ", cp AS (SELECT a.id AS q, b.id AS g, a.label AS q_label, b.label AS g_label, list_cosine_similarity(a.v, b.v) AS cos FROM v a JOIN v b ON a.id <> b.id)"
