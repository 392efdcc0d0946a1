"""The corpus pipeline: raw documents to a mixed training set, each stage one operator of tesserae.llm.

Defined results: documents with a null doc_id stay (nothing can name them as a copy); a null or empty text is not toxic,
holds no benchmark words and no entity, and is drawn once an epoch in the mix; of equal texts the smallest doc_id stays;
each text of a doc_id is judged as a document of its own; an empty table gives an empty result; the columns of documents, whatever their
names, are kept, and the last stage adds its own.

Every stage works on all that the one before kept; its result is written as Parquet to the shared folder and read back
as the next one's documents, so a lost executor costs a stage's tasks, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import op02_decontaminate, op07_mixing, op08_pii, op09_toxicity, op10_simhash
from tesserae.llm.common import materialise, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from all labels; documents with a toxicity of 0.5 or more go."""
    return op09_toxicity.reject_toxic(docs, op09_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return op10_simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten benchmark words go."""
    return op02_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; every document stays."""
    return op08_pii.surrogate_text(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice."""
    return op07_mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
#: SQL has no suffix arrays, learned grammar or keyed surrogates; tests hold each stage against brute force.
ORACLE_SQL = None
