"""A training corpus from raw documents, stage by stage.

Every stage works on all that its predecessor kept.  Stages but the last return the columns of
``documents``.  Rows without a doc_id end at the near-duplicate stage, which knows documents by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curioshelf.llm import line_crf, packing, secrets, toxicity
from curioshelf.llm.ngram_join import ngram_join
from curioshelf.llm.queries import held_out
from curioshelf.session import kept


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below the threshold stay."""
    model = toxicity.train(docs, _labels(spark, sf_dir).where(~held_out(4, 2)))
    scored = toxicity.score(docs, model, tuple(docs.columns))
    return scored.where(F.col("toxicity_score") < toxicity.THRESHOLD).drop("toxicity_score")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being good is at least the threshold stay."""
    model = line_crf.train(docs, _labels(spark, sf_dir).where(~held_out(5, 0)))
    scored = line_crf.score(docs, model, tuple(docs.columns))
    return scored.where(F.col("quality_score") >= line_crf.THRESHOLD).drop("quality_score")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id."""
    first = ngram_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are struck out."""
    scanned = kept(secrets.scan(docs))
    scored = secrets.score(scanned, secrets.train(secrets.samples(scanned)))
    struck = scored.withColumn("text", secrets.redacted(F.col("text"), "_spans"))
    return struck.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents, or chunks of them, in sequences of fixed length."""
    return packing.pack(packing.as_items(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("quality_classifier", of_quality),
    ("ngram_jaccard_join", without_near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

# Trained models and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
