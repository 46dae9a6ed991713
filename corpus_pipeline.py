"""A corpus pipeline over ``documents``: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; :func:`run` writes
each result as Parquet in the shared work folder and reads it back as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidecast.llm import decontam, mixing, ngram_join, sharding, toxicity
from slidecast.llm.common import materialize, quoted, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject. A null id is scored like others."""
    scores = toxicity.toxicity_scores(docs, read_table(spark, sf_dir, "labels"), carry=docs.columns)
    return scores.filter("__toxicity.predicted = 0").select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id (of these the longest text).

    Blank texts form no group and stay, rows without an id too. Rows that
    repeat an id are told apart by their texts, so each goes only if another row of its own group stays.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", (-F.length(text)).alias("longest"), F.xxhash64(text).alias("text")))
    found = ngram_join.ngram_components(docs.select(key.alias("__key"), "text"), id_col="__key")
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__key"), (F.col("n_shingles") > 0).alias("__grouped")).distinct()
    stay = docs.withColumn("__key", key).join(keep, "__key").withColumn(
        "__n", F.expr("row_number() over (partition by __key order by text)")).filter("__n = 1 OR NOT __grouped").select(*quoted(docs.columns))
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items."""
    cleaned = decontam.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    changed = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
    return changed.select(*quoted(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and left out so that sources reach their target weights."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row of the mix."""
    return sharding.shard_plan(docs).drop("number")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None  # class models, shingle sets and the drawn mix are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
