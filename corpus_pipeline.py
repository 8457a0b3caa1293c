"""A corpus pipeline of five operators: ``documents`` in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
every stage's result as Parquet in the shared folder and reads it as the next one's
documents.  All stages but the last return the columns of documents.

* language: documents without a language (``und``: null, or no letter) go;
* exact duplicates: of equal texts the longest original stays;
* near duplicates: of each group of linked documents the smallest id stays (a null id
  last; of equal ids any one, but always the same);
* benchmark: documents that hold a phrase of a benchmark item go;
  rows are told apart by id and text, so those that share an id or have none are
  decided on each by itself;
* tokens: the ids of each document, with proof that they decode to its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id
from causeloom.llm.staging import scratch, stage


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, 128 bits of the id and the text, which name a row once exact duplicates are gone."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
    return docs.withColumn("__key", F.substring(F.unhex(F.sha2(name, 256)), 1, 16))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed ``docs`` but those whose key is among ``keys``; texts are shuffled only if the keys are too many to broadcast."""
    gone = stage(keys.select(F.col("id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= jaccard_join.BROADCAST_IDS else gone
    return docs.join(gone, docs["__key"] == F.col("__gone"), "left_anti").drop("__key")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model, names=("__lang_pred", "__lang_score"))
    return found.where(F.col("__lang_pred") != language_id.UNKNOWN).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_unique(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark, "gone"):
        return _without_near_copies(docs)


def _without_near_copies(docs: DataFrame) -> DataFrame:
    docs = _keyed(docs)
    moved = jaccard_join.join(docs, "__key").where("id <> component_id")
    linked = stage(moved.select("id", "component_id").union(moved.select("component_id", "component_id")).distinct(), "linked")
    named = docs.select("__key", "doc_id").join(linked, F.col("__key") == F.col("id")).select("id", "component_id", "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("stays"))
    return _without(docs, linked.join(first, "component_id").where("id <> stays"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    docs = _keyed(docs)
    with scratch(spark, "gone"):
        return _without(docs, decontaminate.decontaminate(docs, items, id_col="__key").where("n_hit > 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenize(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", by_language),
    ("exact duplicates", without_copies),
    ("near duplicates", without_near_copies),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]

#: Language identification and byte-level BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
