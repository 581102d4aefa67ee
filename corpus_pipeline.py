"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return documents with their columns, but for the last, which returns the packing.  Every
stage takes empty tables, null and empty texts, null ids, repeated rows and columns of any other names: rows are kept or go by
what their stage says, and other columns go along.  A null or empty text fails the base rule of the first stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination as dec
from lattica.llm import ngram_join, packing, pii
from lattica.llm import quality_rules as qr
from lattica.llm._common import stage, table
from lattica.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    whole = docs.withColumn("_row", F.struct(*docs.columns))
    return qr.quality_rules(whole, table(spark, sf_dir, "labels"), keep=("_row",)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word-shingle similarity, the document of smallest id.  Rows that share an id count as one
    document: they stay or go together, but of those with equal texts one stays.  Rows without an id stay."""
    first = ngram_join.jaccard_join(docs).where("component_id = doc_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    named = docs.where(F.col("doc_id").isNotNull())
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    found = dec.decontamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows."""
    whole = docs.withColumn("_row", F.struct(*docs.columns))
    d = pii.find_private(whole, keep=("_row",)).withColumn("_masked", F.when(F.col("_row.text").isNotNull(), pii.masked(F.col("text"), F.col("spans"))))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return d.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack(docs, *tokenizer())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("private data", private_data), ("packing", pack)]

#: The learned verdicts of the first and fourth stage are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
