"""The registered queries: each applies one operator to its whole table and gives the contract's columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination as dec
from . import language_id as li
from . import lm_score as lm
from . import ngram_join as nj
from . import packing as pk
from . import pii
from . import quality_rules as qr
from . import rlz_dedup as rlz
from . import suffix_dedup as sd
from . import toxicity as tx
from ._common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).drop("posterior")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def tokenizer(name: str = "byte_bpe_50k") -> tuple[str, str, dict[str, int]]:
    """Ranks of a vocabulary, its pattern and its special tokens, which are tokens wherever a text holds their string."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json")) as f:
        added = json.load(f)["added_tokens"]
    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, {x["content"]: x["id"] for x in added}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.pack(table(spark, sf_dir, "documents"), *tokenizer())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dec.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_private(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return d.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nj.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rlz.rlz_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sd.suffix_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality_rules, op3_lm_score, op4_ngram_join, op5_rlz_dedup, op6_packing, op7_decontamination, op8_pii, op9_suffix_dedup, op10_toxicity, pipeline)}
