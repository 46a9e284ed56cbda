"""The registered queries of the subpackage: each runs one operator over its whole table.

``QUERIES`` maps names to callables (spark, sf_dir) -> DataFrame, ``ORACLES``
names to DuckDB SQL over the same tables where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    brown, dartminhash, decontaminate, html, langid, merkle, packing, phrases, quality, rans, sql, substrings, topk,
    toxicity)
from ledgerline.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_near_duplicates(spark, sf_dir):
    return dartminhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op3_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark, sf_dir):
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html(spark, sf_dir):
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark, sf_dir):
    cut = substrings.remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_lm_scoring(spark, sf_dir):
    return brown.score(_table(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=fold(F.col("doc_id"), 5) == 0)


def op13_token_ids(spark, sf_dir):
    return rans.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_top_k, op3_toxicity, op4_quality, op5_language_id, op6_decontamination, op7_html,
    op8_packing, op9_substring_dedup, op10_lm_scoring, op11_phrases, op12_merkle_manifest, op13_token_ids)}
ORACLES: dict[str, str] = {"op2_top_k": sql.TOP_K, "op6_decontamination": sql.DECONTAMINATION,
                           "op9_substring_dedup": sql.SUBSTRING_DEDUP, "op11_phrases": sql.PHRASES,
                           "op12_merkle_manifest": sql.MERKLE}
