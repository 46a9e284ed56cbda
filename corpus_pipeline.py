"""Training-corpus pipeline: documents -> language filter -> near-dedup -> substring dedup -> decontamination -> packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet into the shared checkpoint
folder and gives the reread table to the next stage.

Decisions are applied by row: ``with_row_key`` names each row by its place in the
stage's input, so ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import dartminhash, decontaminate, langid, packing, substrings
from ledgerline.llm.common import free_name, release, store, store_last, stored_paths, with_row_key
from ledgerline.llm.queries import tokenizer_path

#: SQL cannot express these methods; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without letters or far from every learned profile go.

    The profiles, and each language's least closeness, are learned from this
    stage's documents. Null and empty texts go; rows without an id and repeated
    rows are judged one by one; an empty table gives an empty result.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Every row is a document, also those without an id (they come last) or with
    the id of another; texts without a word are like no other and stay.
    """
    return dartminhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 20-word windows; a text that loses no word stays as it is.

    A shortened text is its remaining words joined by one space; a document
    that loses all its words stays with an empty text. n_chars follows the text.
    Each row gets its own text back, whatever its id; a null id is later than
    every other; null texts stay null.
    """
    key = free_name(docs, "_row_key")
    keyed = with_row_key(docs, key)
    before = stored_paths(spark)
    cut = substrings.remove_repeated_windows(keyed, carry=key).where("n_removed > 0")
    kept = free_name(docs, "_kept")
    cut = store_last(cut.select(key, F.col("kept").alias(kept)), before)
    return keyed.join(cut, key, "left").withColumns(
        {"n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long")),
         "text": F.coalesce(kept, "text")}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows are judged one by one, with or without an id."""
    key = free_name(docs, "_row_key")
    keyed = with_row_key(docs, key)
    before = stored_paths(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.contaminated(keyed, benchmark, id_col=key)
    hits = store_last(hits.select(F.col("doc_id").alias(key)).distinct(), before)
    return keyed.join(hits, key, "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables are deleted when its result is written."""
    before = stored_paths(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
        release(spark, keep=[*before, stored_paths(spark)[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
