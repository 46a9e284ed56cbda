"""Helpers shared by the operators: batch limits, held-out folds, connected components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.session import scratch_path

BATCH_BYTES = 8 << 20


_STORED: list[tuple[str, str]] = []


def store(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    This cuts the lineage (plans, statistics and constraints) and survives the
    loss of executors. ``release`` deletes the tables of the session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.option("compression", codec).parquet(path)
    _STORED.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_paths(spark: SparkSession) -> list[str]:
    """The tables that ``store`` has written in this session and that are still there."""
    return [path for app, path in _STORED if app == spark.sparkContext.applicationId]


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete what ``store`` has written in this session, but for the paths in ``keep``.

    Results that still read a deleted table must be saved before.
    """
    jvm, app, keep = spark._jvm, spark.sparkContext.applicationId, set(keep)
    for entry in [e for e in _STORED if e[0] == app and e[1] not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.remove(entry)


def store_last(df: DataFrame, before: list[str]) -> DataFrame:
    """``store`` the outcome of a computation and delete its other tables: all but those in ``before``."""
    out = store(df)
    release(df.sparkSession, keep=[*before, _STORED[-1][1]])
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a 16-byte key per row that stays the same whenever the table is read.

    Rows read from files are known by their file and place in it; other rows
    are stored once with a number.
    """
    try:
        place = docs.select(F.md5(F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").cast("binary")))
    except AnalysisException:
        place = None
    if place is not None and "_metadata" not in docs.columns:
        return docs.withColumn(name, F.unhex(F.md5(F.concat_ws(
            ":", "_metadata.file_path", "_metadata.row_index").cast("binary"))))
    return store(docs.withColumn(name, F.unhex(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")))))


def ordered_key(doc_id: Column, key: Column) -> Column:
    """Bytes that sort by the integer id (null last), then by the key."""
    number = F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.concat(F.when(doc_id.isNull(), F.lit("01" + "0" * 16)).otherwise(
        F.concat(F.lit("00"), F.lpad(number, 16, "0"))), F.hex(key)))


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as rows, so that long texts cannot pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_node(text: Column) -> Column:
    """16-byte digest that stands for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``size`` words; a shorter document is one run of all its words."""
    hashes, at = W.window_hashes(words, size)
    doc = words.doc_of_word()
    out_h, out_d = [hashes], [doc[at]]
    count = np.diff(words.first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            h, at = W.window_hashes(words, n)
            mine = np.isin(at, words.first[short])
            out_h.append(W.mix(h[mine] + np.uint64(n)))
            out_d.append(doc[at[mine]])
    return np.concatenate(out_h), np.concatenate(out_d)


def lower(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is a node of its component.

    Each round every node points to the smallest node among itself and its
    neighbours, edges move to those targets and self-loops vanish. Node ids
    are digests, so their order is random and the edges shrink by a constant
    factor a round. All state is in stored tables; a hub's edges are
    pre-aggregated before the shuffle and joins may be split by AQE. A loop in
    the edges (a = b) gives a node of its own component; empty edges give an
    empty table.
    """
    edges = store(edges.select("a", "b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    steps = []
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        target = (edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"),
                                                                             F.col("a").alias("b")))).alias("x"))
                  .groupBy(F.col("x.a").alias("node")).agg(F.min("x.b").alias("m"))
                  .select("node", F.least("node", "m").alias("to")))
        jump = target.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        target = store(target.join(jump, "to", "left").select("node", F.coalesce("to2", "to").alias("to")))
        steps.append(target)
        edges = store(edges.join(target.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                      .join(target.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
                      .where("ta <> tb")
                      .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    labels = nodes.withColumn("label", F.col("node"))
    for target in steps:
        labels = labels.join(target.withColumnRenamed("node", "label"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label"))
    return store(labels)
