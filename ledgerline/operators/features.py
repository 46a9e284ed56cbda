"""Feature encoding: label codes, unseen labels, date parts, scaling (FE1–FE4, FE6)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.joins import fits
from ledgerline.functions.ordering import consecutive_index
from ledgerline.session import cut_lineage

# Label maps larger than this are joined with a shuffle instead of broadcast.
BROADCAST_LABELS = 100_000


def label_map(df: DataFrame, col: str) -> DataFrame:
    """(label, code, rows) for the distinct non-null labels of ``col``; codes 0..k−1 follow the labels' order.

    The codes come from a range partitioning of the labels plus offsets, so no
    list of labels is made on the driver; the table is checkpointed.
    """
    labels = (df.select(F.col(col).cast("string").alias("label")).where("label is not null")
              .groupBy("label").agg(F.count(F.lit(1)).alias("rows")))
    return cut_lineage(consecutive_index(labels, "label", "code")
                       .select("label", F.col("code").cast("double").alias("code"), "rows"))


def look_up(df: DataFrame, col: str, mapping: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the code of ``col``'s value in ``mapping``, null if it has none.

    A small map, by its measured rows (``BROADCAST_LABELS``) and bytes, is broadcast. Of a large one only the labels
    of at least a thousandth of the counted rows are (so at most 1000 of them); the others, none of which fills a
    task, are joined with a shuffle.
    """
    key, value = "_look_up_label", "_look_up_code"
    m = mapping.select(F.col("label").alias(key), F.col("code").alias(value))
    keyed = df.withColumn(key, F.col(col).cast("string"))
    if fits(m, BROADCAST_LABELS):
        return keyed.join(F.broadcast(m), key, "left").withColumn(out, F.col(value)).drop(key, value)
    if "rows" in mapping.columns:
        often = F.col("rows") >= mapping.agg(F.sum("rows")).first()[0] / 1000
        m = mapping.select(F.col("label").alias(key), F.col("code").alias(value), often.alias("_often"))
        hot, m = m.where("_often").drop("_often"), m.where("not _often").drop("_often")
        if fits(hot, 1000):
            marked = keyed.join(F.broadcast(hot.withColumnRenamed(value, "_look_up_hot")), key, "left")
            # Rows with a common label, and those without any, need no shuffle.
            done = F.col("_look_up_hot").isNotNull() | F.col(key).isNull()
            return (marked.where(done).withColumn(out, F.col("_look_up_hot")).drop(key, "_look_up_hot")
                    .unionByName(marked.where(~done).drop("_look_up_hot").join(m, key, "left")
                                 .withColumn(out, F.col(value)).drop(key, value)))
        m = m.unionByName(hot)
    return keyed.join(m, key, "left").withColumn(out, F.col(value)).drop(key, value)


def label_encode(df: DataFrame, cols: list[str], suffix: str = "") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Codes in sorted label order (0..k−1); unseen or null → k. Returns the label map of each column too."""
    out, maps = df, {c: label_map(df, c) for c in cols}
    for c in cols:
        unseen = float(maps[c].count())
        to = c + (suffix or "__code")
        out = look_up(out, c, maps[c], to).withColumn(to, F.coalesce(to, F.lit(unseen)))
        if not suffix:
            out = out.withColumn(c, F.col(to)).drop(to)
    return out, maps


def encode_with_map(df: DataFrame, col: str, mapping: DataFrame, unseen: str = "zero") -> DataFrame:
    """Replace ``col`` by its code; unseen labels → code 0 (``'zero'``) or the first class.

    Both fallbacks map to code 0 because codes follow sorted order, so the
    first class is code 0.
    """
    return (look_up(df, col, mapping, "_encoded").withColumn(col, F.coalesce("_encoded", F.lit(0.0)))
            .drop("_encoded"))


def date_parts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each date column → ``<col>_year``, ``<col>_month``, ``<col>_day``; original dropped."""
    out = df
    for c in cols:
        dt = df.schema[c].dataType
        ts = F.col(c) if C.is_temporal(dt) else F.expr(f"try_to_timestamp(`{c}`)")
        out = (out.withColumn(f"{c}_year", F.year(ts)).withColumn(f"{c}_month", F.month(ts))
               .withColumn(f"{c}_day", F.dayofmonth(ts)).drop(c))
    return out


def standard_scale(df: DataFrame, cols: list[str], population: bool = True) -> DataFrame:
    """(x − mean) / std with the population std (scikit-learn) or sample std (Spark ML)."""
    std = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        m, s = row[c]["m"], row[c]["s"]
        scale = 1.0 if not s else s
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(m)) / F.lit(scale))
    return out


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """pandas ``Categorical.codes``: sorted distinct labels 0..k−1, null → −1 (int)."""
    out = df
    for c in cols:
        out = (look_up(out, c, label_map(df, c), "_code").withColumn(c, F.coalesce(F.col("_code").cast("int"), F.lit(-1)))
               .drop("_code"))
    return out


def feature_pipeline(df: DataFrame, target: str | None = None, scale: bool = True) -> tuple[Pipeline, list[str]]:
    """Impute → date parts → label codes → assemble → (optionally) standardise.

    Returns the unfitted pipeline and the ordered feature names; the model
    fitted from it carries every encoder, so scoring data goes through the
    same steps (no separate encoder bookkeeping).
    """
    fields = [f for f in df.schema.fields if f.name != target]
    dates = [f.name for f in fields if C.is_temporal(f.dataType)]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    nums = [f.name for f in fields if C.is_numeric(f.dataType)]
    stages = []
    feats: list[str] = []
    if dates:
        parts = ", ".join(f"year(`{c}`) AS `{c}_year`, month(`{c}`) AS `{c}_month`, dayofmonth(`{c}`) AS `{c}_day`"
                          for c in dates)
        stages.append(SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__"))
        feats += [f"{c}_{p}" for c in dates for p in ("year", "month", "day")]
    if nums:
        stages.append(Imputer(inputCols=nums, outputCols=[f"{c}__imp" for c in nums], strategy="median"))
        feats += [f"{c}__imp" for c in nums]
    if strings:
        stages.append(StringIndexer(inputCols=strings, outputCols=[f"{c}__code" for c in strings],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        feats += [f"{c}__code" for c in strings]
    stages.append(VectorAssembler(inputCols=feats, outputCol="features_raw" if scale else "features",
                                  handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    names = [f.replace("__imp", "").replace("__code", "") for f in feats]
    return Pipeline(stages=stages), names
