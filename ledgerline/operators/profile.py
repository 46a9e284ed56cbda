"""Column profile and data-quality dimensions (DQ1–DQ8).

One pass over the table feeds them all: every row is unpivoted to (column,
value) pairs plus one pair that holds a 128-bit hash of the whole row, and
the pairs are counted, map-side combined. Row count, missing cells, distinct
values, samples, unparseable dates, negative values and duplicate rows are
all read off those counts (``measure``). Values longer than ``KEY_CHARS`` are
grouped by their beginning and a 128-bit hash, so long texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.exprs import half_up

# Data-quality issue lines.
ISSUE_MISSING = "Column '{column}' has {pct}% missing values."
ISSUE_NEGATIVE = ("Column '{column}' contains {count} negative values, which may be invalid for "
                  "monetary/quantity fields.")
ISSUE_BAD_DATES = "Column '{column}' has {count} rows with inconsistent date formats."
ISSUE_OUTLIERS = "High outlier contamination ({pct}%) detected across numerical columns."

KEY_CHARS = 256
SAMPLES = 3
DATETIME_SHARE = 0.8


def _is_missing(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _numeric_like(dt: T.DataType) -> bool:
    # pandas treats booleans as numeric for semantic typing.
    return C.is_numeric(dt) or isinstance(dt, T.BooleanType)


def _name_is_datelike(name: str) -> bool:
    low = name.lower()
    return "date" in low or "time" in low


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for every non-null value of ``columns`` (as strings)."""
    if not columns:
        schema = "column string, value string, count bigint"
        return df.sparkSession.createDataFrame([], schema)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (df.select(F.explode(F.array(*pairs)).alias("kv"))
            .where(F.col("kv.value").isNotNull())
            .groupBy(F.col("kv.column").alias("column"), F.col("kv.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def _hashes(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of some columns in which nulls count as values."""
    marked = [*columns, *[c.isNull() for c in columns]]
    return F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Hashes of whole rows; maps, which have no hash, count by their text."""
    return _hashes(*[F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString()
                     else F.col(f"`{f.name}`") for f in df.schema.fields])


def _cell(position: int, field: T.StructField) -> Column:
    """One cell as (position, value, h1, h2, bad): missing cells without a value, unparseable dates marked."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    bad = F.lit(False)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0).cast(kind)).when(~F.isnan(c), c)
    text = c.cast("string")
    h1, h2 = F.lit(None).cast("long"), F.lit(None).cast("long")
    if not C.is_numeric(kind) and not C.is_temporal(kind) and not isinstance(kind, T.BooleanType):
        long = F.length(text) > KEY_CHARS
        h1, h2 = (F.when(long, h) for h in _hashes(text))
        if isinstance(kind, T.StringType) and _name_is_datelike(field.name):
            bad = F.coalesce(c.isNotNull() & F.try_to_timestamp(c).isNull(), F.lit(False))
        text = F.substring(text, 1, KEY_CHARS)
    return F.struct(F.lit(position).alias("position"), text.alias("value"), h1.alias("h1"), h2.alias("h2"),
                    bad.alias("bad"))


def unpivot(df: DataFrame, fields: list[T.StructField], *keep: str) -> DataFrame:
    """(``keep``, position, value, h1, h2, bad): one row per cell of ``fields`` and one, at position -1, per row."""
    h1, h2 = _row_hashes(df.select(*[F.col(f"`{f.name}`") for f in fields]))
    row = F.struct(F.lit(-1).alias("position"), F.lit(None).cast("string").alias("value"), h1.alias("h1"),
                   h2.alias("h2"), F.lit(False).alias("bad"))
    cells = [_cell(i, f) for i, f in enumerate(fields)]
    return df.select(*keep, F.explode(F.array(row, *cells)).alias("x")).select(*keep, "x.*")


def column_totals(counts: DataFrame, fields: list[T.StructField], *by: str) -> DataFrame:
    """Per group and position: rows, missing, keys, values, bad and negative, of counted cells (``n`` each)."""
    numeric = [i for i, f in enumerate(fields) if C.is_numeric(f.dataType)]
    below = F.col("position").isin(numeric) & (F.expr("try_cast(value AS double)") < 0)
    return counts.groupBy(*by, "position").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("missing"),
        F.count(F.lit(1)).alias("keys"), F.count("value").alias("values"),
        F.sum(F.when(F.col("bad"), F.col("n"))).alias("bad"), F.sum(F.when(below, F.col("n"))).alias("negative"))


def group_scores(totals: DataFrame, fields: list[T.StructField], *by: str) -> DataFrame:
    """Quality of many groups at once: the dimensions and score of ``quality`` without the forest, per group."""
    at, rows = F.col("position"), F.col("rows")
    money = [i for i, f in enumerate(fields) if C.is_numeric(f.dataType)
             and any(k in f.name.lower() for k in C.VALIDITY_KEYWORDS)]
    dates = [i for i, f in enumerate(fields)
             if isinstance(f.dataType, T.StringType) and _name_is_datelike(f.name)]
    bad, present = F.coalesce("bad", F.lit(0)), rows - F.coalesce("missing", F.lit(0))
    many = (F.col("values") > 10) | (F.col("values") / rows > 0.05)
    typed = (present > 0) & ((present - bad) / F.nullif(present, F.lit(0)) >= DATETIME_SHARE)
    g = totals.groupBy(*by).agg(
        F.max("rows").alias("n_rows"),
        F.sum(F.when(at == -1, rows - F.col("keys"))).alias("duplicates"),
        *[F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).alias(name) for name, cond, c in (
            ("missing", at >= 0, F.col("missing")), ("negative", at.isin(money) & many, F.col("negative")),
            ("inconsistent", at.isin(dates) & typed, bad))])
    cells = F.col("n_rows") * len(fields)
    share = {"completeness": F.col("missing") / cells, "uniqueness": F.col("duplicates") / F.col("n_rows"),
             "validity": F.col("negative") / cells, "consistency": F.col("inconsistent") / cells}
    g = g.withColumns({name: F.round((1 - part) * 100, 2) for name, part in share.items()})
    score = (F.col("completeness") * 0.3 + F.col("uniqueness") * 0.25 + F.col("validity") * 0.2
             + F.col("consistency") * 0.15 + 10.0)
    return g.select(*by, F.col("n_rows").alias("rows"), *share, F.round(score, 2).alias("score"))


def measure(df: DataFrame, samples: int = SAMPLES) -> tuple[int, int, dict[str, dict]]:
    """(rows, duplicate rows, {column: missing, distinct, bad_dates, negative, samples}) from one pass.

    Nulls and NaN are missing; 0.0 and -0.0 are one value. An empty table has
    zeros throughout. What reaches the driver is one line per column.
    """
    fields = df.schema.fields
    counts = (unpivot(df, fields).groupBy("position", "value", "h1", "h2", "bad")
              .agg(F.count(F.lit(1)).alias("n")))
    totals = column_totals(counts, fields)
    # The rank filter lets Spark keep the smallest few of each task before the window's shuffle. Both branches
    # need every column of the counts and filter none of them, so their exchange is made once and used twice.
    smallest = Window.partitionBy("position").orderBy(F.asc_nulls_last("value"), "h1", "h2", "bad", "n")
    shown = (counts.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= samples).groupBy("position")
             .agg(F.array_sort(F.collect_list("value")).alias("s"))
             .select("position", F.when(F.size("s") > 0, F.array_join("s", ", ")).alias("samples")))
    got = {r["position"]: r for r in totals.join(shown, "position", "left").collect()}
    rows = got[-1]["rows"] if got else 0
    columns = {}
    for i, f in enumerate(fields):
        r = got[i].asDict() if got else {}
        columns[f.name] = {"missing": r.get("missing") or 0, "distinct": r.get("values") or 0,
                           "bad_dates": r.get("bad") or 0, "negative": r.get("negative") or 0,
                           "samples": r.get("samples")}
    return rows, rows - (got[-1]["keys"] if got else 0), columns


def _semantic_type(field: T.StructField, rows: int, m: dict, datetime_share: float) -> str:
    if _numeric_like(field.dataType):
        many = m["distinct"] > 10 or (rows > 0 and m["distinct"] / rows > 0.05)
        return "numerical" if many else "categorical/ordinal"
    if C.is_temporal(field.dataType):
        return "datetime"
    if isinstance(field.dataType, T.StringType) and _name_is_datelike(field.name):
        present = rows - m["missing"]
        if present > 0 and (present - m["bad_dates"]) / present >= datetime_share:
            return "datetime"
    return "categorical"


def _percent(part: int, whole: int) -> float:
    return float(half_up(part / whole * 100, 2)) if whole > 0 else 0.0


def _free_of(part: int, whole: int) -> float:
    """100 minus the share of ``part``, in %; 100 for an empty table."""
    return float(half_up((1 - part / whole) * 100, 2)) if whole > 0 else 100.0


class Measured:
    """What one pass found: the profile's lines and the quality dimensions, all read off ``measure``."""

    def __init__(self, df: DataFrame, samples: int = SAMPLES, datetime_share: float = DATETIME_SHARE):
        self.fields = df.schema.fields
        self.rows, self.duplicates, self.columns = measure(df, samples)
        self.cells = self.rows * len(self.fields)
        self.types = {f.name: _semantic_type(f, self.rows, self.columns[f.name], datetime_share)
                      for f in self.fields}
        self.signed = [f.name for f in self.fields if self.types[f.name] == "numerical"
                       and any(k in f.name.lower() for k in C.VALIDITY_KEYWORDS)]
        self.dated = [f.name for f in self.fields
                      if self.types[f.name] == "datetime" and isinstance(f.dataType, T.StringType)]
        self.missing = sum(m["missing"] for m in self.columns.values())
        self.negative = sum(self.columns[c]["negative"] for c in self.signed)
        self.inconsistent = sum(self.columns[c]["bad_dates"] for c in self.dated)

    def lines(self) -> list[tuple]:
        return [(f.name, i, f.dataType.simpleString(), self.types[f.name], int(m["missing"]),
                 _percent(m["missing"], self.rows), int(m["distinct"]), m["samples"])
                for i, f in enumerate(self.fields) for m in [self.columns[f.name]]]

    def issues(self, outliers_pct: float, limit: int) -> list[str]:
        out = []
        for f in self.fields:
            name, m = f.name, self.columns[f.name]
            share = _percent(m["missing"], self.rows)
            if share > 5.0:
                out.append(ISSUE_MISSING.format(column=name, pct=share))
            if name in self.signed and m["negative"] > 0:
                out.append(ISSUE_NEGATIVE.format(column=name, count=m["negative"]))
            if name in self.dated and m["bad_dates"] > 0:
                out.append(ISSUE_BAD_DATES.format(column=name, count=m["bad_dates"]))
        if outliers_pct > 5.0:
            out.append(ISSUE_OUTLIERS.format(pct=outliers_pct))
        return out[:limit]


def profile(df: DataFrame, samples: int = SAMPLES, datetime_share: float = DATETIME_SHARE) -> DataFrame:
    """Per column: dtype, semantic type, missing count/%, distinct count, samples.

    Semantic type: numeric with more than 10 distinct values (or distinct/rows
    > 5 %) is ``numerical``, other numeric ``categorical/ordinal``; temporal
    columns, and string columns named like a date/time whose non-null values
    parse at least ``datetime_share`` of the time, are ``datetime``; the rest
    ``categorical``. Samples are the ``samples`` smallest distinct values, each
    shown up to ``KEY_CHARS`` characters.
    """
    schema = ("column string, position int, dtype string, semantic_type string, missing_count bigint, "
              "missing_pct double, distinct_count bigint, sample_values string")
    return df.sparkSession.createDataFrame(Measured(df, samples, datetime_share).lines(), schema)


# ---------------------------------------------------------------- DQ2–DQ5
def completeness(df: DataFrame) -> DataFrame:
    cells = F.lit(len(df.columns)) * F.count(F.lit(1))
    missing = sum((F.count_if(_is_missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(cells.cast("bigint").alias("total_cells"), missing.cast("bigint").alias("missing_cells")).select(
        "total_cells", "missing_cells",
        F.when(F.col("total_cells") > 0,
               F.round((1 - F.col("missing_cells") / F.col("total_cells")) * 100, 2))
        .otherwise(F.lit(100.0)).alias("completeness"))


def uniqueness(df: DataFrame) -> DataFrame:
    """1 − duplicate rows / rows, in %, from one count per row hash. Duplicates compare nulls as equal."""
    h1, h2 = _row_hashes(df)
    per_row = df.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows")
    return per_row.agg(total, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")).select(
        "total_rows", "duplicate_rows",
        F.when(F.col("total_rows") > 0, F.round((1 - F.col("duplicate_rows") / F.col("total_rows")) * 100, 2))
        .otherwise(F.lit(100.0)).alias("uniqueness"))


def validity(df: DataFrame) -> DataFrame:
    """Negative values in numerical columns named like money or quantities, over all cells, in %."""
    m = Measured(df)
    return df.sparkSession.createDataFrame([(m.cells, m.negative, _free_of(m.negative, m.cells))],
                                           "total_cells bigint, negative_values bigint, validity double")


def consistency(df: DataFrame) -> DataFrame:
    """Unparseable values in string columns typed ``datetime``, over all cells, in %."""
    m = Measured(df)
    return df.sparkSession.createDataFrame([(m.cells, m.inconsistent, _free_of(m.inconsistent, m.cells))],
                                           "total_cells bigint, inconsistent_values bigint, consistency double")


# ---------------------------------------------------------------- DQ6–DQ8
def outlier_share(df: DataFrame, trees: int = 50, seed: int = 42) -> float:
    """% rows an isolation forest (default threshold) flags, on median-filled numerics."""
    from ledgerline.operators import anomaly
    num = C.numeric_columns(df)
    n = df.count()
    if not num or n <= 5:
        return 0.0
    flagged = anomaly.isolation_forest_flags(df, num, trees=trees, contamination=None, seed=seed)
    count = flagged.where("is_outlier").count()
    return half_up(count / n * 100, 2)


def quality(df: DataFrame, with_outliers: bool = True, seed: int = 42) -> DataFrame:
    """One row: the five dimensions, the 0–100 score and the first 10 issues; one pass, then the forest's."""
    schema = ("score double, completeness double, validity double, consistency double, uniqueness double, "
              "outliers_pct double, issues array<string>")
    m = Measured(df)
    if m.rows == 0:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, ["Dataset is empty."])], schema)
    complete, unique = _free_of(m.missing, m.cells), _free_of(m.duplicates, m.rows)
    valid, consistent = _free_of(m.negative, m.cells), _free_of(m.inconsistent, m.cells)
    outliers = outlier_share(df, seed=seed) if with_outliers else 0.0
    score = complete * 0.3 + unique * 0.25 + valid * 0.2 + consistent * 0.15 + (100.0 - outliers) * 0.1
    score = half_up(max(0.0, min(100.0, score)), 2)
    return df.sparkSession.createDataFrame(
        [(score, complete, valid, consistent, unique, outliers, m.issues(outliers, 10))], schema)


def quality_issues(df: DataFrame, outliers_pct: float = 0.0, limit: int = 10) -> DataFrame:
    """Issue lines in column order: missing > 5 %, negatives, bad dates; outliers > 5 %."""
    lines = Measured(df).issues(outliers_pct, limit)
    return df.sparkSession.createDataFrame(list(enumerate(lines, 1)), "position int, issue string")
