"""Drift, model-health, problem-type and split queries, plus model jobs (ML1–ML19, SRC7, SRC8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.exprs import stable_split_bucket
from ledgerline.operators import drift
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

_DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

def _ks_sql(src: str, feats: list[str]) -> str:
    """KS in SQL: cumulative shares over the distinct values of both samples.

    ``src`` yields the feature columns plus ``is_cur`` (0 = train, 1 = current).
    """
    values = ", ".join(f"('{f}', s.{f}::DOUBLE)" for f in feats)
    return f"""
WITH both_s AS (
  SELECT f.feature, f.value, s.is_cur FROM ({src}) s,
  LATERAL (VALUES {values}) AS f(feature, value)
  WHERE f.value IS NOT NULL),
c AS (SELECT feature, value, count_if(is_cur = 0) AS c1, count_if(is_cur = 1) AS c2 FROM both_s GROUP BY 1, 2),
cum AS (SELECT feature, sum(c1) OVER w AS k1, sum(c2) OVER w AS k2, sum(c1) OVER (PARTITION BY feature) AS n1,
               sum(c2) OVER (PARTITION BY feature) AS n2
        FROM c WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(n1) AS n_train, max(n2) AS n_current, max(abs(k1 / n1 - k2 / n2)) AS ks FROM cum GROUP BY 1),
z AS (SELECT *, sqrt(n_train * n_current / (n_train + n_current)) * ks AS zz FROM d),
p AS (SELECT feature, CASE WHEN zz <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * sum(
               pow(-1.0, k - 1) * exp(-2.0 * k * k * zz * zz)))) END AS p_value
      FROM z, range(1, 101) AS r(k) GROUP BY feature, zz),
ks AS (SELECT z.feature, n_train::BIGINT AS n_train, n_current::BIGINT AS n_current, round(ks, 4) AS ks_statistic,
              round(p.p_value, 4) AS p_value, p.p_value < 0.05 AS drift_detected
       FROM z JOIN p USING (feature) WHERE n_train >= 6 AND n_current >= 6)
"""


_KS_SQL = _ks_sql("""SELECT l_quantity, l_extendedprice, l_discount, l_tax,
           CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS is_cur FROM lineitem""",
                  _DRIFT_FEATURES)

_TEXT_FEATURES_SQL = """length(text)::DOUBLE AS n_chars,
       len(regexp_split_to_array(trim(text), '\\s+'))::DOUBLE AS n_words,
       len(string_split(text, chr(10)))::DOUBLE AS n_lines"""
_TEXT_KS_SQL = _ks_sql(f"""SELECT {_TEXT_FEATURES_SQL}, 0 AS is_cur FROM documents
                          UNION ALL SELECT {_TEXT_FEATURES_SQL}, 1 AS is_cur FROM conversations""",
                       ["n_chars", "n_words", "n_lines"])


def _drift(spark, sf):
    li = table(spark, sf, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return drift.drift(li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut), _DRIFT_FEATURES)


@register("ML16", sql=_KS_SQL + "SELECT * FROM ks")
def ml16(spark, sf):
    return _drift(spark, sf)


@register("ML17", sql=_KS_SQL + """
, s AS (SELECT round(coalesce(avg(drift_detected::DOUBLE) * 100, 0.0), 2) AS drift_percentage,
               count(*) AS features_tested FROM ks)
SELECT drift_percentage, features_tested, round(drift_percentage * 0.35, 2) AS model_drift_percentage,
       CASE WHEN round(drift_percentage * 0.35, 2) > 25 THEN 'critical'
            WHEN round(drift_percentage * 0.35, 2) > 15 OR drift_percentage > 25 THEN 'at_risk' ELSE 'healthy' END AS status,
       (round(drift_percentage * 0.35, 2) > 15 OR drift_percentage > 25) AS retraining_recommended
FROM s
""")
def ml17(spark, sf):
    return drift.model_health(_drift(spark, sf), target_present=True)


def text_features(df, text_col="text"):
    """Length features of a text column: characters, words, lines."""
    return df.select(F.length(text_col).cast("double").alias("n_chars"),
                     F.size(F.split(F.trim(F.col(text_col)), r"\s+")).cast("double").alias("n_words"),
                     F.size(F.split(F.col(text_col), "\\n")).cast("double").alias("n_lines"))


def _text_drift(spark, sf):
    """A text model fitted on documents, monitored on conversation turns."""
    train = text_features(table(spark, sf, "documents"))
    current = text_features(table(spark, sf, "conversations"))
    return drift.drift(train, current, ["n_chars", "n_words", "n_lines"])


@register("ML16_TEXT", sql=_TEXT_KS_SQL + "SELECT * FROM ks")
def ml16_text(spark, sf):
    return _text_drift(spark, sf)


@register("ML2", sql="""
SELECT o_orderkey, CASE WHEN ((o_orderkey % 2147483647) * 48271 % 2147483647) % 100 < 80 THEN 'train' ELSE 'test' END
       AS split FROM orders
""")
def ml2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.withColumn("split", F.when(stable_split_bucket(F.col("o_orderkey")) < 80, "train").otherwise("test"))


# ---------------------------------------------------------------- model jobs (rows-only)
from ledgerline.operators import automl, personas  # noqa: E402
from ledgerline.session import scratch_path  # noqa: E402

_TRAINED: dict = {}


def orders_status_data(spark, sf):
    """Classification task: order status from price, priority and date."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate",
                                             "o_orderstatus")


def doc_quality_data(spark, sf):
    """Binary task: document quality label from length, language and source."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")


def line_price_data(spark, sf):
    """Regression task: line price from quantity, discount, tax and part attributes."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", "l_shipdate",
                                             "l_extendedprice")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size", "p_type")
    return li.join(p, "l_partkey").drop("l_partkey")


def _trained(spark, sf, task):
    key = (sf, task)
    if key not in _TRAINED:
        if task == "cls":
            d = orders_status_data(spark, sf).drop("o_orderkey")
            _TRAINED[key] = automl.train(d, "o_orderstatus")
        elif task == "bin":
            d = doc_quality_data(spark, sf).drop("doc_id")
            _TRAINED[key] = automl.train(d, "quality", problem="classification")
        elif task == "score_cls":     # the scoring queries use one named model
            d = orders_status_data(spark, sf).drop("o_orderkey")
            _TRAINED[key] = automl.train(d, "o_orderstatus", models=["Gradient Boosting"], tune=False)
        elif task == "score_reg":
            _TRAINED[key] = automl.train(line_price_data(spark, sf), "l_extendedprice", models=["Linear Regression"])
        elif task == "subset":
            d = doc_quality_data(spark, sf).drop("doc_id")
            _TRAINED[key] = automl.train(d, "quality", problem="classification",
                                         models=["Linear Regression", "decision tree "])
        else:
            _TRAINED[key] = automl.train(line_price_data(spark, sf), "l_extendedprice")
    return _TRAINED[key]


@register("ML1", sql="""
WITH s AS (SELECT count(*) AS n, count(DISTINCT l_linenumber) AS d1, count(DISTINCT l_quantity) AS d2,
                  count(DISTINCT l_discount) AS d3, count(DISTINCT l_tax) AS d4,
                  count(DISTINCT l_extendedprice) AS d5, count(DISTINCT l_returnflag) AS d6 FROM lineitem),
c AS (SELECT 'l_linenumber' AS "column", d1 AS d, n, TRUE AS num FROM s UNION ALL
      SELECT 'l_quantity', d2, n, TRUE FROM s UNION ALL SELECT 'l_discount', d3, n, TRUE FROM s UNION ALL
      SELECT 'l_tax', d4, n, TRUE FROM s UNION ALL SELECT 'l_extendedprice', d5, n, TRUE FROM s UNION ALL
      SELECT 'l_returnflag', d6, n, FALSE FROM s)
SELECT "column",
       CASE WHEN num AND (d > 10 OR d / n > 0.05) THEN 'numerical' WHEN num THEN 'categorical/ordinal'
            ELSE 'categorical' END AS semantic_type,
       d AS distinct_count,
       CASE WHEN num AND (d > 10 OR d / n > 0.05) AND d > 15 THEN 'regression' ELSE 'classification' END AS problem_type
FROM c
""")
def ml1(spark, sf):
    return automl.problem_types(table(spark, sf, "lineitem"),
                                ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
                                 "l_returnflag"])


@register("ML3", note="classification leaderboard (order status); rows-only")
def ml3(spark, sf):
    return _trained(spark, sf, "cls").leaderboard


@register("ML4", note="regression leaderboard (line price); rows-only")
def ml4(spark, sf):
    return _trained(spark, sf, "reg").leaderboard


@register("ML5", note="user-selected subset with linear/logistic alias; rows-only")
def ml5(spark, sf):
    return _trained(spark, sf, "subset").leaderboard.select("rank", "model_name", "score", "status")


@register("ML6", note="binary classification metrics incl. ROC AUC and confusion matrix; rows-only")
def ml6(spark, sf):
    return _trained(spark, sf, "bin").leaderboard.select("model_name", "accuracy", "precision", "recall",
                                                         "f1_score", "roc_auc", "confusion_matrix", "status")


@register("ML7", note="regression metrics of the winner; rows-only")
def ml7(spark, sf):
    r = _trained(spark, sf, "reg")
    m = r.best_metrics
    return spark.createDataFrame([(r.best_name, m.get("r2_score"), m.get("mse"), m.get("mae"))],
                                 "model_name string, r2_score double, mse double, mae double")


@register("ML8", note="5-fold cross-validation score per candidate; rows-only")
def ml8(spark, sf):
    return _trained(spark, sf, "reg").leaderboard.select("model_name", "cv_score")


@register("ML9", note="leaderboard ordered by holdout score; rows-only")
def ml9(spark, sf):
    return _trained(spark, sf, "cls").leaderboard.orderBy("rank").select("rank", "model_name", "score", "status")


@register("ML10", note="feature importance of the winner; rows-only")
def ml10(spark, sf):
    return _trained(spark, sf, "reg").importance


@register("ML11", note="winner after grid search (tuned flag); rows-only")
def ml11(spark, sf):
    r = _trained(spark, sf, "reg")
    return spark.createDataFrame([(r.best_name, float(r.best_metrics["score"]))], "model_name string, score double") \
        .join(r.leaderboard.select("model_name", "tuned"), "model_name")


@register("ML12", note="batch scoring; rows-only")
def ml12(spark, sf):
    return automl.score(_trained(spark, sf, "score_reg"), line_price_data(spark, sf))


@register("ML13", note="importance × value contributions for every row; rows-only")
def ml13(spark, sf):
    data = line_price_data(spark, sf).withColumn("row_key", F.xxhash64(*line_price_data(spark, sf).columns))
    return automl.contributions(_trained(spark, sf, "score_reg"), data, "row_key")


@register("ML14", note="what-if: regression mean shift; rows-only")
def ml14(spark, sf):
    return automl.what_if(_trained(spark, sf, "score_reg"), line_price_data(spark, sf), {"l_discount": 0.1})


@register("ML14_CLASS", note="what-if: class distribution shift; rows-only")
def ml14_class(spark, sf):
    data = orders_status_data(spark, sf).drop("o_orderkey")
    return automl.what_if(_trained(spark, sf, "score_cls"), data, {"o_orderpriority": "1-URGENT"})


@register("ML15", note="local perturbation drivers for every order; rows-only")
def ml15(spark, sf):
    r = _trained(spark, sf, "score_cls")
    data = orders_status_data(spark, sf)
    return automl.drivers(automl.explain(r, data, "o_orderkey"), "o_orderkey")


@register("ML18", note="k-means personas (10 restarts); rows-only")
def ml18(spark, sf):
    p = personas.personas(line_price_data(spark, sf))
    return p.select("rank", "persona", "kpi", "count", "percentage", F.to_json("centroid").alias("centroid"))


@register("ML19", sql="""
WITH s AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem)
SELECT 'classification' AS problem_type, 'l_returnflag' AS target, n AS row_count, k AS distinct_target,
       m.model_name, m.display_name, m.badge, m.rec AS recommended_for_user,
       CASE m.model_name WHEN 'XGBoost' THEN '★★★★★'
                         WHEN 'Random Forest' THEN CASE WHEN n < 10000 THEN '★★★★★' ELSE '★★★★☆' END
                         WHEN 'LightGBM' THEN CASE WHEN n > 2000 THEN '★★★★★' ELSE '★★★☆☆' END
                         ELSE CASE WHEN n > 5000 THEN '★★★★☆' ELSE '★★☆☆☆' END END AS suitability,
       m.plain_english_advice, m.business_impact, m.best_when,
       'Predicting Category Column (''l_returnflag''): You are predicting discrete groups or outcomes (' || k
       || ' distinct classes found). Tree Ensembles (XGBoost, Random Forest) are recommended because they discover '
       || 'hidden decision rules between customer attributes without requiring complex data transformations.'
       AS business_summary
FROM s, (VALUES
  ('XGBoost', 'XGBoost (Gradient Boosted Decision Trees)', '🏆 Best Overall Accuracy', TRUE,
   'Top recommendation for predicting business categories. It builds successive smart decision trees to achieve maximum predictive accuracy.',
   'Reduces false prediction errors by up to 25% on complex dataset patterns.', 'When accuracy is your #1 priority.'),
  ('Random Forest', 'Random Forest (Ensemble Averaging)', '🛡️ Most Reliable & Explainable', TRUE,
   'Combines hundreds of independent decision trees to produce reliable, trustworthy predictions resistant to data errors.',
   'Extremely stable; provides clear reports on which features drive outcomes most.',
   'When you need clean explanations for business stakeholders.'),
  ('LightGBM', 'LightGBM (High-Speed Gradient Booster)', '🚀 Ultra Fast Training', FALSE,
   'Optimized high-speed boosting algorithm built for very large business datasets.',
   'Trains in seconds even on large datasets with hundreds of thousands of records.',
   'When processing massive datasets quickly.'),
  ('Neural Network', 'Neural Network (Multi-Layer Perceptron)', '🧠 Deep Pattern Matcher', FALSE,
   'Deep artificial neural network that learns multi-layered complex interactions.',
   'Captures intricate non-linear relationships across many columns.',
   'When you have large datasets with complex relationships.'))
        AS m(model_name, display_name, badge, rec, plain_english_advice, business_impact, best_when)
""")
def ml19(spark, sf):
    return automl.advise(table(spark, sf, "lineitem"), "l_returnflag", "classification")


@register("ML6_ROC", note="ROC points of every binary candidate on the holdout; rows-only, curve tested against NumPy")
def ml6_roc(spark, sf):
    return _trained(spark, sf, "subset").roc


@register("SRC7", note="scored table written beside the input and read back; rows-only")
def src7(spark, sf):
    path = scratch_path(spark, "scored")
    automl.score(_trained(spark, sf, "score_reg"), line_price_data(spark, sf)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("SRC8", note="model saved, reloaded and used to score; rows-only")
def src8(spark, sf):
    r = _trained(spark, sf, "bin")
    path = scratch_path(spark, "model")
    automl.save_model(r, path)
    loaded = automl.load_model(path)
    data = doc_quality_data(spark, sf)
    return loaded.transform(data).select("doc_id", F.col("predicted_label").alias("predicted_quality"))
