"""The fixed values as small DataFrames to join with (every one has a fixed number of rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv


def _dim(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def classes(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(c, i) for i, c in enumerate(fv.CLASSES)], "attack_type string, class_ord int")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(c, lo, i) for i, (c, lo) in enumerate(fv.CATEGORIES)]
    return _dim(spark, rows, "risk_category string, lower_bound double, category_ord int")


def feature_categories(spark: SparkSession) -> DataFrame:
    return _dim(spark, fv.FEATURE_CATEGORY, "feature string, category string")


def tracked_features(spark: SparkSession) -> DataFrame:
    rows = [(*t, i) for i, t in enumerate(fv.TRACKED)]
    return _dim(
        spark, rows, "feature string, label string, audience string, component string, direction string, ordinal int"
    )


def ecus(spark: SparkSession) -> DataFrame:
    rows = [(*e, i) for i, e in enumerate(fv.ECUS)]
    return _dim(spark, rows, "ecu_id string, ecu_name string, rate_frac double, ord int")


def targets(spark: SparkSession) -> DataFrame:
    return _dim(spark, fv.TARGETS, "attack_type string, ecu_id string, ecu_name string")


def category_routing(spark: SparkSession) -> DataFrame:
    return _dim(spark, fv.CATEGORY_ROUTING, "risk_category string, audience string, channel string, urgency string")


def templates(spark: SparkSession) -> DataFrame:
    return _dim(
        spark,
        fv.TEMPLATES,
        "category string, summary_t string, trend_t string, root_t string, forecast_t string, response_t string",
    )


def attacks(spark: SparkSession) -> DataFrame:
    return _dim(
        spark,
        fv.ATTACKS,
        "attack_type string, attack_label_text string, mechanism string, signature string, impact string, "
        "mitigation string",
    )


def levels(spark: SparkSession) -> DataFrame:
    return _dim(
        spark, [(*level, text) for level, text in zip(fv.LEVELS, fv.LEVEL_DESCRIPTIONS)],
        "response_level int, level_label string, outcome string, recovery string, safety string, description string",
    )


def playbook(spark: SparkSession) -> DataFrame:
    rows = [(*p, i) for i, p in enumerate(fv.PLAYBOOK)]
    return _dim(
        spark,
        rows,
        "attack_type string, action_level int, id string, name string, description string, target string, "
        "execution_time_ms int, automated boolean, reversible boolean, side_effects string, ord int",
    )


def class_ordinal(column: str = "attack_type"):
    """Position of a class in concatenation order, as an expression."""
    expr = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(fv.CLASSES))):
        expr = F.when(F.col(column) == c, F.lit(i)).otherwise(expr)
    return expr
