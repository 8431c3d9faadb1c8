"""From scores to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.ordering import attach
from busvitals.operators.quantiles import exact_percentiles


def score_threshold(scored: DataFrame, score: str = "anomaly_score", sketches: DataFrame | None = None) -> DataFrame:
    """The 5th percentile of the normal scores, exact and interpolated. ``sketches``: stored ones of all scores, by ``attack_label``
    or finer."""
    return _of_normal(scored, score, {"threshold": fv.THRESHOLD_PERCENTILE}, sketches)


def median_score(scored: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    return _of_normal(scored, "anomaly_score", {"median_score": 0.5}, sketches)


def _of_normal(scored: DataFrame, score: str, probs: dict[str, float], sketches: DataFrame | None) -> DataFrame:
    normal = "attack_label = 0"
    return exact_percentiles(scored.where(normal), [], score, probs, sketches=None if sketches is None else sketches.where(normal))


def classify_anomaly(scored: DataFrame, threshold: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """``is_anomaly`` = 1 strictly below the threshold; a missing score is not flagged."""
    return attach(scored, threshold).withColumn("is_anomaly", F.coalesce((F.col(score) < F.col("threshold")).cast("int"), F.lit(0)))


def detection_confidence(classified: DataFrame) -> DataFrame:
    """Distance to the threshold in units of twice the spread of all scores, at most 1."""
    spread = classified.agg(F.stddev_pop("anomaly_score").alias("_spread"))
    return attach(classified, spread).withColumn(
        "confidence",
        F.least(F.lit(1.0), F.try_divide(F.abs(F.col("anomaly_score") - F.col("threshold")), F.col("_spread") * 2)),
    ).drop("_spread")


def detect(scored: DataFrame) -> DataFrame:
    """Threshold, classification and confidence in one go."""
    return detection_confidence(classify_anomaly(scored, score_threshold(scored)))
