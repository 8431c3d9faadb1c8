"""The 0-100 health value, its categories and its distributions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import dimensions as dims
from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import healthiness, risk_category
from busvitals.operators.ordering import attach
from busvitals.operators.quantiles import exact_percentiles

PARTS = ["cyber_health", "threat_component", "stability_component", "pressure_component"]
BIN = 5
BINS = 20
GRID = 500


def _part(columns: list[str], direction: str, weight: float) -> Column:
    values = [healthiness(F.col(c), F.col(f"m_{c}"), F.col(f"s_{c}"), direction) for c in columns]
    return functools.reduce(operator.add, values) / F.lit(float(len(values))) * F.lit(weight)


def health_score(scored: DataFrame, baseline: DataFrame, digits: int | None = None) -> DataFrame:
    """Components, total and category per window. With ``digits`` the values are rounded after categorising."""
    out = attach(scored, baseline).withColumns(
        {
            "threat_component": _part(["anomaly_score"], "negative", fv.THREAT_WEIGHT),
            "stability_component": _part(fv.STABILITY_FEATURES, "both", fv.STABILITY_WEIGHT),
            "pressure_component": _part(fv.PRESSURE_FEATURES, "positive", fv.PRESSURE_WEIGHT),
        }
    )
    total = F.col("threat_component") + F.col("stability_component") + F.col("pressure_component")
    clipped = F.when(total.isNotNull(), F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)))
    out = out.withColumn("cyber_health", clipped).withColumn("risk_category", risk_category(F.col("cyber_health")))
    if digits is not None:
        out = out.withColumns({c: F.bround(c, digits) for c in PARTS})
    return out.drop(*baseline.columns)


def filter_by_class(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one class, whatever the case of the name; ``attack`` selects every class but Normal."""
    if name.lower() == "attack":
        return rows.where(F.col("attack_type") != "Normal")
    return rows.where(F.lower("attack_type") == name.lower())


def filter_extreme(health: DataFrame, name: str | None = None) -> DataFrame:
    extreme = health.where(F.col("risk_category").isin("High Risk", "Critical"))
    return extreme.where(F.col("attack_type") == name) if name else extreme


def health_summary(health: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """``sketches``: stored ones of all healths, by any keys."""
    plain = health.agg(
        F.count("cyber_health").alias("n"),
        F.avg("cyber_health").alias("mean_health"),
        F.stddev_samp("cyber_health").alias("std_health"),
        F.min("cyber_health").alias("min_health"),
        F.max("cyber_health").alias("max_health"),
    )
    ranks = exact_percentiles(health, [], "cyber_health", {"p25_health": 0.25, "median_health": 0.5, "p75_health": 0.75}, sketches=sketches)
    return attach(plain, ranks)


def category_distribution(health: DataFrame) -> DataFrame:
    """Count and share of every category, absent ones included."""
    counts = health.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))
    filled = dims.categories(health.sparkSession).join(F.broadcast(counts), "risk_category", "left").select(
        "category_ord", "risk_category", F.coalesce("n", F.lit(0)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy())
    return filled.withColumn("pct", F.bround(F.try_divide(F.col("n") * F.lit(100.0), total), 1))


def health_by_attack(health: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """Count, mean, median and most frequent category (alphabetically first on ties) per class. ``sketches``: stored ones of all
    healths, by class or finer."""
    plain = health.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.avg("cyber_health").alias("mean_health"))
    median = exact_percentiles(health, ["attack_type"], "cyber_health", {"median_health": 0.5}, sketches=sketches)
    per = health.groupBy("attack_type", "risk_category").agg(F.count(F.lit(1)).alias("_c"))
    modal = per.groupBy("attack_type").agg(
        F.min(F.struct((-F.col("_c")).alias("_neg"), "risk_category"))["risk_category"].alias("modal_category")
    )
    return plain.join(F.broadcast(median), "attack_type", "left").join(F.broadcast(modal), "attack_type", "left")


def attack_counts(health: DataFrame) -> DataFrame:
    return health.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.avg("cyber_health").alias("mean_health"))


def health_histogram(health: DataFrame) -> DataFrame:
    """Counts per 5-point bin; 100 belongs to the last bin. Empty bins are listed too."""
    bins = health.where("cyber_health IS NOT NULL").groupBy(
        F.least(F.floor(F.col("cyber_health") / BIN), F.lit(BINS - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = health.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(bins), "bin", "left").select(
        "bin", (F.col("bin") * BIN).alias("bin_from"), F.coalesce("n", F.lit(0)).alias("n")
    )


def kde_on_grid(health: DataFrame) -> DataFrame:
    """Gaussian density of the health values on 500 points over 0..100, scaled to histogram counts.

    Health rounded to two decimals has at most 10,001 distinct values, so the sum runs over value counts and its
    work does not depend on the number of windows.
    """
    counts = health.where("cyber_health IS NOT NULL").groupBy(F.bround("cyber_health", 2).alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    spread = counts.agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("_mean"),
    )
    moments = attach(counts, spread).groupBy("n").agg(
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("_mean"), 2)) / (F.first("n") - 1)).alias("_std")
    ).select("n", (F.col("_std") * F.pow(F.col("n").cast("double"), -0.2)).alias("bw"))
    on_grid = attach(counts, moments).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn(
        "x", F.col("i") * F.lit(100.0) / F.lit(GRID - 1.0)
    )
    bump = F.col("c") * F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("bw"), 2) / 2)
    norm = F.first("bw") * F.sqrt(F.lit(2.0) * F.pi())
    return on_grid.groupBy("i", "x").agg((F.sum(bump) / norm * BIN).alias("density"))
