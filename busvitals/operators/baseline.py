"""Statistics of normal traffic and what is expressed relative to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import zscore
from busvitals.operators.ordering import attach

WITH_SCORE = [*fv.FEATURES, "anomaly_score"]


def fit_baseline(
    windows: DataFrame, columns: Sequence[str] = tuple(WITH_SCORE), ddof: int = 0, floor: float | None = 1e-10
) -> DataFrame:
    """One row with ``m_<column>`` and ``s_<column>`` over the normal windows that are complete.

    ``ddof`` 0 with a floor is the health engine's variant; ``ddof`` 1 the service's, where the score still uses
    the population deviation.
    """
    normal = windows.where("attack_label = 0").dropna(subset=list(columns))
    parts = []
    for c in columns:
        std = F.stddev_samp(c) if ddof == 1 and c != "anomaly_score" else F.stddev_pop(c)
        parts += [F.avg(c).alias(f"m_{c}"), (F.greatest(std, F.lit(floor)) if floor and ddof == 0 else std).alias(f"s_{c}")]
    return normal.agg(*parts)


def baseline_table(wide: DataFrame) -> DataFrame:
    """The one-row baseline as (feature, mean, std)."""
    names = [c[2:] for c in wide.columns if c.startswith("m_")]
    rows = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), F.col(f"s_{n}").alias("std")) for n in names
    ])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def baseline_wide(table: DataFrame, columns: Sequence[str] = tuple(WITH_SCORE)) -> DataFrame:
    """(feature, mean, std) rows back to one row."""
    return table.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"{p}_{c}") for c in columns for p, s in (("m", "mean"), ("s", "std"))]
    )


def baseline_join(windows: DataFrame, wide: DataFrame) -> DataFrame:
    return attach(windows, wide)


def standard_scale(windows: DataFrame, fit: str = "normal") -> DataFrame:
    """Features as z-scores with the population deviation, fitted on the normal windows or on all of them."""
    rows = windows.withColumn("attack_label", F.lit(0)) if fit == "all" else windows
    wide = fit_baseline(rows, fv.FEATURES, ddof=0, floor=None)
    scaled = attach(windows, wide)
    return scaled.withColumns(
        {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in fv.FEATURES}
    ).select(*windows.columns)


def zscores_long(windows: DataFrame, wide: DataFrame, columns: Sequence[str] = tuple(WITH_SCORE), keep: Sequence[str] = ("vehicle_id", "capture", "w")) -> DataFrame:
    """(keys, feature, value, z): one row per window and feature."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 zscore(F.col(c), F.col(f"m_{c}"), F.col(f"s_{c}")).alias("z"))
        for c in columns
    ])
    return attach(windows, wide).select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")
