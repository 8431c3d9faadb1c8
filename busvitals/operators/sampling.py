"""Draws without replacement that depend only on the row key and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.ordering import attach

_HEX_DIGITS = 15


def draw_key(keys: Sequence[str], seed: int) -> Column:
    """Hex text that orders the rows of a draw."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def sample_rows(df: DataFrame, keys: Sequence[str], size: int, seed: int = fv.SEED) -> DataFrame:
    """At most ``size`` rows: those with the smallest draw keys.

    A cut on the key keeps about size + 10*sqrt(size) rows before the final sort, so that sort stays small
    however many rows there are; missing the cut would take a ten-sigma event.
    """
    room = size + 10 * math.sqrt(size) + 10
    count = df.agg(F.count(F.lit(1)).alias("_rows"))
    leading = F.conv(F.substring("_draw", 1, _HEX_DIGITS), 16, 10).cast("double")
    return (
        attach(df.withColumn("_draw", draw_key(keys, seed)), count)
        .where(leading * F.col("_rows") <= F.lit(room * 16.0**_HEX_DIGITS))
        .orderBy("_draw", *keys)
        .limit(size)
        .drop("_draw", "_rows")
    )


def subsample_normal(windows: DataFrame, size: int = fv.MAX_TRAIN_ROWS, seed: int = fv.SEED) -> DataFrame:
    """The training draw: at most ``size`` complete normal windows."""
    complete = windows.where("attack_label = 0").dropna(subset=fv.FEATURES)
    return sample_rows(complete, ["vehicle_id", "capture", "w"], size, seed)
