"""Time-series questions over densely numbered windows.

``keys`` name a series, ``idx`` its dense integer position, ``value`` the measured column. Nothing here sorts a
whole series in one task: ends of a series are found by position, neighbourhoods by halo blocks, and runs by one
carried value per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import trend_label
from busvitals.operators.ordering import attach, halo_blocks, halo_window, own_rows

FINE = 2.0**-60  # weights below this share of the newest one are beneath the resolution of a double
LONGEST_KERNEL = 1_024  # a longer memory is carried from block to block instead of being folded anew at every row


def kernel_rows(alpha: float) -> int:
    """Rows back after which a smoothing with this alpha has forgotten a value."""
    return 0 if alpha >= 1 else math.ceil(math.log(FINE) / math.log1p(-alpha))


def _with_ends(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Distance to the last row (``_e``), first position (``_lo``) and length (``_n``) of the series."""
    ends = df.groupBy(*keys).agg(F.max(idx).alias("_hi"), F.min(idx).alias("_lo"))
    joined = df.join(ends, list(keys)) if keys else attach(df, ends)
    return joined.withColumns({"_e": F.col("_hi") - F.col(idx), "_n": F.col("_hi") - F.col("_lo") + 1})


def step_trend(df: DataFrame, keys: Sequence[str], idx: str, value: str, block: int = 65_536) -> DataFrame:
    """Label (``trend``) of the step from the row before to each row; Stable where no row has the position before."""
    before = F.lag(F.struct(idx, value)).over(halo_window(keys, idx))
    framed = halo_blocks(df, idx, behind=1, block=block).withColumn("_before", before)
    step = F.when(F.col("_before")[idx] == F.col(idx) - 1, F.col(value) - F.col("_before")[value])
    return own_rows(framed.withColumn("trend", trend_label(step))).drop("_before")


def trend_last(df: DataFrame, keys: Sequence[str], idx: str, value: str, lookback: int = 10) -> DataFrame:
    """Mean of the last ``lookback`` rows minus the mean of those before; Stable with 0 below two lookbacks."""
    tail = _with_ends(df, keys, idx).where(F.col("_e") < 2 * lookback)
    means = tail.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        F.avg(F.when(F.col("_e") < lookback, F.col(value))).alias("_recent"),
        F.avg(F.when(F.col("_e") >= lookback, F.col(value))).alias("_before"),
    )
    diff = F.when(F.col("n") < 2 * lookback, F.lit(0.0)).otherwise(F.col("_recent") - F.col("_before"))
    return means.withColumn("_d", diff).select(
        *keys, "n", trend_label(F.col("_d")).alias("trend"), F.bround("_d", 2).alias("trend_diff")
    )


def trend_at_window(df: DataFrame, keys: Sequence[str], idx: str, value: str, block: int = 65_536) -> DataFrame:
    """At every row: mean of rows [i-10, i] minus mean of rows [i-20, i-11]; without earlier rows Stable.

    A series of fewer than 20 rows is Stable with 0 throughout.
    """
    w = halo_window(keys, idx)
    diff = F.avg(value).over(w.rowsBetween(-10, 0)) - F.avg(value).over(w.rowsBetween(-20, -11))
    framed = halo_blocks(_with_ends(df, keys, idx), idx, behind=20, block=block).withColumn(
        "_d", F.when(F.col("_n") < 20, F.lit(0.0)).otherwise(diff)
    ).drop("_hi", "_lo", "_e", "_n")
    return own_rows(framed).withColumns({"trend": trend_label(F.col("_d")), "trend_diff": F.col("_d")}).drop("_d")


def ema_level(df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float = fv.EMA_ALPHA) -> DataFrame:
    """Last value of the exponential smoothing, in closed form, with the length and mean of the series."""
    ended = _with_ends(df, keys, idx)
    weight = F.when(F.col(idx) == F.col("_lo"), F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(
        F.lit(1.0 - alpha), F.col("_e").cast("double")
    )
    return ended.groupBy(*keys).agg(
        F.sum(weight * F.col(value)).alias("level"), F.avg(value).alias("mean_value"), F.first("_n").alias("n")
    )


def ema_series(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float = fv.EMA_ALPHA, block: int = 65_536
) -> DataFrame:
    """The smoothed value at every row.

    While the memory is short, each row folds the values it still remembers. A longer memory is cut into blocks: within a
    block the smoothing starts at nothing and is a sum of weighted values; a block's end is (what it adds, what it keeps of
    what came before), so one row per block carries the value on.
    """
    memory = kernel_rows(alpha)
    if memory <= LONGEST_KERNEL:
        w = halo_window(keys, idx).rowsBetween(-memory, 0)
        framed = halo_blocks(df, idx, behind=memory, block=block).withColumn("_recent", F.collect_list(value).over(w))
        rest = F.slice("_recent", 2, max(memory, 1))
        smoothed = F.aggregate(rest, F.col("_recent")[0], lambda s, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * s)
        return own_rows(framed).withColumn("ema", smoothed).drop("_recent")
    return _carried_ema(df, keys, idx, value, alpha, min(block, LONGEST_KERNEL))


def _carried_ema(df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float, block: int) -> DataFrame:
    """``ema_series`` by one carried value per block of rows."""
    names = df.columns
    ended = _with_ends(df, keys, idx).withColumns(
        {"_b": F.floor((F.col(idx) - F.col("_lo")) / block), "_k": F.pmod(F.col(idx) - F.col("_lo"), F.lit(block))}
    )
    start = (F.col("_b") == 0) & (F.col("_k") == 0)
    # (1 - alpha) ** -k stays small within a block, so a running sum can be scaled back
    grown = F.when(start, F.lit(1.0)).otherwise(F.lit(alpha)) * F.col(value) * F.pow(F.lit(1.0 - alpha), -F.col("_k").cast("double"))
    inside = Window.partitionBy(*keys, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ended.withColumn("_own", F.sum(grown).over(inside) * F.pow(F.lit(1.0 - alpha), F.col("_k").cast("double")))
    added = summed.where(F.col("_k") == block - 1).select(*keys, F.col("_b"), F.col("_own").alias("_add"))
    kept = (1.0 - alpha) ** block
    back = max(1, math.ceil(kernel_rows(alpha) / block))  # blocks after which a block's own share is forgotten
    ends = halo_window(keys, "_b").rowsBetween(-back, -1)
    shares = F.aggregate(F.collect_list("_add").over(ends), F.lit(0.0), lambda s, x: s * F.lit(kept) + x)
    # the next block has a row here even where it is not full
    blocks = summed.where(F.col("_k") == 0).select(*keys, "_b").join(added, [*keys, "_b"], "left").withColumn("_add", F.coalesce("_add", F.lit(0.0)))
    carried = own_rows(halo_blocks(blocks, "_b", behind=back).withColumn("_carry", shares)).select(*keys, "_b", "_carry")
    return summed.join(carried, [*keys, "_b"]).select(
        *names, (F.col("_own") + F.col("_carry") * F.pow(F.lit(1.0 - alpha), (F.col("_k") + 1).cast("double"))).alias("ema")
    )


def forecast(levels: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """Decay from the smoothed level towards the mean, clipped to 0..100; fewer than three rows give 50."""
    decay = F.exp(-F.col("step") / F.lit(float(max(steps, 1))))
    value = F.col("level") * decay + F.col("mean_value") * (1 - decay)
    return levels.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(
        *keys,
        "step",
        F.when(F.col("n") < 3, F.lit(50.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))).alias("forecast"),
    )


def forecast_mean(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return forecasts.groupBy(*keys).agg(F.avg("forecast").alias("projected_health"))


def region_trends(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, steps: int = 20, tail: int | None = None
) -> DataFrame:
    """Per series: trend, projected health, first and last forecast, mean. ``tail`` limits the forecast's history."""
    history = _with_ends(df, keys, idx).where(F.col("_e") < tail).select(*df.columns) if tail else df
    ahead = forecast(ema_level(history, keys, idx, value), keys, steps)
    ends = ahead.groupBy(*keys).agg(
        F.avg("forecast").alias("projected_health"),
        F.max(F.when(F.col("step") == 0, F.col("forecast"))).alias("forecast_start"),
        F.max(F.when(F.col("step") == steps - 1, F.col("forecast"))).alias("forecast_end"),
    )
    means = df.groupBy(*keys).agg(F.bround(F.avg(value), 2).alias("mean_health"))
    trends = trend_last(df, keys, idx, value)
    if not keys:
        return attach(attach(trends, ends), means)
    return trends.join(ends, list(keys)).join(means, list(keys))


def current_health_snapshot(health: DataFrame, keys: Sequence[str], idx: str, steps: int = 10) -> DataFrame:
    """Last window of a series with its trend and a short forecast (flat below 20 windows), one row per step."""
    columns = ["cyber_health", "threat_component", "stability_component", "pressure_component", "risk_category"]
    last = _with_ends(health, keys, idx).where(F.col("_e") == 0).select(*keys, *columns)
    ahead = forecast(ema_level(health, keys, idx, "cyber_health"), keys, steps)
    joined = last.join(trend_last(health, keys, idx, "cyber_health"), list(keys)).join(ahead, list(keys))
    return joined.withColumn("forecast", F.when(F.col("n") < 20, F.col("cyber_health")).otherwise(F.col("forecast")))


def rolling_mean_centered(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, width: int = 100, block: int = 65_536
) -> DataFrame:
    """Centered mean of ``width`` rows (one more behind than ahead for an even width), null at the edges."""
    ahead = (width - 1) // 2
    behind = width - 1 - ahead
    w = halo_window(keys, idx).rowsBetween(-behind, ahead)
    framed = halo_blocks(df, idx, behind, ahead, block).withColumn(
        "rolling_mean", F.when(F.count(value).over(w) == width, F.avg(value).over(w))
    )
    return own_rows(framed)


def every_kth(df: DataFrame, idx: str = "window_index", points: int = 200) -> DataFrame:
    """Every k-th row with k = max(1, n // points); may give more than ``points`` rows."""
    k = df.agg(F.greatest(F.lit(1).cast("bigint"), F.floor(F.count(F.lit(1)) / points)).alias("_k"))
    return attach(df, k).where(F.col(idx) % F.col("_k") == 0).drop("_k")


def evenly_spaced(df: DataFrame, idx: str = "window_index", points: int = 5000) -> DataFrame:
    """The rows at ``points`` equally spaced positions, renumbered in ``position``.

    Position i selects row floor(i*(n-1)/(m-1)); whether a row is selected is decided from its own index.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", F.least(F.col("_n"), F.lit(points)))
    last, steps = F.col("_n") - 1, F.col("_m") - 1
    position = F.when(steps == 0, F.lit(0).cast("bigint")).otherwise(
        F.expr(f"({idx} * (_m - 1) + greatest(_n - 2, 0)) div greatest(_n - 1, 1)")
    )
    hit = F.when(steps == 0, F.col(idx) == 0).otherwise(F.expr("(position * (_n - 1)) div greatest(_m - 1, 1)") == F.col(idx))
    return attach(df, n).withColumn("position", position).where(hit).drop("_n", "_m")


def recovery_islands(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, above: float = 60.0, min_length: int = 3,
    block: int = 65_536,
) -> DataFrame:
    """Runs of consecutive rows with ``value`` > ``above`` of at least ``min_length``, and where they allow resuming.

    A run is named by the last row before it that is not healthy: a running maximum, carried across blocks.
    """
    marked = df.select(*keys, idx, (F.col(value) > above).alias("_ok")).withColumns(
        {"_blk": F.floor(F.col(idx) / block), "_bad": F.when(~F.coalesce(F.col("_ok"), F.lit(False)), F.col(idx))}
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*keys, "_blk").agg(F.max("_bad").alias("_m")).select(
        *keys, "_blk", F.max("_m").over(earlier).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.join(carried, [*keys, "_blk"]).withColumn(
        "_run", F.coalesce(F.max("_bad").over(inside), F.col("_carry"), F.lit(-1))
    )
    return (
        runs.where("_ok")
        .groupBy(*keys, "_run")
        .agg(F.min(idx).alias("run_start"), F.max(idx).alias("run_end"), F.count(F.lit(1)).alias("run_length"))
        .where(F.col("run_length") >= min_length)
        .select(*keys, "run_start", "run_end", "run_length", (F.col("run_start") + min_length - 1).alias("resume_at"))
    )
