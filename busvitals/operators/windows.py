"""Fixed-count behavioral windows and their 13 features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.functions.dimensions import class_ordinal
from busvitals.functions.scalars import entropy_bits
from busvitals.operators.frames import SERIES, delta_time, payload_entropy, payload_stats

BURST_SLICES = 10
HALF_BYTE_RANGE = 127.5


def count_window(frames: DataFrame, size: int = fv.WINDOW_SIZE, **blocks: int) -> DataFrame:
    """Number the frames of each series and assign non-overlapping windows of ``size`` frames."""
    return delta_time(frames, **blocks).withColumn("w", F.floor(F.col("rn") / size))


def window_features(
    frames: DataFrame, size: int = fv.WINDOW_SIZE, tail: str = "drop", label: str = "capture", **blocks: int
) -> DataFrame:
    """The 13 features per (vehicle, capture, window).

    Two shuffles: frames by ordered block for numbering, then one combined row per window piece. Payload
    statistics are taken before the first one, so the payload arrays never travel.
    """
    slim = payload_entropy(payload_stats(frames)).select(
        *SERIES, "attack_type", "attack_label", "flag", "t_us", "seq", "can_id",
        "payload_n", "payload_sum", "payload_sumsq", "payload_entropy",
    )
    return features_of_windows(count_window(slim, size, **blocks), size, tail, label)


def features_of_windows(
    framed: DataFrame, size: int = fv.WINDOW_SIZE, tail: str = "drop", label: str = "capture", also: Mapping[str, Column] | None = None
) -> DataFrame:
    """Aggregate frames that already carry ``w`` and ``delta_time``. The lists hold at most ``size`` elements.

    ``also`` names further aggregates of a window to return.
    """
    grouped = framed.groupBy(*SERIES, "w").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.min("attack_type").alias("_type"),
        F.min("attack_label").alias("_label"),
        F.avg("flag").alias("_flagged"),
        F.min("t_us").alias("_t0"),
        F.max("t_us").alias("_t1"),
        F.avg("delta_time").alias("window_delta_time_mean"),
        F.stddev_samp("delta_time").alias("window_delta_time_std"),
        F.min("delta_time").alias("window_delta_time_min"),
        F.max("delta_time").alias("window_delta_time_max"),
        F.sum("payload_n").alias("_bn"),
        F.sum("payload_sum").alias("_bs"),
        F.sum("payload_sumsq").alias("_bq"),
        F.avg("payload_entropy").alias("window_payload_entropy_mean"),
        F.collect_list("can_id").alias("_ids"),
        F.collect_list("t_us").alias("_ts"),
        *[column.alias(name) for name, column in (also or {}).items()],
    )
    kept = grouped.where(_tail_filter(size, tail))
    span = F.col("_t1") - F.col("_t0")
    variance = F.try_divide(F.col("_bn") * F.col("_bq") - F.col("_bs") * F.col("_bs"), F.col("_bn") * (F.col("_bn") - 1))
    return kept.withColumns(
        {
            "messages_per_second": F.try_divide(F.col("n_frames") * F.lit(1e6), span),
            "unique_can_ids_window": F.size(F.array_distinct("_ids")).cast("double"),
            "can_id_entropy": entropy_bits(F.col("_ids")),
            "window_payload_mean": F.try_divide(F.col("_bs"), F.col("_bn")),
            "window_payload_std": F.sqrt(variance),
            "_slices": F.transform("_ts", lambda t: _slice_of(t, F.col("_t0"), span)),
        }
    ).withColumns(
        {
            "message_burst_score": _fullest_slice(F.col("_slices")) / F.col("n_frames"),
            "frequency_spike_score": F.try_divide(F.col("window_delta_time_max"), F.col("window_delta_time_mean")),
            "payload_instability_score": F.col("window_payload_std") / F.lit(HALF_BYTE_RANGE),
        }
    ).withColumns(_labels(label)).select(*SERIES, "w", *fv.FEATURES, "attack_label", "attack_type", "n_frames", *(also or {}))


def _tail_filter(size: int, tail: str) -> Column:
    n = F.col("n_frames")
    return {"drop": n == size, "keep": F.lit(True), "round": n * 2 >= size}[tail]


def _slice_of(t: Column, start: Column, span: Column) -> Column:
    """Which of the equal time slices of the window a frame falls into; a window without span has one slice."""
    part = F.try_divide((t - start) * BURST_SLICES, span)
    return F.coalesce(F.least(F.floor(part).cast("int"), F.lit(BURST_SLICES - 1)), F.lit(0))


def _fullest_slice(slices: Column) -> Column:
    return F.greatest(*[F.size(slices) - F.size(F.array_remove(slices, i)) for i in range(BURST_SLICES)])


def _labels(mode: str) -> dict[str, Column]:
    """capture: label of the recording; majority: attack if more than half of the frames are flagged."""
    if mode == "capture":
        return {"attack_label": F.col("_label"), "attack_type": F.col("_type")}
    attacked = F.col("_flagged") > 0.5
    return {
        "attack_label": F.when(attacked, 1).otherwise(0),
        "attack_type": F.when(attacked, F.col("_type")).otherwise(F.lit("Normal")),
    }


def both_labels(framed: DataFrame, size: int = fv.WINDOW_SIZE) -> DataFrame:
    """Label and class of each full window by its recording and by the majority of its frames, in one aggregation."""
    grouped = framed.groupBy(*SERIES, "w").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("attack_type").alias("_type"), F.min("attack_label").alias("_label"), F.avg("flag").alias("_flagged"))
    named = [column.alias(f"{mode}_{name.removeprefix('attack_')}") for mode in ("capture", "majority") for name, column in _labels(mode).items()]
    return grouped.where(_tail_filter(size, "drop")).select(*SERIES, "w", *named)


def window_index(windows: DataFrame, scope: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """Dense 0-based position in class order, per vehicle (default) or over everything (``scope=()``).

    ``w`` is already dense inside a series, so only the series sizes are summed up, never the rows ordered.
    """
    scope = list(scope)
    sizes = windows.groupBy("vehicle_id", "capture").agg(
        F.count(F.lit(1)).alias("_n"), F.max(class_ordinal()).alias("_class")
    )
    before = Window.partitionBy(*scope).orderBy("_class", "capture", "vehicle_id")
    offsets = sizes.select(
        "vehicle_id",
        "capture",
        (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"),
    )
    return windows.join(offsets, ["vehicle_id", "capture"]).withColumn(
        "window_index", F.col("w") + F.col("_offset")
    ).drop("_offset")


def window_size_comparison(frames: DataFrame, sizes: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Full windows per class and window size; only the frame counts are needed."""
    counts = frames.groupBy("vehicle_id", "capture", "attack_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.withColumn("window_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .groupBy("window_size", "attack_type")
        .agg(F.sum(F.floor(F.col("n") / F.col("window_size"))).alias("n_windows"))
    )
