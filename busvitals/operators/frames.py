"""Per-frame operators. All narrow except ``dedup_frames``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions.dimensions import class_ordinal
from busvitals.functions.scalars import entropy_bits
from busvitals.operators.ordering import number_rows

SERIES = ["vehicle_id", "capture"]
ORDER = ["t_us", "seq"]


def dedup_frames(frames: DataFrame) -> DataFrame:
    """One frame per (series, time, id, payload), the one seen first; rows without time or with a bad payload go.

    The grouping combines on the map side, so a frame repeated very often does not gather in one task.
    """
    valid = frames.where(
        F.col("t_us").isNotNull() & (F.size("payload") == F.col("dlc")) & ~F.exists("payload", lambda b: b.isNull())
    )
    key = [*SERIES, "t_us", "can_id", "payload"]
    rest = [c for c in frames.columns if c not in key]
    first = valid.groupBy(*key).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_f"))
    return first.select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest]).select(*frames.columns)


def can_id_features(frames: DataFrame) -> DataFrame:
    """Lower ids win bus arbitration, so priority counts down from the largest 11-bit id."""
    return frames.withColumns(
        {
            "can_id_dec": F.col("can_id"),
            "can_id_priority": F.lit(2047) - F.col("can_id"),
            "is_extended_id": (F.col("can_id") > 2047).cast("int"),
        }
    )


def dlc_features(frames: DataFrame) -> DataFrame:
    return frames.withColumn("dlc_normalized", F.col("dlc") / F.lit(8.0))


def payload_stats(frames: DataFrame) -> DataFrame:
    """Statistics of the payload bytes of each frame; 0 for an empty payload. The deviation is the population one."""
    n = F.size("payload")
    total = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, b: a + b)
    squares = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, b: a + b * b)
    some = n > 0
    with_sums = frames.withColumns({"payload_n": n, "payload_sum": total, "payload_sumsq": squares})
    mean = F.col("payload_sum") / F.col("payload_n")
    variance = (F.col("payload_n") * F.col("payload_sumsq") - F.col("payload_sum") * F.col("payload_sum")) / (
        F.col("payload_n") * F.col("payload_n")
    )
    return with_sums.withColumns(
        {
            "payload_mean": F.when(some, mean).otherwise(0.0),
            "payload_std": F.when(some, F.sqrt(variance)).otherwise(0.0),
            "payload_min": F.coalesce(F.array_min("payload"), F.lit(0)),
            "payload_max": F.coalesce(F.array_max("payload"), F.lit(0)),
            "payload_non_zero_count": F.size(F.filter("payload", lambda b: b != 0)),
        }
    )


def payload_entropy(frames: DataFrame) -> DataFrame:
    return frames.withColumn("payload_entropy", entropy_bits(F.col("payload")))


def attack_type_encoded(frames: DataFrame) -> DataFrame:
    return frames.withColumn("attack_type_encoded", class_ordinal())


def delta_time(frames: DataFrame, **blocks: int) -> DataFrame:
    """Seconds since the previous frame of the series (null for the first), and the frame's position ``rn``."""
    numbered = number_rows(frames, SERIES, ORDER, "rn", {"_prev_us": "t_us"}, **blocks)
    return numbered.withColumn("delta_time", (F.col("t_us") - F.col("_prev_us")) / F.lit(1e6)).drop("_prev_us")


def engineer_frames(frames: DataFrame, **blocks: int) -> DataFrame:
    """All per-frame columns: time, id, payload, length and class context."""
    out = attack_type_encoded(payload_entropy(payload_stats(dlc_features(can_id_features(frames)))))
    return delta_time(out.withColumn("timestamp_seconds", F.col("t_us") / F.lit(1e6)), **blocks)


def time_order(frames: DataFrame, partitions: int | None = None) -> DataFrame:
    """Frames range-partitioned and sorted by series and time, ready to be written as an ordered table."""
    by = [*SERIES, *ORDER]
    ranged = frames.repartitionByRange(partitions, *by) if partitions else frames.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def union_captures(*captures: DataFrame) -> DataFrame:
    first, *others = captures
    for df in others:
        first = first.unionByName(df)
    return first
