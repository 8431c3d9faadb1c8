"""Fixed-count windows over a stream of frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from busvitals.functions import fixed_values as fv
from busvitals.operators.frames import ORDER, SERIES, payload_entropy, payload_stats
from busvitals.operators.ordering import number_rows
from busvitals.operators.windows import features_of_windows
from busvitals.sources.tables import flat_schema, stored_schema
from busvitals.streaming.epochs import EpochTable, batch_session

SLIM = flat_schema(
    "vehicle_id string, capture string, attack_type string, attack_label int, flag int, t_us bigint, seq bigint, "
    "can_id int, payload_n int, payload_sum bigint, payload_sumsq bigint, payload_entropy double"
)
# frames of unfinished windows carry their position; held frames wait for the watermark and have none
PENDING = T.StructType([*SLIM.fields, T.StructField("rn", T.LongType()), T.StructField("delta_time", T.DoubleType())])
SEEN = flat_schema("vehicle_id string, capture string, next_rn bigint, last_t bigint, last_seq bigint, newest_t bigint")


@dataclass(frozen=True)
class CountWindowTables:
    """Outputs (windows, late frames) and state (unfinished windows, series positions) of one stream."""

    windows: EpochTable
    late: EpochTable
    pending: EpochTable
    seen: EpochTable

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "CountWindowTables":
        return cls(
            EpochTable(spark, f"{root}/windows", stored_schema()),
            EpochTable(spark, f"{root}/late", SLIM),
            EpochTable(spark, f"{root}/pending", PENDING, is_state=True),
            EpochTable(spark, f"{root}/seen", SEEN, is_state=True),
        )


def window_batch(frames: DataFrame, epoch: int, tables: CountWindowTables, size: int = fv.WINDOW_SIZE, delay_us: int = 0) -> None:
    """One micro-batch: finish windows, set late frames aside, carry the rest.

    A frame is late if it sorts before a frame that already has its position. ``delay_us`` holds frames back until the
    newest time of their series has moved that far past them, so disorder within the delay costs nothing.
    """
    batch_session(frames)
    # used by several writes of this batch; lost blocks are recomputed from the batch's files
    fresh = payload_entropy(payload_stats(frames)).select(*[f.name for f in SLIM.fields]).persist(StorageLevel.MEMORY_AND_DISK)
    carried = tables.pending.before(epoch)
    seen = tables.seen.before(epoch)

    placed = fresh.join(seen, SERIES, "left")
    is_late = F.coalesce(F.struct("t_us", "seq") <= F.struct("last_t", "last_seq"), F.lit(False))
    tables.late.write(placed.where(is_late), epoch)
    on_time = placed.where(~is_late).select(*[f.name for f in SLIM.fields])

    waiting = on_time.unionByName(carried.where("rn IS NULL").select(*on_time.columns))
    newest = (
        waiting.groupBy(*SERIES).agg(F.max("t_us").alias("newest_t"))
        .unionByName(seen.select(*SERIES, "newest_t")).groupBy(*SERIES).agg(F.max("newest_t").alias("newest_t"))
    )
    timed = waiting.join(newest, SERIES).persist(StorageLevel.MEMORY_AND_DISK)
    n_waiting = timed.count()
    is_ready = F.col("t_us") <= F.col("newest_t") - F.lit(delay_us)
    ready = number_rows(timed.where(is_ready).drop("newest_t"), SERIES, ORDER, "_i", {"_prev": "t_us"}, total_rows=n_waiting)
    known = seen.select(*SERIES, "next_rn", "last_t", "last_seq")
    numbered = ready.join(known, SERIES, "left").withColumns(
        {
            "rn": F.col("_i") + F.coalesce(F.col("next_rn"), F.lit(0)),
            "delta_time": (F.col("t_us") - F.coalesce(F.col("_prev"), F.col("last_t"))) / F.lit(1e6),
        }
    ).select(*[f.name for f in PENDING.fields]).persist(StorageLevel.MEMORY_AND_DISK)
    held = timed.where(~is_ready).drop("newest_t").withColumns(
        {"rn": F.lit(None).cast("bigint"), "delta_time": F.lit(None).cast("double")}
    )

    open_frames = carried.where("rn IS NOT NULL").unionByName(numbered)
    # the seen table is written first: the rest of the batch reads it back instead of recomputing it
    moved = numbered.groupBy(*SERIES).agg(
        (F.max("rn") + 1).alias("_rn"), F.max(F.struct("t_us", "seq")).alias("_last")
    )
    now = tables.seen.write(
        newest.join(known, SERIES, "left").join(moved, SERIES, "left").select(
            *SERIES,
            F.coalesce("_rn", "next_rn", F.lit(0)).alias("next_rn"),
            F.coalesce("_last.t_us", "last_t").alias("last_t"),
            F.coalesce("_last.seq", "last_seq").alias("last_seq"),
            "newest_t",
        ),
        epoch,
    )
    framed = open_frames.withColumn("w", F.floor(F.col("rn") / size))
    tables.windows.write(features_of_windows(framed, size), epoch)
    unfinished = framed.join(now.select(*SERIES, "next_rn"), SERIES).where(F.col("w") == F.floor(F.col("next_rn") / size))
    tables.pending.write(unfinished.select(*[f.name for f in PENDING.fields]).unionByName(held), epoch)
    numbered.unpersist()
    timed.unpersist()
    fresh.unpersist()


def start_count_windows(
    frames: DataFrame, root: str, size: int = fv.WINDOW_SIZE, delay_us: int = 0, once: bool = True
) -> StreamingQuery:
    """Run ``window_batch`` on every micro-batch of a frame stream; ``once`` stops when the input is used up."""
    tables = CountWindowTables.at(frames.sparkSession, root)
    writer = (
        frames.writeStream.option("checkpointLocation", f"{root}/checkpoint-windows")
        .foreachBatch(lambda df, epoch: window_batch(df, epoch, tables, size, delay_us))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
