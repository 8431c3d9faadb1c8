"""Health, trend, recovery and decisions over a stream of finished windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import trend_label
from busvitals.operators.explain import root_cause, threat_story
from busvitals.operators.health import health_score
from busvitals.operators.kernel import KernelModel, rbf_score
from busvitals.operators.ordering import halo_blocks, halo_window, number_rows, own_rows
from busvitals.operators.respond import response_decision
from busvitals.operators.series import ema_series, kernel_rows
from busvitals.sources.tables import flat_schema, stored_schema
from busvitals.streaming.epochs import EpochTable, batch_session

SERIES = ["vehicle_id", "capture"]
LOOKBACK = 10
HORIZON = 20
RESUME_AFTER = 3
HEALTH = flat_schema(
    "threat_component double, stability_component double, pressure_component double, cyber_health double, risk_category string"
)
SCORED = stored_schema(T.StructField("anomaly_score", T.DoubleType()), *HEALTH.fields)
FOLLOWED = T.StructType(
    [*SCORED.fields, *flat_schema("trend string, trend_diff double, ema double, resume int").fields]
)
DECIDED = flat_schema(
    "vehicle_id string, capture string, w bigint, risk_category string, health_score double, trend_label string, "
    "attack_type string, response_level int, level_label string, confidence double, action_ids string"
)


def stream_health(windows: DataFrame, model: KernelModel, baseline: DataFrame) -> DataFrame:
    """Score and health of finished windows; stateless, for streams and tables alike."""
    return health_score(rbf_score(windows, model), baseline)


def follow(scored: DataFrame) -> DataFrame:
    """Trend of the last 20 windows, smoothed level and resume mark at every window of a series numbered by ``w``.

    ``resume`` is 1 at the window that completes ``RESUME_AFTER`` consecutive ones above 60 after a worse one.
    """
    w = halo_window(SERIES, "w")
    ok = F.coalesce((F.col("cyber_health") > 60).cast("int"), F.lit(0))
    span = 2 * LOOKBACK
    diff = F.avg("cyber_health").over(w.rowsBetween(1 - LOOKBACK, 0)) - F.avg("cyber_health").over(
        w.rowsBetween(1 - span, -LOOKBACK)
    )
    run = F.min("_ok").over(w.rowsBetween(1 - RESUME_AFTER, 0)) == 1
    complete = F.count(F.lit(1)).over(w.rowsBetween(1 - RESUME_AFTER, 0)) == RESUME_AFTER
    worse_before = F.coalesce(F.lag("_ok", RESUME_AFTER).over(w), F.lit(0)) == 0
    framed = halo_blocks(scored.withColumn("_ok", ok), "w", behind=span).withColumns(
        {
            "trend_diff": F.when(F.col("w") < span - 1, F.lit(0.0)).otherwise(diff),
            "resume": (run & complete & worse_before).cast("int"),
        }
    )
    followed = own_rows(framed).drop("_ok").withColumn("trend", trend_label(F.col("trend_diff")))
    return ema_series(followed, SERIES, "w", "cyber_health")


@dataclass(frozen=True)
class HealthTables:
    """Outputs (followed windows, decisions) and state (the last windows of each series, windows that came early)."""

    followed: EpochTable
    decisions: EpochTable
    tail: EpochTable
    early: EpochTable

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "HealthTables":
        return cls(
            EpochTable(spark, f"{root}/followed", FOLLOWED),
            EpochTable(spark, f"{root}/decisions", DECIDED),
            EpochTable(spark, f"{root}/tail", SCORED, is_state=True),
            EpochTable(spark, f"{root}/early", SCORED, is_state=True),
        )


def health_batch(scored: DataFrame, epoch: int, tables: HealthTables, baseline: DataFrame) -> None:
    """One micro-batch of scored windows, continued from the last windows of each series.

    Windows of a series are numbered from 0 without gaps, but may be delivered in any order: one that comes before its
    predecessors waits in ``early`` until they are there. So what has been followed is always everything up to a number, and
    a window delivered again is recognised by its own: every (series, w) is followed and decided once.
    """
    batch_session(scored)
    columns = [f.name for f in SCORED.fields]
    tail = tables.tail.before(epoch)
    known = tail.groupBy(*SERIES).agg(F.max("w").alias("_known"))
    arrived = scored.select(*columns).unionByName(tables.early.before(epoch)).join(known, SERIES, "left")
    # scoring runs once per batch; lost blocks are recomputed from the batch's files
    waiting = (
        arrived.where("_known IS NULL OR w > _known").dropDuplicates([*SERIES, "w"]).persist(StorageLevel.MEMORY_AND_DISK)
    )
    placed = number_rows(waiting, SERIES, ["w"], "_place", total_rows=waiting.count())
    ready = F.col("w") == F.coalesce("_known", F.lit(-1)) + 1 + F.col("_place")
    tables.early.write(placed.where(~ready), epoch)
    history = placed.where(ready).select(*columns).unionByName(tail).persist(StorageLevel.MEMORY_AND_DISK)
    new_only = follow(history).join(known, SERIES, "left").where("_known IS NULL OR w > _known")
    followed = tables.followed.write(new_only, epoch)
    tables.decisions.write(decide(followed, baseline), epoch)
    ends = history.groupBy(*SERIES).agg(F.max("w").alias("_last"))
    remembered = kernel_rows(fv.EMA_ALPHA)
    tables.tail.write(history.join(ends, SERIES).where(F.col("_last") - F.col("w") <= remembered), epoch)
    history.unpersist()
    waiting.unpersist()


def decide(followed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Story and decision for every window that calls for level 1 or more.

    The projection decays from the smoothed level towards the window's own health over the horizon.
    """
    weight = sum(math.exp(-i / HORIZON) for i in range(HORIZON)) / HORIZON
    projected = F.col("ema") * weight + F.col("cyber_health") * (1 - weight)
    told = threat_story(root_cause(followed.withColumns({"projected_health": projected, "window_index": F.col("w")}), baseline))
    made = response_decision(told).where("response_level >= 1")
    return made.withColumn("action_ids", F.array_join(F.transform("actions", lambda a: a["id"]), ","))


def start_health(
    windows: DataFrame, root: str, model: KernelModel, baseline: DataFrame, once: bool = True
) -> StreamingQuery:
    """Health of a window stream, followed and decided per micro-batch."""
    tables = HealthTables.at(windows.sparkSession, root)
    writer = (
        stream_health(windows, model, baseline)
        .writeStream.option("checkpointLocation", f"{root}/checkpoint-health")
        .foreachBatch(lambda df, epoch: health_batch(df, epoch, tables, baseline))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


