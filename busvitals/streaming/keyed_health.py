"""Health, trend, recovery and decisions over finished windows, with Spark's keyed state.

A series keeps what its next window needs: the last 20 healths, the smoothed level, the number of the next window, and the
windows that came before their predecessors. Smoothing continues from the level, so nothing older is remembered. A
micro-batch touches and rewrites only the series that it has windows of.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import trend_label
from busvitals.operators.kernel import KernelModel
from busvitals.streaming.epochs import EpochTable, batch_session
from busvitals.streaming.health import DECIDED, FOLLOWED, LOOKBACK, RESUME_AFTER, SCORED, decide, stream_health
from busvitals.streaming.keyed_windows import EXPIRE_AFTER, event_clock, from_bytes, to_bytes

SESSION = ["vehicle_id", "capture", "started_us"]
RING = 2 * LOOKBACK
HEALTHY = 60
_ROWS = [*SCORED.fields, T.StructField("started_us", T.LongType()), T.StructField("ended_us", T.LongType())]
_NULLABLE = ("attack_label", "n_frames")
OUT = T.StructType([
    *[T.StructField(f.name, T.DoubleType() if f.name in _NULLABLE else f.dataType) for f in _ROWS],
    T.StructField("trend_diff", T.DoubleType()), T.StructField("ema", T.DoubleType()), T.StructField("resume", T.IntegerType()),
    T.StructField("stranded", T.BooleanType()),
])
STATE = T.StructType([
    T.StructField("next_w", T.LongType()), T.StructField("level", T.DoubleType()), T.StructField("newest_ms", T.LongType()),
    T.StructField("ring", T.BinaryType()), T.StructField("early", T.BinaryType()),
])


def continued(ring: np.ndarray, level: float, first: int, health: np.ndarray, alpha: float = fv.EMA_ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend difference, smoothed level and resume mark of windows ``first``, ``first`` + 1 ... of a series, after ``ring``.

    The trend is the mean of the last ten less the mean of the ten before (0 while there are fewer); a window may resume if
    it completes three healthy ones after a worse one or the start.
    """
    n = len(health)
    whole = np.concatenate([np.full(RING - len(ring), np.nan), ring, health])
    means = np.lib.stride_tricks.sliding_window_view(whole, LOOKBACK).mean(axis=1)  # of places k .. k + 9
    at = np.arange(RING, RING + n)
    trend = np.where(first + np.arange(n) < RING - 1, 0.0, means[at - LOOKBACK + 1] - means[at - RING + 1])
    levels = np.empty(n)
    for k, x in enumerate(health):
        level = x if first + k == 0 else alpha * x + (1 - alpha) * level
        levels[k] = level
    ok = whole > HEALTHY  # what lies before the start is not healthy, and unknown health neither
    resume = ~ok[at - RESUME_AFTER]
    for back in range(RESUME_AFTER):
        resume = resume & ok[at - back]
    return trend, levels, resume.astype("int32")


def follow_series(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire_after: int) -> Iterator[pd.DataFrame]:
    """One series in one micro-batch: windows that continue it; others wait. After a silence the series is forgotten, and
    windows that still wait for a lost one are given out as ``stranded``."""
    columns = [f.name for f in OUT.fields[:-4]]
    next_w, level, newest, ring, early = state.get if state.exists else (0, 0.0, 0, b"", None)
    waiting = from_bytes(early)
    if state.hasTimedOut:
        if waiting is not None:
            yield waiting.assign(trend_diff=0.0, ema=0.0, resume=0, stranded=True)[OUT.names]
        state.remove()
        return
    clock = state.getCurrentWatermarkMs()
    rows = pd.concat([p for p in (waiting, *(b[columns] for b in batches)) if p is not None])
    newest = max(newest, int(rows["ended_us"].max()) // 1000)
    rows = rows[rows["w"] >= next_w].drop_duplicates("w").sort_values("w", kind="stable")
    ready = rows["w"].to_numpy() == next_w + np.arange(len(rows))
    now, later = rows[ready], rows[~ready]
    if len(now):
        past = np.frombuffer(ring)
        health = now["cyber_health"].to_numpy("float64")
        trend, levels, resume = continued(past, level, next_w, health)
        yield now.assign(trend_diff=trend, ema=levels, resume=resume, stranded=False)[OUT.names]
        next_w, level = next_w + len(now), float(levels[-1])
        ring = np.concatenate([past, health])[-RING:].tobytes()
    state.update((next_w, level, newest, ring, to_bytes(later) if len(later) else None))
    state.setTimeoutTimestamp(max(newest + expire_after, clock, 1))


@dataclass(frozen=True)
class KeyedHealthTables:
    """Outputs: followed windows, decisions, and windows whose predecessors never came."""

    followed: EpochTable
    decisions: EpochTable
    stranded: EpochTable

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "KeyedHealthTables":
        return cls(
            EpochTable(spark, f"{root}/followed", FOLLOWED), EpochTable(spark, f"{root}/decisions", DECIDED),
            EpochTable(spark, f"{root}/stranded", SCORED),
        )


def keyed_health(scored: DataFrame, expire_after: int) -> DataFrame:
    """A stream of scored windows (with ``started_us`` and ``ended_us``) as a stream of ``OUT``."""
    slim = scored.select(*[F.col(f.name).cast("double").alias(f.name) if f.name in _NULLABLE else F.col(f.name) for f in _ROWS])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from follow_series(key, batches, state, expire_after)

    # files of windows come in any order and a window waits for its predecessors, so nothing is late here
    return event_clock(slim, "ended_us", 0).groupBy(*SESSION).applyInPandasWithState(
        run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_batch(out: DataFrame, epoch: int, tables: KeyedHealthTables, baseline: DataFrame) -> None:
    """Followed windows and decisions of one micro-batch."""
    batch_session(out)
    types = {"attack_label": "int", "n_frames": "bigint"}
    out = out.withColumns({n: F.col(n).cast(t) for n, t in types.items()}).withColumn("trend", trend_label(F.col("trend_diff"))).persist()
    followed = tables.followed.write(out.where("NOT stranded"), epoch)
    tables.decisions.write(decide(followed, baseline), epoch)
    tables.stranded.write(out.where("stranded"), epoch)
    out.unpersist()


def start_keyed_health(
    windows: DataFrame, root: str, model: KernelModel, baseline: DataFrame, expire_after: int = EXPIRE_AFTER, once: bool = True
) -> StreamingQuery:
    """Health of a window stream, followed and decided per micro-batch."""
    tables = KeyedHealthTables.at(windows.sparkSession, root)
    writer = (
        keyed_health(stream_health(windows, model, baseline), expire_after).writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint-health")
        .foreachBatch(lambda df, epoch: write_batch(df, epoch, tables, baseline))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
