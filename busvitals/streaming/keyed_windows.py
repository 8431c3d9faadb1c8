"""Fixed-count windows with Spark's keyed state and event-time watermark.

A series keeps its unfinished window (fewer frames than a window has), the frames that the watermark still holds back, and
its position. A micro-batch touches the series that have new frames or whose timeout has come; all others cost nothing, and
one that has been silent for ``expire_after`` is forgotten. The watermark decides both ways: frames up to it are released in
the order of (time, sequence number), and a frame that arrives below it is late.

All frames of a series in a micro-batch are one task's work. A series too busy for that is better served by the tables of
``count_windows``; ``start_windows`` runs both side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from busvitals.functions import fixed_values as fv
from busvitals.operators.frames import SERIES, payload_entropy, payload_stats
from busvitals.operators.windows import features_of_windows
from busvitals.sources.tables import flat_schema, stored_schema
from busvitals.streaming.count_windows import SLIM, CountWindowTables, start_count_windows
from busvitals.streaming.epochs import EpochTable, batch_session

ROWS_AT_ONCE = 10_000  # given out
EXPIRE_AFTER = 24 * 3600 * 1000  # milliseconds of event time
# numbers that may be null travel as doubles through pandas, which has no null integers
_CARRIED = [f.name for f in SLIM.fields if f.name not in SERIES]
_NULLABLE = ("attack_label", "flag", "can_id")
_EVENT = T.StructType([
    *[T.StructField(f.name, T.DoubleType() if f.name in _NULLABLE else f.dataType) for f in SLIM.fields if f.name not in SERIES],
    T.StructField("rn", T.LongType()), T.StructField("delta_time", T.DoubleType()), T.StructField("started_us", T.LongType()),
])
OUT = T.StructType([T.StructField("kind", T.StringType()), *[SLIM[n] for n in SERIES], *_EVENT.fields])
STATE = T.StructType([
    T.StructField("next_rn", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("last_seq", T.LongType()),
    T.StructField("started_us", T.LongType()), T.StructField("newest_ms", T.LongType()), T.StructField("frames", T.BinaryType()),
])
FRAME, LATE, EXPIRED = "frame", "late", "expired"
WINDOWS = stored_schema(T.StructField("started_us", T.LongType()), T.StructField("ended_us", T.LongType()))
EXPIRIES = flat_schema("vehicle_id string, capture string, started_us bigint, n_windows bigint, n_pending bigint, last_us bigint")


def to_bytes(rows: pd.DataFrame) -> bytes:
    """A small table as state."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(held: bytes | None) -> pd.DataFrame | None:
    return None if held is None else pa.ipc.open_stream(held).read_all().to_pandas()


def event_clock(stream: DataFrame, micros: str, delay_ms: int) -> DataFrame:
    """The stream with a watermark of ``delay_ms`` behind the newest time, and no row of it dropped.

    Spark drops rows below the watermark before a stateful operator sees them. Here each row passes the watermark twice, with
    its time and without one; the first moves the clock and goes no further, the second cannot be late.
    """
    time = F.timestamp_micros(F.col(micros))
    twice = stream.withColumn("event_time", F.explode(F.array(time, F.lit(None).cast("timestamp"))))
    return twice.withWatermark("event_time", f"{delay_ms} milliseconds").where("event_time IS NULL")


_COLUMNS = [f.name for f in _EVENT.fields if f.name != "started_us"]


def _stacked(*parts: pd.DataFrame | None) -> pd.DataFrame | None:
    some = [p for p in parts if p is not None and len(p)]
    return pd.concat(some) if some else None


@dataclass
class Series:
    """What is kept of a series. ``held`` has its unfinished window (``rn`` set) and frames that wait for the watermark (-1)."""

    next_rn: int = 0
    last_us: int | None = None
    last_seq: int | None = None
    started_us: int | None = None
    newest_ms: int | None = None
    held: pd.DataFrame | None = None

    def is_late(self, rows: pd.DataFrame, clock: int) -> pd.Series:
        """Below the watermark; within its own millisecond only the order can tell."""
        late = rows["t_us"] // 1000 < clock
        if self.last_us is not None:
            late |= (rows["t_us"] < self.last_us) | ((rows["t_us"] == self.last_us) & (rows["seq"] <= self.last_seq))
        return late

    def take(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.newest_ms = max(self.newest_ms or 0, int(rows["t_us"].max()) // 1000)
            self.held = _stacked(self.held, rows[_COLUMNS])

    def release(self, clock: int, size: int) -> pd.DataFrame | None:
        """Number the frames up to the watermark; the frames of windows that this fills."""
        if self.held is None:
            return None
        numbered = self.held["rn"] >= 0
        ready = ~numbered & (self.held["t_us"] // 1000 <= clock)
        fresh = self.held[ready].sort_values(["t_us", "seq"], kind="stable")
        if len(fresh):
            before = fresh["t_us"].shift(1)
            if self.last_us is not None:
                before.iloc[0] = self.last_us
            if self.started_us is None:
                self.started_us = int(fresh["t_us"].iloc[0])
            fresh = fresh.assign(rn=range(self.next_rn, self.next_rn + len(fresh)), delta_time=(fresh["t_us"] - before) / 1e6)
            self.next_rn += len(fresh)
            self.last_us, self.last_seq = int(fresh["t_us"].iloc[-1]), int(fresh["seq"].iloc[-1])
        started = _stacked(self.held[numbered], fresh)
        waiting = self.held[~numbered & ~ready]
        if started is None:
            return None
        full = started["rn"] // size < self.next_rn // size
        self.held = _stacked(started[~full], waiting)
        return started[full]

    def due(self, expire_after: int) -> int:
        """When to look at the series again: when the watermark has reached the first frame that waits, or after a silence."""
        waiting = self.held.loc[self.held["rn"] < 0, "t_us"] if self.held is not None else ()
        return int(waiting.min()) // 1000 - 1 if len(waiting) else self.newest_ms + expire_after


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, size: int, expire_after: int) -> Iterator[pd.DataFrame]:
    """One series in one micro-batch: frames of finished windows, late frames, and the notice that it has expired."""
    clock = state.getCurrentWatermarkMs()
    series = Series(*state.get[:-1], from_bytes(state.get[-1])) if state.exists else Series()

    def told(kind: str, rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        for k in range(0, 0 if rows is None else len(rows), ROWS_AT_ONCE):
            part = rows.iloc[k : k + ROWS_AT_ONCE].assign(kind=kind, started_us=series.started_us or 0, **dict(zip(SERIES, key)))
            yield part[OUT.names]

    if state.exists and clock > series.newest_ms + expire_after:
        yield from told(FRAME, series.release(clock, size))
        notice = dict.fromkeys(_CARRIED, 0) | {"attack_type": None, "payload_entropy": float("nan"), "delta_time": float("nan")}
        pending = 0 if series.held is None else len(series.held)
        yield from told(EXPIRED, pd.DataFrame([notice | {"t_us": series.last_us, "seq": pending, "rn": series.next_rn // size}]))
        series = Series()
    if not state.hasTimedOut:
        arrived = pd.concat([b[_CARRIED] for b in batches]).assign(rn=-1, delta_time=float("nan"))
        late = series.is_late(arrived, clock)
        yield from told(LATE, arrived[late])
        series.take(arrived[~late])
    yield from told(FRAME, series.release(clock, size))
    if series.newest_ms is None:  # expired, or nothing but late frames of a series that is not known
        if state.exists:
            state.remove()
        return
    held = None if series.held is None else to_bytes(series.held)
    state.update((series.next_rn, series.last_us, series.last_seq, series.started_us, series.newest_ms, held))
    state.setTimeoutTimestamp(max(series.due(expire_after), clock, 1))


@dataclass(frozen=True)
class KeyedWindowTables:
    """Outputs of one stream; its state is Spark's own, in the checkpoint."""

    windows: EpochTable
    late: EpochTable
    expired: EpochTable

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "KeyedWindowTables":
        return cls(
            EpochTable(spark, f"{root}/windows", WINDOWS), EpochTable(spark, f"{root}/late", SLIM),
            EpochTable(spark, f"{root}/expired", EXPIRIES),
        )


def keyed_windows(frames: DataFrame, size: int, delay_ms: int, expire_after: int) -> DataFrame:
    """A frame stream as a stream of ``OUT``: frames of finished windows, late frames and expired series."""
    slim = payload_entropy(payload_stats(frames)).select(
        *[F.col(f.name).cast("double").alias(f.name) if f.name in _NULLABLE else F.col(f.name) for f in SLIM.fields])
    timed = event_clock(slim.where(F.col("t_us").isNotNull()), "t_us", delay_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from advance(key, batches, state, size, expire_after)

    return timed.groupBy(*SERIES).applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_batch(out: DataFrame, epoch: int, tables: KeyedWindowTables, size: int) -> None:
    """Windows and side outputs of one micro-batch. A window's frames are all here, so its features are one aggregation."""
    batch_session(out)
    out = out.withColumns({n: F.col(n).cast("int") for n in _NULLABLE}).persist()
    framed = out.where(F.col("kind") == FRAME).withColumn("w", F.floor(F.col("rn") / size))
    also = {"started_us": F.min("started_us"), "ended_us": F.max("t_us")}
    tables.windows.write(features_of_windows(framed, size, also=also), epoch)
    tables.late.write(out.where(F.col("kind") == LATE), epoch)
    tables.expired.write(
        out.where(F.col("kind") == EXPIRED).select(*SERIES, "started_us", F.col("rn").alias("n_windows"), F.col("seq").alias("n_pending"), F.col("t_us").alias("last_us")), epoch)
    out.unpersist()


def start_keyed_windows(
    frames: DataFrame, root: str, size: int = fv.WINDOW_SIZE, delay_ms: int = 0, expire_after: int = EXPIRE_AFTER, once: bool = True
) -> StreamingQuery:
    """Windows of a frame stream; ``once`` stops when the input is used up.

    ``delay_ms`` is how far the watermark stays behind the newest frame of all series: disorder within it costs nothing. A series
    that comes back after ``expire_after`` starts anew with window 0; ``started_us`` tells the two apart. Frames without a time
    are left out; times before 1970 are below any watermark.
    """
    tables = KeyedWindowTables.at(frames.sparkSession, root)
    writer = (
        keyed_windows(frames, size, delay_ms, expire_after).writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint-windows")
        .foreachBatch(lambda df, epoch: write_batch(df, epoch, tables, size))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_windows(
    frames: DataFrame, root: str, busy: Column, size: int = fv.WINDOW_SIZE, delay_ms: int = 0, once: bool = True
) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries over one stream: series that are ``busy`` (a condition on the series) by tables, whose numbering is dealt
    over tasks, and all others with keyed state."""
    is_busy = F.coalesce(busy, F.lit(False))
    return (
        start_keyed_windows(frames.where(~is_busy), f"{root}/keyed", size, delay_ms, once=once),
        start_count_windows(frames.where(is_busy), f"{root}/busy", size, delay_ms * 1000, once=once),
    )


def all_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows of both queries of ``start_windows``."""
    columns = [f.name for f in stored_schema().fields]
    keyed = KeyedWindowTables.at(spark, f"{root}/keyed").windows.all()
    return keyed.select(*columns).unionByName(CountWindowTables.at(spark, f"{root}/busy").windows.all().select(*columns))
