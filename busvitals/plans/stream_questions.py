"""Streams over the whole event table, delivered in slices of many files, compared with the batch answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.plans.frame_questions import _feature_sql, _window_columns
from busvitals.plans.health_questions import KEY, keyed
from busvitals.plans.reference_sql import BLOCKS, build, story_sql, trend_of
from busvitals.plans.registry import question
from busvitals.plans.workspace import Workspace
from busvitals.sources.event_frames import CAPTURES, FRAME_COLUMNS, INJECTED_FROM, epoch_micros, frames_from_events, unknown_events
from busvitals.sources.scratch import fresh_path
from busvitals.streaming.health import HORIZON
from busvitals.streaming.keyed_health import KeyedHealthTables, start_keyed_health
from busvitals.streaming.keyed_windows import KeyedWindowTables, all_windows, start_keyed_windows, start_windows

FILES = 72  # per micro-batch
BATCH_EVENTS = 500_000  # about so many in a micro-batch, whose frames of one series are one task's work
SLICES = 4
DELAY_MS = 60_000
_STATE: dict[tuple[str, str], str] = {}


def deliver(ws: Workspace, order: str = "slices") -> tuple[DataFrame, DataFrame]:
    """The events as a file stream of time slices of ``FILES`` files each, as frames, and the events of unknown types beside it.

    ``late``: the injected-looking part of the second slice comes after all others. ``disordered``: one event in seven comes
    with the next slice.
    """
    spark: SparkSession = ws.spark
    events = spark.read.parquet(f"{ws.folder}/events.parquet")
    micros = epoch_micros("ts", dict(events.dtypes)["ts"])
    ends = events.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    path = fresh_path(spark, "delivered")
    part = F.least(F.floor((micros - ends["a"]) * SLICES / (ends["b"] - ends["a"])), F.lit(SLICES - 1))
    if order == "late":
        injected = (F.col("event_type") != "click") & (F.col("value") >= INJECTED_FROM)
        part = F.when((part == 1) & injected, SLICES).otherwise(part)
    if order == "disordered":
        part = part + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    # a slice of very many events comes in several micro-batches in the order of time, none parting a millisecond
    millis = F.floor(micros / 1000)
    sliced = events.withColumn("part", part)
    several = sliced.where("part IS NOT NULL").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(millis, [k / 64 for k in range(1, 64)], 10_000).alias("at")).collect()
    later = F.lit(0)
    for r in several:
        batches = min(64, math.ceil(r["n"] / BATCH_EVENTS))
        for cut in {r["at"][64 * k // batches - 1] for k in range(1, batches)}:
            later = later + ((F.col("part") == r["part"]) & (millis > cut)).cast("int")
    dealt = fresh_path(spark, "slices")
    sliced.withColumn("later", later).where("part IS NOT NULL").write.partitionBy("part", "later").parquet(dealt)
    given = spark.read.schema(T.StructType([*events.schema, *[T.StructField(c, T.LongType()) for c in ("part", "later")]])).parquet(dealt)
    # one write per micro-batch: files are delivered in the order in which they were written
    for number, then in sorted(map(tuple, given.select("part", "later").distinct().collect())):
        one = given.where((F.col("part") == number) & (F.col("later") == then))
        one.select(*events.columns).repartition(FILES).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    known = arriving.where(F.col("event_type").isin(*CAPTURES))
    return frames_from_events(known).select(*FRAME_COLUMNS), unknown_events(arriving)


def windowed(ws: Workspace, order: str = "slices", delay_ms: int = 0) -> str:
    """Root folder of a finished window stream, run once per workspace."""
    key = (ws.root, f"windows-{order}")
    if key not in _STATE:
        root = fresh_path(ws.spark, "stream")
        start_keyed_windows(deliver(ws, order)[0], root, delay_ms=delay_ms).awaitTermination()
        _STATE[key] = root
    return _STATE[key]


def followed(ws: Workspace) -> KeyedHealthTables:
    """Tables of a finished health stream over the streamed windows."""
    key = (ws.root, "health")
    root = windowed(ws)
    if key not in _STATE:
        windows = KeyedWindowTables.at(ws.spark, root).windows.stream()
        start_keyed_health(windows, root, ws.model(), ws.baseline(1)).awaitTermination()
        _STATE[key] = root
    return KeyedHealthTables.at(ws.spark, _STATE[key])


@question("stream_count_windows", build("windows", _feature_sql("windows")))
def stream_count_windows(ws: Workspace) -> DataFrame:
    return _window_columns(KeyedWindowTables.at(ws.spark, windowed(ws)).windows.all())


@question("stream_busy_windows", build("windows", _feature_sql("windows")))
def stream_busy_windows(ws: Workspace) -> DataFrame:
    """The same windows when the busiest capture goes by tables and all others by keyed state."""
    root = fresh_path(ws.spark, "stream")
    for query in start_windows(deliver(ws)[0], root, F.col("capture") == "Normal"):
        query.awaitTermination()
    return _window_columns(all_windows(ws.spark, root))


@question("stream_late_frames", build("frames", """SELECT vehicle_id, capture, seq, t_us FROM frames CROSS JOIN (SELECT min(t_us) AS a, max(t_us) AS b FROM frames)
    WHERE flag = 1 AND least(floor(CAST((t_us - a) * 4 AS DOUBLE) / (b - a)), 3) = 1"""))
def stream_late_frames(ws: Workspace) -> DataFrame:
    """Injected frames of the second quarter arrive after everything else and are set aside."""
    return KeyedWindowTables.at(ws.spark, windowed(ws, "late")).late.all().select("vehicle_id", "capture", "seq", "t_us")


@question("stream_watermark_late", build("frames", f"""SELECT vehicle_id, capture, seq, t_us FROM (
        SELECT *, part + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS given FROM (
            SELECT *, least(floor(CAST((t_us - a) * {SLICES} AS DOUBLE) / (b - a)), {SLICES - 1}) AS part
            FROM frames CROSS JOIN (SELECT min(t_us) AS a, max(t_us) AS b FROM frames)))
    JOIN (SELECT given, max(max(t_us)) OVER (ORDER BY given ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - {DELAY_MS} AS clock FROM (
        SELECT t_us, least(floor(CAST((t_us - a) * {SLICES} AS DOUBLE) / (b - a)), {SLICES - 1}) + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS given
        FROM frames CROSS JOIN (SELECT min(t_us) AS a, max(t_us) AS b FROM frames)) GROUP BY given) USING (given)
    WHERE t_us // 1000 < clock"""))
def stream_watermark_late(ws: Workspace) -> DataFrame:
    """A seventh of all frames comes one slice too late; those older than the watermark by then are set aside."""
    return KeyedWindowTables.at(ws.spark, windowed(ws, "disordered", DELAY_MS)).late.all().select("vehicle_id", "capture", "seq", "t_us")


@question("stream_health", build("health", keyed("SELECT * FROM hs", "risk_category", "anomaly_score cyber_health threat_component stability_component pressure_component")))
def stream_health(ws: Workspace) -> DataFrame:
    return followed(ws).followed.all().select(
        *KEY, "risk_category", "anomaly_score", "cyber_health", "threat_component", "stability_component", "pressure_component"
    )


_FOLLOWED = """followed AS (
    SELECT *, CASE WHEN w < 19 THEN 0e0 ELSE avg(cyber_health) OVER (s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(cyber_health) OVER (s ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) END AS trend_diff,
        CASE WHEN w >= 2 AND min(CASE WHEN cyber_health > 60 THEN 1 ELSE 0 END) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1
            AND coalesce(lag(CASE WHEN cyber_health > 60 THEN 1 ELSE 0 END, 3) OVER s, 0) = 0 THEN 1 ELSE 0 END AS resume
    FROM hs WINDOW s AS (PARTITION BY vehicle_id, capture ORDER BY w)),
smooth AS (SELECT a.vehicle_id, a.capture, a.w, sum((CASE WHEN b.w = 0 THEN 1e0 ELSE 3e-1 END) * pow(7e-1, a.w - b.w) * b.cyber_health) AS ema
    FROM hs a JOIN hs b ON a.capture = b.capture AND b.w <= a.w GROUP BY ALL)"""


@question("stream_trend", build("health", keyed(f"SELECT *, {trend_of('trend_diff')} AS trend FROM followed JOIN smooth USING (vehicle_id, capture, w)", "trend", "trend_diff ema"), _FOLLOWED))
def stream_trend(ws: Workspace) -> DataFrame:
    return followed(ws).followed.all().select(*KEY, "trend", "trend_diff", "ema")


@question("stream_recovery", build("health", keyed("SELECT * FROM followed WHERE resume = 1", "", "cyber_health"), _FOLLOWED))
def stream_recovery(ws: Workspace) -> DataFrame:
    """Windows at which normal operation may resume: the third healthy one in a row."""
    return followed(ws).followed.all().where("resume = 1").select(*KEY, "cyber_health")


_WEIGHT = sum(math.exp(-i / HORIZON) for i in range(HORIZON)) / HORIZON
_STREAMED = f"""{_FOLLOWED},
to_tell AS (
    SELECT e.*, {trend_of('f.trend_diff')} AS trend, f.trend_diff, s.ema * {_WEIGHT:.17e} + e.cyber_health * (1 - {_WEIGHT:.17e}) AS projected_health
    FROM explained e JOIN followed f USING (vehicle_id, capture, w) JOIN smooth s USING (vehicle_id, capture, w)),
{story_sql()},
{BLOCKS['decisions']}"""


@question("stream_decisions", build("explained", keyed(
    "SELECT * FROM decisions WHERE response_level >= 1", "risk_category trend_label attack_type response_level level_label action_ids", "health_score confidence"), _STREAMED))
def stream_decisions(ws: Workspace) -> DataFrame:
    """Decisions of level 1 and above, appended per micro-batch."""
    return followed(ws).decisions.all()
