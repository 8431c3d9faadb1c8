"""Questions about frames and windows; these run from the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators import fleet, frames as fr, identifiers as ids, windows as wi
from busvitals.operators.health import filter_by_class
from busvitals.operators.ordering import number_rows
from busvitals.plans.reference_sql import CLASS_ORD, build, out, windows_cte
from busvitals.plans.registry import question
from busvitals.sources.scratch import fresh_path, stored
from busvitals.plans.workspace import Workspace
from busvitals.sources import can_logs
from busvitals.sources.tables import load_windows, write_windows

_PAYLOAD_TEXT = "array_to_string(payload, ' ')"
_WINDOW_COLUMNS = "vehicle_id capture w attack_label attack_type n_frames"


def _payload_text(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", F.array_join("payload", " "))


_PARSED = out(
    f"SELECT seq AS line_id, t_us / 1e6 AS t, t_us, can_id, dlc, {_PAYLOAD_TEXT} AS payload, flag FROM frames",
    "line_id t_us can_id dlc payload flag", "t",
)


@question("parse_can_csv", build("frames", _PARSED))
def parse_can_csv(ws: Workspace) -> DataFrame:
    """Every frame written as a comma-separated line, then parsed back."""
    good, _ = can_logs.parse_can_csv(can_logs.csv_lines(ws.frames()))
    return _payload_text(good)


@question("parse_can_txt", build("frames", _PARSED))
def parse_can_txt(ws: Workspace) -> DataFrame:
    """Every frame written as labelled free text, then parsed back."""
    good, _ = can_logs.parse_can_txt(can_logs.txt_lines(ws.frames()))
    return _payload_text(good)


@question("can_frames", build("frames", f"SELECT vehicle_id, capture, attack_type, CAST(attack_label AS INTEGER) AS attack_label, t_us, seq, can_id, dlc, {_PAYLOAD_TEXT} AS payload, CAST(flag AS INTEGER) AS flag FROM frames"))
def can_frames(ws: Workspace) -> DataFrame:
    return _payload_text(ws.frames())


@question("dedup_frames", build("frames", f"SELECT vehicle_id, capture, t_us, can_id, {_PAYLOAD_TEXT} AS payload, min(seq) AS seq FROM (SELECT * FROM frames UNION ALL SELECT * FROM frames) GROUP BY vehicle_id, capture, t_us, can_id, payload"))
def dedup_frames(ws: Workspace) -> DataFrame:
    """Every frame recorded twice, the second time with a later sequence number, and once without a time."""
    f = ws.frames()
    again = f.withColumn("seq", F.col("seq") + 1_000_000_000_000)
    broken = f.withColumn("t_us", F.lit(None).cast("bigint"))
    clean = fr.dedup_frames(f.unionByName(again).unionByName(broken))
    return _payload_text(clean.select("vehicle_id", "capture", "t_us", "can_id", "payload", "seq"))


@question("hex_to_int", "SELECT event_id, CAST(user_id AS INTEGER) AS user_int, CAST(event_id % 256 AS INTEGER) AS byte_int FROM events")
def hex_to_int(ws: Workspace) -> DataFrame:
    events = ws.spark.read.parquet(f"{ws.folder}/events.parquet")
    return events.select(
        "event_id",
        can_logs.hex_to_int(F.concat(F.lit("0x"), F.hex("user_id"))).alias("user_int"),
        can_logs.hex_to_int(F.lpad(F.hex(F.col("event_id") % 256), 2, "0")).alias("byte_int"),
    )


@question("can_id_features", build("frames", "SELECT seq, can_id AS can_id_dec, CAST(2047 - can_id AS INTEGER) AS can_id_priority, CAST(can_id > 2047 AS INTEGER) AS is_extended_id FROM frames"))
def can_id_features(ws: Workspace) -> DataFrame:
    return fr.can_id_features(ws.frames()).select("seq", "can_id_dec", "can_id_priority", "is_extended_id")


@question("dlc_features", build("frames", out("SELECT seq, dlc, dlc / 8e0 AS dlc_normalized FROM frames", "seq dlc", "dlc_normalized")))
def dlc_features(ws: Workspace) -> DataFrame:
    return fr.dlc_features(ws.frames()).select("seq", "dlc", "dlc_normalized")


@question("payload_stats", build("frames", out(
    """SELECT f.seq, coalesce(avg(b), 0) AS payload_mean, coalesce(stddev_pop(b), 0) AS payload_std, CAST(coalesce(sum(b), 0) AS BIGINT) AS payload_sum,
        CAST(coalesce(min(b), 0) AS INTEGER) AS payload_min, CAST(coalesce(max(b), 0) AS INTEGER) AS payload_max,
        CAST(count(*) FILTER (b <> 0) AS INTEGER) AS payload_non_zero_count
    FROM frames f LEFT JOIN (SELECT seq, unnest(payload) AS b FROM frames) x ON f.seq = x.seq GROUP BY f.seq""",
    "seq payload_sum payload_min payload_max payload_non_zero_count", "payload_mean payload_std")))
def payload_stats(ws: Workspace) -> DataFrame:
    return fr.payload_stats(ws.frames()).select(
        "seq", "payload_sum", "payload_min", "payload_max", "payload_non_zero_count", "payload_mean", "payload_std"
    )


@question("payload_entropy", build("numbered", out("SELECT seq, payload_entropy FROM numbered", "seq", "payload_entropy")))
def payload_entropy(ws: Workspace) -> DataFrame:
    return fr.payload_entropy(ws.frames()).select("seq", "payload_entropy")


@question("attack_type_encoded", build("frames", f"SELECT seq, attack_type, CAST({CLASS_ORD} AS INTEGER) AS attack_type_encoded FROM frames"))
def attack_type_encoded(ws: Workspace) -> DataFrame:
    return fr.attack_type_encoded(ws.frames()).select("seq", "attack_type", "attack_type_encoded")


@question("engineered_frames", build("numbered", out(
    f"""SELECT seq, t_us / 1e6 AS timestamp_seconds, delta_time, can_id AS can_id_dec, CAST(2047 - can_id AS INTEGER) AS can_id_priority,
        dlc / 8e0 AS dlc_normalized, payload_entropy, CAST(attack_label AS INTEGER) AS attack_label, CAST({CLASS_ORD} AS INTEGER) AS attack_type_encoded FROM numbered""",
    "seq can_id_dec can_id_priority attack_label attack_type_encoded", "timestamp_seconds delta_time dlc_normalized payload_entropy")))
def engineered_frames(ws: Workspace) -> DataFrame:
    """All per-frame columns in one pass."""
    return fr.engineer_frames(ws.frames()).select(
        "seq", "can_id_dec", "can_id_priority", "attack_label", "attack_type_encoded", "timestamp_seconds", "delta_time",
        "dlc_normalized", "payload_entropy",
    )


@question("delta_time", build("numbered", out("SELECT vehicle_id, capture, seq, rn, delta_time FROM numbered", "vehicle_id capture seq rn", "delta_time")))
def delta_time(ws: Workspace) -> DataFrame:
    return fr.delta_time(ws.frames()).select("vehicle_id", "capture", "seq", "rn", "delta_time")


@question("count_window", build("numbered", "SELECT vehicle_id, capture, seq, rn, CAST(floor(rn / 50) AS BIGINT) AS w FROM numbered"))
def count_window(ws: Workspace) -> DataFrame:
    return wi.count_window(ws.frames()).select("vehicle_id", "capture", "seq", "rn", "w")


def _feature_sql(source: str) -> str:
    return out(f"SELECT * REPLACE (CAST(w AS BIGINT) AS w, CAST(attack_label AS INTEGER) AS attack_label) FROM {source}",
               _WINDOW_COLUMNS, " ".join(fv.FEATURES))


def _window_columns(df: DataFrame) -> DataFrame:
    return df.select(*_WINDOW_COLUMNS.split(), *fv.FEATURES)


@question("window_features", build("windows", _feature_sql("windows")))
def window_features(ws: Workspace) -> DataFrame:
    return _window_columns(wi.window_features(ws.frames()))


@question("window_features_w10", build("numbered", _feature_sql("windows10"), windows_cte(10, "windows10")))
def window_features_w10(ws: Workspace) -> DataFrame:
    return _window_columns(wi.window_features(ws.frames(), size=10))


@question("window_features_w100", build("numbered", _feature_sql("windows100"), windows_cte(100, "windows100")))
def window_features_w100(ws: Workspace) -> DataFrame:
    return _window_columns(wi.window_features(ws.frames(), size=100))


@question("window_tail_policy", build("numbered", """
    SELECT 'drop' AS policy, capture, CAST(sum(floor(n / 50)) AS BIGINT) AS n_windows, CAST(sum(floor(n / 50) * 50) AS BIGINT) AS n_frames FROM c GROUP BY capture
    UNION ALL SELECT 'keep', capture, CAST(sum(ceil(n / 50)) AS BIGINT), CAST(sum(n) AS BIGINT) FROM c GROUP BY capture
    UNION ALL SELECT 'round', capture, CAST(sum(floor(n / 50) + CASE WHEN n % 50 >= 25 THEN 1 ELSE 0 END) AS BIGINT),
        CAST(sum(floor(n / 50) * 50 + CASE WHEN n % 50 >= 25 THEN n % 50 ELSE 0 END) AS BIGINT) FROM c GROUP BY capture""",
    "c AS (SELECT capture, count(*) AS n FROM numbered GROUP BY capture)"))
def window_tail_policy(ws: Workspace) -> DataFrame:
    """Windows and frames kept under each policy for the unfinished last window."""
    parts = [
        wi.window_features(ws.frames(), tail=policy)
        .groupBy(F.lit(policy).alias("policy"), "capture")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_frames").alias("n_frames"))
        for policy in ("drop", "keep", "round")
    ]
    return fr.union_captures(*parts)


@question("can_id_entropy", build("windows", out("SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, can_id_entropy FROM windows", "vehicle_id capture w", "can_id_entropy")))
def can_id_entropy(ws: Workspace) -> DataFrame:
    return wi.window_features(ws.frames()).select("vehicle_id", "capture", "w", "can_id_entropy")


@question("unique_can_ids", build("windows", "SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, CAST(unique_can_ids_window AS BIGINT) AS unique_can_ids FROM windows"))
def unique_can_ids(ws: Workspace) -> DataFrame:
    return wi.window_features(ws.frames()).select(
        "vehicle_id", "capture", "w", F.col("unique_can_ids_window").cast("bigint").alias("unique_can_ids")
    )


@question("window_label", build("windows", """SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, CAST(attack_label AS INTEGER) AS capture_label, attack_type AS capture_type,
    CAST(flagged > 0.5 AS INTEGER) AS majority_label, CASE WHEN flagged > 0.5 THEN attack_type ELSE 'Normal' END AS majority_type FROM windows"""))
def window_label(ws: Workspace) -> DataFrame:
    return wi.both_labels(wi.count_window(ws.frames()))


@question("window_size_comparison", build("frames", """SELECT CAST(s AS INTEGER) AS window_size, attack_type, CAST(sum(floor(n / s)) AS BIGINT) AS n_windows
    FROM (SELECT vehicle_id, capture, min(attack_type) AS attack_type, count(*) AS n FROM frames GROUP BY ALL) CROSS JOIN (VALUES (10), (50), (100)) t(s) GROUP BY ALL"""))
def window_size_comparison(ws: Workspace) -> DataFrame:
    return wi.window_size_comparison(ws.frames())


@question("eda_profile", build("numbered", out(
    """SELECT a.vehicle_id, a.capture, a.frames, a.unique_ids, i.id_entropy, a.mean_delta, a.mean_dlc, a.full_frames FROM (
        SELECT vehicle_id, capture, count(*) AS frames, count(DISTINCT can_id) AS unique_ids, avg(delta_time) AS mean_delta, avg(dlc) AS mean_dlc,
            avg(CASE WHEN dlc = 8 THEN 1e0 ELSE 0e0 END) AS full_frames FROM numbered GROUP BY ALL) a
    JOIN (SELECT vehicle_id, capture, -sum(p * log2(p)) AS id_entropy FROM (
        SELECT vehicle_id, capture, can_id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY vehicle_id, capture) AS p FROM numbered GROUP BY vehicle_id, capture, can_id)
        GROUP BY ALL) i USING (vehicle_id, capture)""",
    "vehicle_id capture frames unique_ids", "id_entropy mean_delta mean_dlc full_frames")))
def eda_profile(ws: Workspace) -> DataFrame:
    return fleet.eda_profile(fr.delta_time(ws.frames()))


@question("dlc_distribution", build("frames", "SELECT vehicle_id, capture, dlc, count(*) AS n FROM frames GROUP BY ALL"))
def dlc_distribution(ws: Workspace) -> DataFrame:
    return ws.frames().groupBy("vehicle_id", "capture", "dlc").agg(F.count(F.lit(1)).alias("n"))


@question("top_can_ids", build("frames", """SELECT vehicle_id, capture, can_id, n, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY vehicle_id, capture ORDER BY n DESC, can_id) AS rank FROM (
        SELECT vehicle_id, capture, can_id, count(*) AS n FROM frames GROUP BY ALL)) WHERE rank <= 7"""))
def top_can_ids(ws: Workspace) -> DataFrame:
    return fleet.top_can_ids(ws.frames())


@question("data_reduction", build("windows", out(
    "SELECT f AS frames, w AS windows, CAST(f AS DOUBLE) / w AS frames_per_window FROM (SELECT count(*) AS f FROM frames) CROSS JOIN (SELECT count(*) AS w FROM windows)",
    "frames windows", "frames_per_window")))
def data_reduction(ws: Workspace) -> DataFrame:
    return fleet.data_reduction(ws.frames(), ws.windows())


@question("time_order", build("numbered", "SELECT vehicle_id, capture, seq, rn AS position FROM numbered"))
def time_order(ws: Workspace) -> DataFrame:
    """Frames in time order, with their position in it, numbered by where the rows physically lie."""
    ordered = fr.time_order(ws.frames().select("vehicle_id", "capture", "t_us", "seq"))
    lying = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    return number_rows(lying, fr.SERIES, ["at"], "position").select("vehicle_id", "capture", "seq", "position")


@question("union_captures", build("frames", "SELECT attack_type, CAST(attack_label AS INTEGER) AS attack_label, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM frames GROUP BY ALL"))
def union_captures(ws: Workspace) -> DataFrame:
    """The captures taken apart by class and put together again."""
    f = ws.frames()
    whole = fr.union_captures(*[filter_by_class(f, c) for c in fv.CLASSES])
    return whole.groupBy("attack_type", "attack_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@question("load_windows", build("windows", _feature_sql("windows")))
def load_stored_windows(ws: Workspace) -> DataFrame:
    return _window_columns(ws.windows())


@question("write_windows", build("windows", _feature_sql("windows")))
def write_then_load(ws: Workspace) -> DataFrame:
    """Written to a fresh folder, one sub-folder per capture, and read back."""
    path = fresh_path(ws.spark, "write-windows")
    write_windows(ws.windows(), path)
    return _window_columns(load_windows(ws.spark, path))


@question("window_index_global", build("scored", f"SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, row_number() OVER (ORDER BY {CLASS_ORD}, w) - 1 AS window_index FROM windows"))
def window_index_global(ws: Workspace) -> DataFrame:
    return wi.window_index(ws.windows(), scope=()).select("vehicle_id", "capture", "w", "window_index")


@question("filter_by_class", build("windows", f"""SELECT 'normal' AS asked, attack_type, count(*) AS n FROM windows WHERE attack_label = 0 GROUP BY ALL
    UNION ALL SELECT 'dos', attack_type, count(*) FROM windows WHERE lower(attack_type) = 'dos' GROUP BY ALL
    UNION ALL SELECT 'attack', attack_type, count(*) FROM windows WHERE attack_type <> 'Normal' GROUP BY ALL"""))
def filter_classes(ws: Workspace) -> DataFrame:
    parts = [
        filter_by_class(ws.windows(), asked).groupBy(F.lit(asked).alias("asked"), "attack_type").agg(F.count(F.lit(1)).alias("n"))
        for asked in ("normal", "dos", "attack")
    ]
    return fr.union_captures(*parts)


@question("id_frequency_deviation", build("numbered", out("""SELECT vehicle_id, capture, w, (sum(abs(c / 50e0 - p)) + 1e0 - sum(p)) / 2 AS id_deviation, count(*) FILTER (unseen) AS unseen_ids,
        CAST(coalesce(sum(c) FILTER (unseen), 0) AS BIGINT) AS unseen_frames, arg_min(can_id, (-round(c / 50e0 - p, 9), can_id)) AS loudest_id
    FROM (SELECT n.*, coalesce(s.share, 0e0) AS p, s.share IS NULL AS unseen FROM (
        SELECT vehicle_id, capture, CAST(rn // 50 AS BIGINT) AS w, can_id, count(*) AS c FROM numbered GROUP BY ALL) n LEFT JOIN shares s USING (can_id))
    GROUP BY ALL HAVING sum(c) = 50""", "vehicle_id capture w unseen_ids unseen_frames loudest_id", "id_deviation"),
    "shares AS (SELECT can_id, count(*) * 1e0 / (SELECT count(*) FROM numbered WHERE attack_label = 0) AS share FROM numbered WHERE attack_label = 0 GROUP BY can_id)"))
def id_frequency_deviation(ws: Workspace) -> DataFrame:
    """How far each window's identifiers are from the shares that normal traffic gives them."""
    frames = ws.frames()
    return ids.id_frequency_deviation(wi.count_window(frames), ids.normal_id_shares(frames))


@question("fleet_unique_ids", build("frames", """SELECT capture, CAST(count(*) AS BIGINT) AS frames, count(DISTINCT can_id) AS unique_ids, TRUE AS within_error FROM frames GROUP BY capture
    UNION ALL SELECT 'all', CAST(count(*) AS BIGINT), count(DISTINCT can_id), TRUE FROM frames"""))
def fleet_unique_ids(ws: Workspace) -> DataFrame:
    """Distinct identifiers per capture and of the fleet, counted, and whether the stored sketches say so within their error."""
    sketches = stored(ids.id_sketches(ws.frames()), "id-sketches")
    told = ids.unique_ids(sketches, ["capture"]).unionByName(ids.unique_ids(sketches).withColumn("capture", F.lit("all")))
    counted = ws.frames().select("capture", "can_id").distinct()
    exact = counted.groupBy("capture").agg(F.count("can_id").alias("n")).unionByName(
        counted.select("can_id").distinct().agg(F.count("can_id").alias("n")).withColumn("capture", F.lit("all")))
    near = F.abs(F.col("unique_ids") - F.col("n")) <= F.lit(ids.estimate_error()) * F.col("n")
    return told.join(exact, "capture").select("capture", "frames", F.col("n").alias("unique_ids"), near.alias("within_error"))
