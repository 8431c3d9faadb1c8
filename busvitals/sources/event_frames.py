"""Bus frames derived from the generic ``events`` table, one capture per event type.

About half of the frames of an attack capture (value >= 35) are injected ones. They carry what the attack is known
for: the top-priority id and empty bytes (DoS), random ids (Fuzzy), one fixed id and fixed bytes (Gear, RPM).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type -> capture class.
CAPTURES = {"click": "Normal", "purchase": "DoS", "signup": "Fuzzy", "view": "Gear", "error": "RPM"}
# Id and first byte of injected frames (bytes then step by 16); Fuzzy draws its id and keeps its bytes.
INJECTED_ID = {"DoS": 0, "Gear": 1087, "RPM": 790}
INJECTED_BYTE = {"DoS": (0, 0), "Gear": (0, 16), "RPM": (8, 16)}
INJECTED_FROM = 35.0

FRAME_COLUMNS = [
    "vehicle_id", "capture", "attack_type", "attack_label", "t_us", "seq", "can_id", "dlc", "payload", "flag",
]


def epoch_micros(ts: str, dtype: str) -> Column:
    """Microseconds since 1970; zone-less timestamps do not depend on the session time zone."""
    if dtype == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return F.unix_micros(F.col(ts))


def frames_from_events(events: DataFrame, vehicle_id: Column | None = None) -> DataFrame:
    """One frame per event; the payload bytes are the first ``dlc`` bytes of the md5 of the event id, or injected.

    An unknown event type has no capture and no label: nothing says that it is normal traffic.
    """
    label = F.lit(None).cast("string")
    for kind, name in CAPTURES.items():
        label = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(label)
    attacked = label != F.lit("Normal")
    injected = attacked & (F.col("value") >= INJECTED_FROM)

    can_id = F.pmod(F.col("user_id"), F.lit(16))
    can_id = F.when(injected & (label == "Fuzzy"), F.pmod(F.col("event_id") * 7919, F.lit(2048))).otherwise(can_id)
    for name, fixed in INJECTED_ID.items():
        can_id = F.when(injected & (label == name), F.lit(fixed)).otherwise(can_id)

    # two 32-bit halves of the digest as numbers; the bytes are cut out of them by shifting
    digest = F.md5(F.col("event_id").cast("string").cast("binary"))
    halves = [F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") for start in (1, 9)]
    events = events.withColumns({"_high": halves[0], "_low": halves[1]})
    payload = F.array(*[
        F.shiftright(F.col(half), shift).bitwiseAND(255).cast("int") for half in ("_high", "_low") for shift in (24, 16, 8, 0)
    ])
    for name, (first, step) in INJECTED_BYTE.items():
        fixed_bytes = F.array(*[F.lit(first + step * i) for i in range(8)])
        payload = F.when(injected & (label == name), fixed_bytes).otherwise(payload)
    dlc = F.pmod(F.col("event_id"), F.lit(9)).cast("int")
    return events.select(
        (vehicle_id if vehicle_id is not None else F.lit("v0")).alias("vehicle_id"),
        label.alias("capture"),
        label.alias("attack_type"),
        F.when(attacked, 1).when(label.isNotNull(), 0).alias("attack_label"),
        epoch_micros("ts", dict(events.dtypes)["ts"]).alias("t_us"),
        F.col("event_id").alias("seq"),
        can_id.cast("int").alias("can_id"),
        dlc.alias("dlc"),
        F.slice(payload, F.lit(1), dlc).alias("payload"),
        F.when(injected, 1).otherwise(0).alias("flag"),
    )


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the known event types; ``unknown_events`` has the rest."""
    return frames_from_events(spark.read.parquet(f"{folder}/events.parquet").where(F.col("event_type").isin(*CAPTURES)))


def unknown_events(events: DataFrame) -> DataFrame:
    """Events whose type names no capture, for a side output."""
    return events.where(~F.coalesce(F.col("event_type").isin(*CAPTURES), F.lit(False)))
