"""Status questions over captures, vehicles and attack classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import dimensions as dims
from busvitals.operators import explain
from busvitals.operators.detect import median_score
from busvitals.operators.ordering import attach
from busvitals.operators.respond import level_from_risk

TWIN_WINDOWS = 100
CLASS_KEY = ["vehicle_id", "attack_type"]


def eda_profile(frames_with_delta: DataFrame) -> DataFrame:
    """Per capture: frames, distinct ids, entropy of the ids, mean gap, mean length."""
    per_id = frames_with_delta.groupBy("vehicle_id", "capture", "can_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum("delta_time").alias("d"), F.count("delta_time").alias("dn"),
        F.sum("dlc").alias("l"), F.count_if(F.col("dlc") == 8).alias("full"),
    )
    n = F.sum("c")
    return per_id.groupBy("vehicle_id", "capture").agg(
        n.alias("frames"),
        F.count(F.lit(1)).alias("unique_ids"),
        (F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n).alias("id_entropy"),
        F.try_divide(F.sum("d"), F.sum("dn")).alias("mean_delta"),
        (F.sum("l") / n).alias("mean_dlc"),
        (F.sum("full") / n).alias("full_frames"),
    )


def top_can_ids(frames: DataFrame, k: int = 7) -> DataFrame:
    """The k most frequent ids of each capture, smaller id first on ties. Ranks ids, not frames."""
    counts = frames.groupBy("vehicle_id", "capture", "can_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("vehicle_id", "capture").orderBy(F.desc("n"), "can_id")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def data_reduction(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames per window."""
    f = frames.agg(F.count(F.lit(1)).alias("frames"))
    w = windows.agg(F.count(F.lit(1)).alias("windows"))
    return f.crossJoin(F.broadcast(w)).withColumn("frames_per_window", F.try_divide(F.col("frames"), F.col("windows")))


def twin_status(windows: DataFrame, first_windows: int = TWIN_WINDOWS) -> DataFrame:
    """Means over the first ``first_windows`` normal windows of each vehicle."""
    first = windows.where((F.col("attack_label") == 0) & (F.col("w") < first_windows))
    rate, entropy = F.avg("messages_per_second"), F.avg("window_payload_entropy_mean")
    return first.groupBy("vehicle_id").agg(
        rate.alias("can_rate"),
        F.avg("unique_can_ids_window").alias("can_id_diversity"),
        F.avg("can_id_entropy").alias("entropy"),
        rate.alias("message_frequency"),
        rate.alias("baseline_frequency"),
        entropy.alias("payload_entropy"),
        entropy.alias("baseline_entropy"),
        F.bround(F.avg("window_delta_time_std"), 4).alias("signal_drift"),
        F.bround(100 - F.avg("payload_instability_score") * 10, 1).alias("twin_integrity"),
    )


def ecu_status(health: DataFrame) -> DataFrame:
    """Seven units with the status of the mean health and their share of the normal frame rate."""
    overall = health.agg(
        F.avg("cyber_health").alias("_h"),
        F.coalesce(F.avg(F.when(F.col("attack_label") == 0, F.col("messages_per_second"))), F.lit(0.0)).alias("_r"),
    )
    status = F.when(F.col("_h") >= 60, "secure").when(F.col("_h") >= 30, "warning").otherwise("critical")
    return dims.ecus(health.sparkSession).crossJoin(F.broadcast(overall)).select(
        "ecu_id",
        "ecu_name",
        status.alias("status"),
        F.bround(F.col("_r") * F.col("rate_frac"), 0).cast("bigint").alias("packet_rate"),
        F.bround(F.col("rate_frac") * 100 * 0.3, 0).cast("bigint").alias("cpu_load"),
    )


def telemetry_snapshot(windows: DataFrame) -> DataFrame:
    """Normal-window means under the names they deserve, and all windows per normal window."""
    normal = F.col("attack_label") == 0

    def mean(c: str, times: int = 1) -> Column:
        return F.coalesce(F.avg(F.when(normal, F.col(c) * times)), F.lit(0.0))

    return windows.agg(
        F.bround(mean("messages_per_second"), 1).alias("can_rate"),
        F.bround(mean("message_burst_score", 100), 1).alias("burst_pct"),
        F.bround(mean("payload_instability_score", 100), 1).alias("instability_pct"),
        F.floor(F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(normal))).alias("windows_per_normal_window"),
    )


def fleet_stats(health: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals, mean normal health and rate, F1, and all windows per normal window."""
    normal = F.col("attack_label") == 0
    totals = health.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.bround(F.coalesce(F.avg(F.when(F.col("attack_type") == "Normal", F.col("cyber_health"))), F.lit(0.0)), 1).alias("normal_health"),
        F.bround(F.coalesce(F.avg(F.when(normal, F.col("messages_per_second"))), F.lit(0.0)), 1).alias("can_rate"),
        F.floor(F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(normal))).alias("windows_per_normal_window"),
    )
    return totals.crossJoin(F.broadcast(metrics.select(F.bround("f1", 4).alias("detector_f1"))))


def ecu_target(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(dims.targets(rows.sparkSession)), "attack_type", "left")


def recovery_estimate(rows: DataFrame) -> DataFrame:
    """After an attack a quarter of the lost health stays lost; 15 ms per lost point, truncated."""
    deficit = F.col("health_before") - F.col("health_during")
    attacked = F.col("attack_type") != "Normal"
    return rows.withColumns(
        {
            "health_after": F.when(attacked, F.bround(F.col("health_before") - deficit * 0.25, 1)).otherwise(F.col("health_during")),
            "recovery_time_ms": F.when(attacked, (deficit * 15).cast("int")).otherwise(0),
        }
    )


def explained_window_per_class(health: DataFrame) -> DataFrame:
    """Per vehicle the worst window of every attack class and the middle window of the normal one."""
    attacks = explain.worst_window(health.where("attack_type <> 'Normal'"), ("vehicle_id", "attack_type"))
    normal = explain.middle_window(health.where("attack_type = 'Normal'"))
    return attacks.unionByName(normal)


def health_before_during_after(health: DataFrame) -> DataFrame:
    """Per vehicle and class: the middle normal health, the explained window's health, and the recovery estimate."""
    normal = explain.middle_window(health.where("attack_type = 'Normal'"))
    before = normal.groupBy("vehicle_id").agg(F.max("cyber_health").alias("health_before"))
    during = explained_window_per_class(health).select(*CLASS_KEY, F.col("cyber_health").alias("health_during"))
    return recovery_estimate(during.join(before, "vehicle_id"))


def run_summary(health: DataFrame, classified: DataFrame, baseline: DataFrame, trended: DataFrame) -> DataFrame:
    """One row per vehicle and class from detection to recovery.

    For Normal the score is the class median while the features come from its middle window. Apart from the one-row
    model values, every joined table holds one row per vehicle and class; Spark picks the join by their size.
    """
    chosen = explained_window_per_class(health)
    model = classified.agg(F.first("threshold").alias("threshold"), F.stddev_pop("anomaly_score").alias("_spread"))
    scored = attach(attach(chosen, model), median_score(classified)).withColumn(
        "score", F.when(F.col("attack_type") == "Normal", F.col("median_score")).otherwise(F.col("anomaly_score"))
    )
    counts = health.groupBy(*CLASS_KEY).agg(F.count(F.lit(1)).alias("windows_analyzed"))
    totals = health.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("total_windows"))
    key = ["vehicle_id", "capture", "w"]
    joined = (
        scored.join(health_before_during_after(health), CLASS_KEY)
        .join(counts, CLASS_KEY)
        .join(totals, "vehicle_id")
        .join(trended.select(*key, "trend"), key)
        .join(explain.top_driver(chosen, baseline).drop("attack_type"), key)
    )
    distance = F.try_divide(F.abs(F.col("score") - F.col("threshold")), F.col("_spread") * 2)
    leveled = ecu_target(joined).withColumn("defense_level", level_from_risk(F.col("risk_category"), F.col("trend")))
    labels = dims.levels(health.sparkSession).select(F.col("response_level").alias("defense_level"), F.col("level_label").alias("defense_label"))
    return leveled.join(F.broadcast(labels), "defense_level", "left").select(
        "vehicle_id",
        "attack_type",
        F.when(F.col("score") < F.col("threshold"), "anomaly").otherwise("normal").alias("detection_status"),
        F.bround(F.least(F.lit(1.0), distance), 4).alias("confidence"),
        F.bround("score", 4).alias("anomaly_score"),
        F.col("ecu_id").alias("affected_ecu"),
        F.col("ecu_name").alias("affected_ecu_name"),
        F.bround("health_before", 1).alias("health_before"),
        F.bround("health_during", 1).alias("health_during"),
        F.bround("health_after", 1).alias("health_after"),
        "recovery_time_ms",
        F.when(F.col("attack_type") == "Normal", "Secure").otherwise("Restored").alias("final_vehicle_state"),
        "total_windows",
        "windows_analyzed",
        "anomalous_features",
        F.col("top_driver").alias("top_anomaly_driver"),
        "defense_level",
        "defense_label",
    )
