"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
``python bench.py --vehicles 10`` instead times the frame-to-window path on the events repeated for that many vehicles.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINES = [
    "parse_can_csv", "dedup_frames", "engineered_frames", "window_features", "window_size_comparison", "eda_profile",
    "load_windows", "parzen_detector", "rbf_score", "detect", "health_score", "health_summary", "health_by_attack",
    "health_overview", "trend_at_window", "ema_series", "forecast", "recovery_islands", "classification_metrics",
    "roc_auc", "average_precision", "feature_importance", "root_cause", "threat_story", "stories_all_classes",
    "response_decision", "decision_summary", "attack_run_summary", "ecu_status", "isolation_forest", "lof_score",
    "ocsvm_fit",
]
# timed too, beside the headline total
MORE = ["stream_count_windows", "stream_late_frames", "stream_trend", "stream_decisions", "knn_join", "knn_join_approximate", "id_frequency_deviation",
        "fleet_unique_ids", "class_stories"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    """Compute every column of every row without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--vehicles", type=int, default=0)
    opts = args.parse_args()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)

    from busvitals.operators.windows import window_features
    from busvitals.plans.catalog import QUERIES
    from busvitals.plans.workspace import workspace
    from busvitals.sources.event_frames import frames_from_events

    times: dict[str, float] = {}
    more: dict[str, float] = {}
    if opts.vehicles:
        events = spark.read.parquet(f"{folder}/events.parquet")
        copies = spark.range(opts.vehicles).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("vehicle"))
        fleet = events.repartition(int(cpus)).crossJoin(F.broadcast(copies))
        frames = frames_from_events(fleet, F.col("vehicle"))
        times["window_features"] = timed(lambda: run(window_features(frames)))
    else:
        run(spark.read.parquet(f"{folder}/events.parquet"))  # start the executors before the clock does
        ws = workspace(spark, folder)
        times["build_windows"] = timed(ws.windows)
        times["build_model"] = timed(ws.model)
        times["build_scored"] = timed(lambda: (ws.scored(), ws.baseline(0), ws.baseline(1)))
        for name in HEADLINES:
            times[name] = timed(lambda: run(QUERIES[name](spark, folder)))
        for name in MORE:
            more[name] = timed(lambda: run(QUERIES[name](spark, folder)))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times | more,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        **({"vehicles": opts.vehicles} if opts.vehicles else {}),
    }))


if __name__ == "__main__":
    main()
