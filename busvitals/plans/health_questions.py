"""Questions about scores, health and their history; these read the stored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.functions.dimensions import feature_categories
from busvitals.functions.scalars import deviation_direction, healthiness, risk_category
from busvitals.operators import baseline as bl, detect as dt, evaluate as ev, fleet, health as he, kernel, series as se
from busvitals.operators.ordering import attach
from busvitals.operators.sampling import subsample_normal
from busvitals.plans.reference_sql import (
    ALL, build, health_of, out, trend_of, values, z_of,
)
from busvitals.plans.registry import question
from busvitals.sources.scratch import fresh_path
from busvitals.plans.workspace import Workspace

KEY = ["vehicle_id", "capture", "w"]
SERIES = ["vehicle_id", "capture"]
W = "CAST(w AS BIGINT) AS w"


def keyed(body: str, plain: str = "", doubles: str = "") -> str:
    """``out`` for rows keyed by window."""
    return out(body, "vehicle_id capture w " + plain, doubles).replace(
        "SELECT vehicle_id, capture, w", f"SELECT vehicle_id, capture, {W}", 1
    )


# ---- baseline and scaling --------------------------------------------------------------------------------------

@question("fit_baseline", build("health", out(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mean, s_{c} AS std FROM base_e" for c in ALL), "feature", "mean std")))
def fit_baseline(ws: Workspace) -> DataFrame:
    return bl.baseline_table(bl.fit_baseline(ws.scored()))


@question("fit_baseline_sample", build("health", out(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mean, s_{c} AS std FROM base_s" for c in ALL), "feature", "mean std")))
def fit_baseline_sample(ws: Workspace) -> DataFrame:
    """The service's variant: sample deviation for the features."""
    return bl.baseline_table(bl.fit_baseline(ws.scored(), ddof=1))


@question("baseline_join", build("health", keyed(
    "SELECT h.vehicle_id, h.capture, h.w, m_anomaly_score AS mean, s_anomaly_score AS std FROM scored h CROSS JOIN base_e", "", "mean std")))
def baseline_join(ws: Workspace) -> DataFrame:
    return bl.baseline_join(ws.scored(), ws.baseline(0)).select(
        *KEY, F.col("m_anomaly_score").alias("mean"), F.col("s_anomaly_score").alias("std")
    )


@question("standard_scale", build("support", keyed("SELECT * FROM scaled", "", " ".join(fv.FEATURES))))
def standard_scale(ws: Workspace) -> DataFrame:
    return bl.standard_scale(ws.windows()).select(*KEY, *fv.FEATURES)


_ALL_SCALE = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fv.FEATURES)


@question("standard_scale_all", build("windows", keyed(
    f"SELECT h.vehicle_id, h.capture, h.w, {', '.join(f'(h.{c} - b.m_{c}) / b.s_{c} AS {c}' for c in fv.FEATURES)} FROM windows h CROSS JOIN (SELECT {_ALL_SCALE} FROM windows) b",
    "", " ".join(fv.FEATURES))))
def standard_scale_all(ws: Workspace) -> DataFrame:
    """Scaler fitted on every window, as the explanation run does."""
    return bl.standard_scale(ws.windows(), fit="all").select(*KEY, *fv.FEATURES)


_LONG_Z = " UNION ALL ".join(
    f"SELECT h.vehicle_id, h.capture, h.w, '{c}' AS feature, h.{c} AS value, {z_of(c)} AS z FROM scored h CROSS JOIN base_e b" for c in ALL
)


@question("zscore", build("health", keyed(_LONG_Z, "feature", "value z")))
def zscores(ws: Workspace) -> DataFrame:
    return bl.zscores_long(ws.scored(), ws.baseline(0))


@question("healthiness", build("health", keyed(" UNION ALL ".join(
    f"SELECT h.vehicle_id, h.capture, h.w, '{f}' AS feature, '{d}' AS direction, {health_of(z_of(f), d)} AS healthiness FROM scored h CROSS JOIN base_e b"
    for f, _, _, _, d in fv.TRACKED), "feature direction", "healthiness")))
def healthiness_long(ws: Workspace) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"),
                 healthiness(F.col(f), F.col(f"m_{f}"), F.col(f"s_{f}"), d).alias("healthiness"))
        for f, _, _, _, d in fv.TRACKED
    ])
    return attach(ws.scored(), ws.baseline(0)).select(*KEY, F.explode(rows).alias("_r")).select(*KEY, "_r.*")


@question("deviation_direction", build("health", f"""SELECT vehicle_id, capture, {W}, feature,
    CASE WHEN z > 5e-1 THEN 'above normal' WHEN z < -5e-1 THEN 'below normal' ELSE 'within normal range' END AS direction FROM ({_LONG_Z})"""))
def directions(ws: Workspace) -> DataFrame:
    return bl.zscores_long(ws.scored(), ws.baseline(0)).select(*KEY, "feature", deviation_direction(F.col("z")).alias("direction"))


@question("feature_category", build("windows", f"SELECT c.feature, c.category, count(*) AS n, round(avg(CASE c.feature {' '.join(f'''WHEN '{f}' THEN w.{f}''' for f in fv.FEATURES)} END) + 3.7e-08, 6) AS mean_value FROM windows w CROSS JOIN ({values(fv.FEATURE_CATEGORY, 'feature, category')}) c GROUP BY ALL"))
def feature_category(ws: Workspace) -> DataFrame:
    """Every feature with its group, count and mean over all windows."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in fv.FEATURES])
    long = ws.windows().select(F.explode(cells).alias("_r")).select("_r.*")
    means = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return means.join(F.broadcast(feature_categories(ws.spark)), "feature", "left").withColumn(
        "category", F.coalesce("category", F.lit("Other"))
    )


# ---- scores ----------------------------------------------------------------------------------------------------

_SCORE_SQL = build("scored", keyed("SELECT * FROM scored", "", "anomaly_score"))


@question("rbf_score", _SCORE_SQL)
def rbf_score(ws: Workspace) -> DataFrame:
    """All windows scored with the stored model."""
    return kernel.rbf_score(ws.windows(), ws.model()).select(*KEY, "anomaly_score")


@question("parzen_detector", _SCORE_SQL)
def parzen_detector(ws: Workspace) -> DataFrame:
    """Model fitted anew, then all windows scored."""
    return kernel.rbf_score(ws.windows(), kernel.fit_parzen(ws.windows())).select(*KEY, "anomaly_score")


@question("model_tables", build("scored", out(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord, m_{c} AS mean, s_{c} AS std, CAST((SELECT count(*) FROM support) AS BIGINT) AS n_support, (SELECT rho FROM offset_) AS rho FROM scale" for i, c in enumerate(fv.FEATURES)),
    "feature ord n_support", "mean std rho")))
def model_tables(ws: Workspace) -> DataFrame:
    """Model saved as tables, loaded, and saved again; the second copy is shown."""
    first, second = fresh_path(ws.spark, "model"), fresh_path(ws.spark, "model")
    kernel.save_model(ws.spark, ws.model(), first)
    kernel.save_model(ws.spark, kernel.load_model(ws.spark, first), second)
    support = ws.spark.read.parquet(f"{second}/support").agg(F.count(F.lit(1)).alias("n_support"))
    params = ws.spark.read.parquet(f"{second}/params").select("rho")
    return attach(attach(ws.spark.read.parquet(f"{second}/scaler"), support), params).select(
        "feature", "ord", "n_support", "mean", "std", "rho"
    )


@question("subsample_normal", build("support", f"SELECT vehicle_id, capture, {W} FROM support"))
def subsample(ws: Workspace) -> DataFrame:
    return subsample_normal(ws.windows()).select(*KEY)


@question("subsample_normal_10", build("windows", f"""SELECT vehicle_id, capture, {W} FROM (SELECT * FROM windows WHERE attack_label = 0
    ORDER BY md5(concat_ws('|', vehicle_id, capture, CAST(w AS VARCHAR), '42')), vehicle_id, capture, w LIMIT 10)"""))
def subsample_10(ws: Workspace) -> DataFrame:
    """A draw smaller than the table."""
    return subsample_normal(ws.windows(), 10).select(*KEY)


@question("score_threshold", build("threshold", out("SELECT * FROM threshold", "", "threshold")))
def score_threshold(ws: Workspace) -> DataFrame:
    return dt.score_threshold(ws.scored(), sketches=ws.sketches("anomaly_score"))


@question("median_score", build("scored", out("SELECT quantile_cont(anomaly_score, 0.5) AS median_score FROM scored WHERE attack_label = 0", "", "median_score")))
def median_score(ws: Workspace) -> DataFrame:
    return dt.median_score(ws.scored(), ws.sketches("anomaly_score"))


@question("classify_anomaly", build("threshold", keyed("SELECT * FROM classified", "is_anomaly", "anomaly_score")))
def classify_anomaly(ws: Workspace) -> DataFrame:
    return dt.classify_anomaly(ws.scored(), dt.score_threshold(ws.scored(), sketches=ws.sketches("anomaly_score"))).select(*KEY, "is_anomaly", "anomaly_score")


_CONFIDENCE = """SELECT *, least(1e0, abs(anomaly_score - threshold) / ((SELECT stddev_pop(anomaly_score) FROM scored) * 2)) AS confidence FROM classified"""


@question("detection_confidence", build("threshold", keyed(_CONFIDENCE, "", "confidence")))
def detection_confidence(ws: Workspace) -> DataFrame:
    return dt.detection_confidence(dt.classify_anomaly(ws.scored(), dt.score_threshold(ws.scored(), sketches=ws.sketches("anomaly_score")))).select(*KEY, "confidence")


@question("detect", build("threshold", keyed(_CONFIDENCE, "attack_type is_anomaly", "anomaly_score threshold confidence")))
def detect(ws: Workspace) -> DataFrame:
    return dt.detect(ws.scored()).select(*KEY, "attack_type", "is_anomaly", "anomaly_score", "threshold", "confidence")


# ---- health ----------------------------------------------------------------------------------------------------

_HEALTH = "cyber_health threat_component stability_component pressure_component"


@question("health_score", build("health", keyed("SELECT * FROM he", "risk_category attack_type", _HEALTH)))
def health_score(ws: Workspace) -> DataFrame:
    return ws.engine_health().select(*KEY, "risk_category", "attack_type", *_HEALTH.split())


@question("health_score_service", build("health", keyed("SELECT * FROM hs", "risk_category attack_type", _HEALTH)))
def health_score_service(ws: Workspace) -> DataFrame:
    return ws.service_health().select(*KEY, "risk_category", "attack_type", *_HEALTH.split())


@question("risk_category", build("health", keyed("SELECT * FROM hs", "risk_category", "")))
def risk_categories(ws: Workspace) -> DataFrame:
    return ws.service_health().select(*KEY, risk_category(F.col("cyber_health")).alias("risk_category"))


@question("filter_extreme", build("health", keyed("SELECT * FROM hs WHERE risk_category IN ('High Risk', 'Critical')", "attack_type risk_category", "cyber_health")))
def filter_extreme(ws: Workspace) -> DataFrame:
    return he.filter_extreme(ws.service_health()).select(*KEY, "attack_type", "risk_category", "cyber_health")


@question("health_summary", build("health", out(
    """SELECT count(cyber_health) AS n, avg(cyber_health) AS mean_health, quantile_cont(cyber_health, 0.5) AS median_health, stddev_samp(cyber_health) AS std_health,
        min(cyber_health) AS min_health, max(cyber_health) AS max_health, quantile_cont(cyber_health, 0.25) AS p25_health, quantile_cont(cyber_health, 0.75) AS p75_health FROM he""",
    "n", "mean_health median_health std_health min_health max_health p25_health p75_health")))
def health_summary(ws: Workspace) -> DataFrame:
    return he.health_summary(ws.engine_health(), ws.sketches("cyber_health"))


_DISTRIBUTION = f"""SELECT CAST(c.category_ord AS INTEGER) AS category_ord, c.risk_category, coalesce(n, 0) AS n, round_even(coalesce(n, 0) * 1e2 / sum(coalesce(n, 0)) OVER (), 1) AS pct
    FROM ({values([(c, i) for i, (c, _) in enumerate(fv.CATEGORIES)], 'risk_category, category_ord')}) c
    LEFT JOIN (SELECT risk_category, count(*) AS n FROM he GROUP BY ALL) USING (risk_category)"""


@question("category_distribution", build("health", out(_DISTRIBUTION, "category_ord risk_category n", "pct")))
def category_distribution(ws: Workspace) -> DataFrame:
    return he.category_distribution(ws.engine_health())


_BY_ATTACK = """SELECT attack_type, count(*) AS n, avg(cyber_health) AS mean_health, quantile_cont(cyber_health, 0.5) AS median_health,
    (SELECT risk_category FROM he i WHERE i.attack_type = o.attack_type GROUP BY risk_category ORDER BY count(*) DESC, risk_category LIMIT 1) AS modal_category FROM he o GROUP BY attack_type"""


@question("health_by_attack", build("health", out(_BY_ATTACK, "attack_type n modal_category", "mean_health median_health")))
def health_by_attack(ws: Workspace) -> DataFrame:
    return he.health_by_attack(ws.engine_health(), ws.sketches("cyber_health"))


_COUNTS = [(c, "n_" + c.lower().replace(" ", "_")) for c, _ in fv.CATEGORIES]


@question("health_overview", build("health", out(
    f"SELECT attack_type, count(*) AS n, avg(cyber_health) AS mean_health, {', '.join(f'''count(*) FILTER (risk_category = '{c}') AS {n}''' for c, n in _COUNTS)} FROM he GROUP BY ALL",
    "attack_type n " + " ".join(n for _, n in _COUNTS), "mean_health")))
def health_overview(ws: Workspace) -> DataFrame:
    """Which class hurts health most, and how many of its windows fall in each risk category."""
    return ws.engine_health().groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("risk_category") == c).alias(n) for c, n in _COUNTS],
        F.avg("cyber_health").alias("mean_health"),
    )


@question("attack_counts", build("health", out("SELECT attack_type, count(*) AS n, avg(cyber_health) AS mean_health FROM hs GROUP BY ALL", "attack_type n", "mean_health")))
def attack_counts(ws: Workspace) -> DataFrame:
    return he.attack_counts(ws.service_health())


@question("health_histogram", build("health", """SELECT CAST(g.bin AS INTEGER) AS bin, CAST(g.bin * 5 AS INTEGER) AS bin_from, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS bin) g
    LEFT JOIN (SELECT least(floor(cyber_health / 5), 19) AS bin, count(*) AS n FROM he GROUP BY ALL) USING (bin)"""))
def health_histogram(ws: Workspace) -> DataFrame:
    return he.health_histogram(ws.engine_health())


@question("kde_on_grid", build("health", out(
    """SELECT CAST(i AS INTEGER) AS i, i * 1e2 / 499 AS x, sum(exp(-pow((i * 1e2 / 499 - cyber_health) / bw, 2) / 2)) / (bw * sqrt(2 * pi())) * 5 AS density
    FROM he CROSS JOIN (SELECT stddev_samp(cyber_health) * pow(count(*), -2e-1) AS bw FROM he) CROSS JOIN (SELECT unnest(range(0, 500)) AS i) GROUP BY i, bw""",
    "i", "x density")))
def kde_on_grid(ws: Workspace) -> DataFrame:
    return he.kde_on_grid(ws.engine_health())


# ---- series ----------------------------------------------------------------------------------------------------

_LAST = f"""SELECT vehicle_id, capture, n, CASE WHEN n < 20 THEN 'Stable' ELSE {trend_of('d')} END AS trend, round_even(CASE WHEN n < 20 THEN 0e0 ELSE d END, 2) AS trend_diff FROM (
    SELECT vehicle_id, capture, max(hi) + 1 AS n, avg(CASE WHEN hi - w < 10 THEN cyber_health END) - avg(CASE WHEN hi - w BETWEEN 10 AND 19 THEN cyber_health END) AS d
    FROM (SELECT *, max(w) OVER (PARTITION BY vehicle_id, capture) AS hi FROM hs) GROUP BY ALL)"""


@question("trend_last", build("health", out(_LAST, "vehicle_id capture trend", "trend_diff").replace("SELECT vehicle_id, capture,", "SELECT vehicle_id, capture, CAST(n AS BIGINT) AS n,", 1)))
def trend_last(ws: Workspace) -> DataFrame:
    return se.trend_last(ws.service_health(), SERIES, "w", "cyber_health")


@question("trend_at_window", build("trended", keyed("SELECT * FROM trended", "window_index trend", "trend_diff")))
def trend_at_window(ws: Workspace) -> DataFrame:
    return ws.trended().select(*KEY, "window_index", "trend", "trend_diff")


@question("trend_label", build("trended", f"SELECT vehicle_id, window_index, {trend_of('step')} AS trend FROM (SELECT *, cyber_health - lag(cyber_health) OVER (PARTITION BY vehicle_id ORDER BY window_index) AS step FROM hs)"))
def trend_labels(ws: Workspace) -> DataFrame:
    """Label of the step from each window to the next one."""
    h = ws.service_health().select("vehicle_id", "window_index", "cyber_health")
    return se.step_trend(h, ["vehicle_id"], "window_index", "cyber_health").select("vehicle_id", "window_index", "trend")


@question("ema_level", build("regions", out("SELECT vehicle_id, capture, n, level, mean_value FROM levels_", "vehicle_id capture n", "level mean_value")))
def ema_level(ws: Workspace) -> DataFrame:
    return se.ema_level(ws.service_health(), SERIES, "w", "cyber_health")


@question("ema_series", build("health", keyed(
    """SELECT a.vehicle_id, a.capture, a.w, sum((CASE WHEN b.w = 0 THEN 1e0 ELSE 3e-1 END) * pow(7e-1, a.w - b.w) * b.cyber_health) AS ema
    FROM hs a JOIN hs b ON a.vehicle_id = b.vehicle_id AND a.capture = b.capture AND b.w <= a.w GROUP BY ALL""", "", "ema")))
def ema_series(ws: Workspace) -> DataFrame:
    return se.ema_series(ws.service_health(), SERIES, "w", "cyber_health").select(*KEY, "ema")


@question("ema_series_slow", build("health", keyed(
    """SELECT a.vehicle_id, a.capture, a.w, sum((CASE WHEN b.w = 0 THEN 1e0 ELSE 1e-3 END) * pow(999e-3, a.w - b.w) * b.cyber_health) AS ema
    FROM hs a JOIN hs b ON a.vehicle_id = b.vehicle_id AND a.capture = b.capture AND b.w <= a.w GROUP BY ALL""", "", "ema")))
def ema_series_slow(ws: Workspace) -> DataFrame:
    """Smoothing with a memory of thousands of windows, carried from block to block."""
    return se.ema_series(ws.service_health(), SERIES, "w", "cyber_health", alpha=0.001, block=8).select(*KEY, "ema")


@question("forecast", build("regions", out("SELECT vehicle_id, capture, CAST(step AS INTEGER) AS step, forecast FROM region_forecast", "vehicle_id capture step", "forecast")))
def forecast(ws: Workspace) -> DataFrame:
    return se.forecast(se.ema_level(ws.service_health(), SERIES, "w", "cyber_health"), SERIES, 20)


@question("forecast_mean", build("regions", out("SELECT vehicle_id, capture, projected_health FROM regions", "vehicle_id capture", "projected_health")))
def forecast_mean(ws: Workspace) -> DataFrame:
    return se.forecast_mean(forecast(ws), SERIES)


_SNAPSHOT = f"""g AS (SELECT *, max(window_index) OVER (PARTITION BY vehicle_id) AS hi FROM hs),
lv AS (SELECT vehicle_id, max(hi) + 1 AS n, avg(cyber_health) AS mean_value, sum((CASE WHEN window_index = 0 THEN 1e0 ELSE 3e-1 END) * pow(7e-1, hi - window_index) * cyber_health) AS level,
    avg(CASE WHEN hi - window_index < 10 THEN cyber_health END) - avg(CASE WHEN hi - window_index BETWEEN 10 AND 19 THEN cyber_health END) AS d FROM g GROUP BY ALL)"""


@question("current_health_snapshot", build("health", out(
    f"""SELECT g.vehicle_id, g.risk_category, g.cyber_health, g.threat_component, g.stability_component, g.pressure_component,
        CASE WHEN n < 20 THEN 'Stable' ELSE {trend_of('d')} END AS trend, round_even(CASE WHEN n < 20 THEN 0e0 ELSE d END, 2) AS trend_diff, CAST(s.step AS INTEGER) AS step,
        CASE WHEN n < 20 THEN g.cyber_health ELSE least(greatest(level * exp(-s.step / 1e1) + mean_value * (1 - exp(-s.step / 1e1)), 0e0), 1e2) END AS forecast
    FROM g JOIN lv USING (vehicle_id) CROSS JOIN (SELECT unnest(range(0, 10)) AS step) s WHERE g.window_index = g.hi""",
    "vehicle_id risk_category trend step", "cyber_health threat_component stability_component pressure_component trend_diff forecast"), _SNAPSHOT))
def current_health_snapshot(ws: Workspace) -> DataFrame:
    return se.current_health_snapshot(ws.service_health(), ["vehicle_id"], "window_index").drop("n")


@question("region_trends", build("regions", out(
    """SELECT r.vehicle_id, r.capture, r.n, r.trend, round_even(r.d, 2) AS trend_diff, r.projected_health, a.forecast AS forecast_start, b.forecast AS forecast_end, round_even(r.mean_value, 2) AS mean_health
    FROM regions r JOIN region_forecast a ON a.capture = r.capture AND a.step = 0 JOIN region_forecast b ON b.capture = r.capture AND b.step = 19""",
    "vehicle_id capture n trend", "trend_diff projected_health forecast_start forecast_end mean_health")))
def region_trends(ws: Workspace) -> DataFrame:
    return se.region_trends(ws.service_health(), SERIES, "w", "cyber_health")


_SIDES = """sided AS (SELECT *, CASE WHEN attack_type = 'Normal' THEN 'normal' ELSE 'attack' END AS side FROM hs),
pos AS (SELECT *, max(window_index) OVER (PARTITION BY vehicle_id, side) AS hi, count(*) OVER (PARTITION BY vehicle_id, side) AS n FROM sided),
tails AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, side ORDER BY window_index) AS r FROM pos WHERE hi - window_index < 200),
lv AS (SELECT vehicle_id, side, count(*) AS m, avg(cyber_health) AS mean_value, sum((CASE WHEN r = 1 THEN 1e0 ELSE 3e-1 END) * pow(7e-1, hi - window_index) * cyber_health) AS level FROM tails GROUP BY ALL),
df AS (SELECT vehicle_id, side, max(n) AS n, avg(cyber_health) AS mean_all, avg(CASE WHEN hi - window_index < 10 THEN cyber_health END) - avg(CASE WHEN hi - window_index BETWEEN 10 AND 19 THEN cyber_health END) AS d FROM pos GROUP BY ALL),
fc AS (SELECT vehicle_id, side, step, least(greatest(level * exp(-step / 20e0) + mean_value * (1 - exp(-step / 20e0)), 0e0), 1e2) AS forecast FROM lv CROSS JOIN (SELECT unnest(range(0, 20)) AS step))"""


@question("region_trends_two_sided", build("health", out(
    f"""SELECT d.vehicle_id, d.side, d.n, CASE WHEN n < 20 THEN 'Stable' ELSE {trend_of('d.d')} END AS trend, round_even(CASE WHEN n < 20 THEN 0e0 ELSE d.d END, 2) AS trend_diff,
        avg(f.forecast) AS projected_health, max(CASE WHEN step = 0 THEN f.forecast END) AS forecast_start, max(CASE WHEN step = 19 THEN f.forecast END) AS forecast_end, round_even(d.mean_all, 2) AS mean_health
    FROM df d JOIN fc f USING (vehicle_id, side) GROUP BY d.vehicle_id, d.side, d.n, d.d, d.mean_all""",
    "vehicle_id side n trend", "trend_diff projected_health forecast_start forecast_end mean_health"), _SIDES))
def region_trends_two_sided(ws: Workspace) -> DataFrame:
    """Normal windows against all attack windows, forecasting from the last 200 of each."""
    sided = ws.service_health().withColumn("side", F.when(F.col("attack_type") == "Normal", "normal").otherwise("attack"))
    return se.region_trends(sided, ["vehicle_id", "side"], "window_index", "cyber_health", tail=200)


_SPACED = """npos AS (SELECT count(*) AS n, least(count(*), 5000) AS m FROM he),
spaced AS (SELECT CAST(i AS BIGINT) AS position, h.window_index, h.cyber_health, p.m FROM npos p
    CROSS JOIN LATERAL (SELECT unnest(range(0, p.m)) AS i) g JOIN he h ON h.window_index = (g.i * (p.n - 1)) // greatest(p.m - 1, 1))"""


@question("timeline_downsample", build("health", out(
    """SELECT 'every_kth' AS method, window_index, window_index AS position, cyber_health FROM he WHERE window_index % greatest(1, (SELECT count(*) FROM he) // 200) = 0
    UNION ALL SELECT 'evenly_spaced', window_index, position, cyber_health FROM spaced""",
    "method window_index position", "cyber_health"), _SPACED))
def timeline_downsample(ws: Workspace) -> DataFrame:
    h = ws.engine_health().select("window_index", "cyber_health")
    kth = se.every_kth(h).withColumns({"position": F.col("window_index"), "method": F.lit("every_kth")})
    return kth.unionByName(se.evenly_spaced(h).withColumn("method", F.lit("evenly_spaced")))


@question("timeline_downsample_20", build("health", out(
    """SELECT 'every_kth' AS method, window_index, window_index AS position, cyber_health FROM he WHERE window_index % greatest(1, (SELECT count(*) FROM he) // 20) = 0
    UNION ALL SELECT 'evenly_spaced', window_index, position, cyber_health FROM spaced""",
    "method window_index position", "cyber_health"), _SPACED.replace("5000", "20")))
def timeline_downsample_20(ws: Workspace) -> DataFrame:
    """The same with 20 points, so that rows are left out on small tables as well."""
    h = ws.engine_health().select("window_index", "cyber_health")
    kth = se.every_kth(h, points=20).withColumns({"position": F.col("window_index"), "method": F.lit("every_kth")})
    return kth.unionByName(se.evenly_spaced(h, points=20).withColumn("method", F.lit("evenly_spaced")))


@question("rolling_mean_centered", build("health", out(
    """SELECT position, window_index, CASE WHEN count(*) OVER r = 100 THEN avg(cyber_health) OVER r END AS rolling_mean FROM spaced
    WINDOW r AS (ORDER BY position ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)""", "position window_index", "rolling_mean"), _SPACED))
def rolling_mean_centered(ws: Workspace) -> DataFrame:
    spaced = se.evenly_spaced(ws.engine_health().select("window_index", "cyber_health"))
    return se.rolling_mean_centered(spaced, [], "position", "cyber_health").select("position", "window_index", "rolling_mean")


@question("recovery_islands", build("health", """SELECT vehicle_id, CAST(min(window_index) AS BIGINT) AS run_start, CAST(max(window_index) AS BIGINT) AS run_end, count(*) AS run_length, CAST(min(window_index) + 2 AS BIGINT) AS resume_at FROM (
    SELECT *, window_index - row_number() OVER (PARTITION BY vehicle_id ORDER BY window_index) AS run FROM hs WHERE cyber_health > 60) GROUP BY vehicle_id, run HAVING count(*) >= 3"""))
def recovery_islands(ws: Workspace) -> DataFrame:
    return se.recovery_islands(ws.service_health(), ["vehicle_id"], "window_index", "cyber_health")


_CHOSEN = f"""chosen AS (
    SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, attack_type ORDER BY cyber_health, window_index) AS r FROM hs WHERE attack_type <> 'Normal') WHERE r = 1
    UNION ALL SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id, capture) AS n FROM hs WHERE attack_type = 'Normal') WHERE w = n // 2),
bda AS (
    SELECT vehicle_id, attack_type, health_before, health_during,
        CASE WHEN attack_type = 'Normal' THEN health_during ELSE round_even(health_before - (health_before - health_during) * 25e-2, 1) END AS health_after,
        CASE WHEN attack_type = 'Normal' THEN 0 ELSE CAST(trunc((health_before - health_during) * 15) AS INTEGER) END AS recovery_time_ms
    FROM (SELECT c.vehicle_id, c.attack_type, c.cyber_health AS health_during, n.cyber_health AS health_before
        FROM chosen c JOIN chosen n ON n.vehicle_id = c.vehicle_id AND n.attack_type = 'Normal'))"""
_BDA = out("SELECT * FROM bda", "vehicle_id attack_type recovery_time_ms", "health_before health_during health_after")


@question("health_before_during_after", build("health", _BDA, _CHOSEN))
def health_before_during_after(ws: Workspace) -> DataFrame:
    return fleet.health_before_during_after(ws.service_health())


@question("recovery_estimate", build("health", keyed(
    """SELECT vehicle_id, capture, w, attack_type, CASE WHEN attack_type = 'Normal' THEN cyber_health ELSE round_even(m - (m - cyber_health) * 25e-2, 1) END AS health_after,
        CASE WHEN attack_type = 'Normal' THEN 0 ELSE CAST(trunc((m - cyber_health) * 15) AS INTEGER) END AS recovery_time_ms
    FROM hs CROSS JOIN (SELECT avg(cyber_health) AS m FROM hs WHERE attack_label = 0)""", "attack_type recovery_time_ms", "health_after")))
def recovery_estimate(ws: Workspace) -> DataFrame:
    """Recovery of every window, measured from the mean normal health."""
    h = ws.service_health()
    mean = h.where("attack_label = 0").agg(F.avg("cyber_health").alias("health_before"))
    rows = attach(h.select(*KEY, "attack_type", F.col("cyber_health").alias("health_during")), mean)
    return fleet.recovery_estimate(rows).select(*KEY, "attack_type", "health_after", "recovery_time_ms")


# ---- quality of detection --------------------------------------------------------------------------------------

_CM = "SELECT count(*) FILTER (attack_label = 0 AND is_anomaly = 0) AS tn, count(*) FILTER (attack_label = 0 AND is_anomaly = 1) AS fp, count(*) FILTER (attack_label = 1 AND is_anomaly = 0) AS fn, count(*) FILTER (attack_label = 1 AND is_anomaly = 1) AS tp FROM {t}"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) * 1e0 / nullif({b}, 0), 0)"


METRICS = (
    f"SELECT {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, "
    f"{_ratio('fp', 'fp + tn')} AS fpr, {_ratio('tp', 'tp + fn')} AS detection_rate FROM ({_CM})"
)
_AUC = """SELECT sum(CASE WHEN p.anomaly_score < n.anomaly_score THEN 1e0 WHEN p.anomaly_score = n.anomaly_score THEN 5e-1 ELSE 0 END) / count(*) AS auc
    FROM scored p CROSS JOIN scored n WHERE p.attack_label = 1 AND n.attack_label = 0"""
_CURVE = """curve AS (
    SELECT anomaly_score AS threshold, pos, sum(neg) OVER o AS cneg, sum(pos) OVER o AS cpos, sum(neg) OVER () AS nneg, sum(pos) OVER () AS npos FROM (
        SELECT anomaly_score, count(*) FILTER (attack_label = 1) AS pos, count(*) FILTER (attack_label = 0) AS neg FROM scored GROUP BY ALL) WINDOW o AS (ORDER BY anomaly_score))"""


def classified(ws: Workspace) -> DataFrame:
    return dt.classify_anomaly(ws.scored(), dt.score_threshold(ws.scored(), sketches=ws.sketches("anomaly_score")))


@question("confusion_matrix", build("threshold", _CM.format(t="classified")))
def confusion_matrix(ws: Workspace) -> DataFrame:
    return ev.confusion_matrix(classified(ws))


@question("classification_metrics", build("threshold", out(METRICS.format(t="classified"), "", "precision recall f1 fpr detection_rate")))
def classification_metrics(ws: Workspace) -> DataFrame:
    return ev.classification_metrics(classified(ws))


@question("roc_auc", build("scored", out(_AUC, "", "auc")))
def roc_auc(ws: Workspace) -> DataFrame:
    return ev.roc_auc(ws.scored())


@question("average_precision", build("scored", out("SELECT sum(pos * 1e0 / npos * cpos / (cpos + cneg)) AS avg_precision FROM curve", "", "avg_precision"), _CURVE))
def average_precision(ws: Workspace) -> DataFrame:
    return ev.average_precision(ws.scored())


@question("roc_curve", build("scored", out("SELECT threshold, cneg * 1e0 / nneg AS fpr, cpos * 1e0 / npos AS tpr FROM curve", "", "threshold fpr tpr"), _CURVE))
def roc_curve(ws: Workspace) -> DataFrame:
    return ev.roc_curve(ws.scored())


@question("detection_rate_by_attack", build("threshold", out("SELECT attack_type, avg(is_anomaly) AS detection_rate, count(*) AS samples FROM classified GROUP BY ALL", "attack_type samples", "detection_rate")))
def detection_rate_by_attack(ws: Workspace) -> DataFrame:
    return ev.detection_rate_by_attack(classified(ws))


_DRAWN = """drawn AS MATERIALIZED (SELECT * FROM classified ORDER BY md5(concat_ws('|', vehicle_id, capture, CAST(CAST(w AS BIGINT) AS VARCHAR), '42')), vehicle_id, capture, w LIMIT 50000)"""


@question("metrics_sampled", build("threshold", out(
    f"SELECT * FROM ({METRICS.format(t='drawn')}) CROSS JOIN ({_AUC.replace('scored', 'drawn')})", "", "precision recall f1 fpr detection_rate auc"), _DRAWN))
def metrics_sampled(ws: Workspace) -> DataFrame:
    return ev.metrics_sampled(classified(ws))


@question("metrics_sampled_50", build("threshold", out(
    f"SELECT * FROM ({METRICS.format(t='drawn')}) CROSS JOIN ({_AUC.replace('scored', 'drawn')})", "", "precision recall f1 fpr detection_rate auc"), _DRAWN.replace("50000", "50")))
def metrics_sampled_50(ws: Workspace) -> DataFrame:
    """Metrics on a draw smaller than the table."""
    return ev.metrics_sampled(classified(ws), 50)


@question("score_histogram", build("scored", """SELECT attack_type, CAST(coalesce(least(floor((anomaly_score - lo) * 80 / nullif(hi - lo, 0)), 79), 0) AS INTEGER) AS bin, count(*) AS n
    FROM scored CROSS JOIN (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM scored) GROUP BY ALL"""))
def score_histogram(ws: Workspace) -> DataFrame:
    return ev.score_histogram(ws.scored())


# ---- status ----------------------------------------------------------------------------------------------------

@question("twin_status", build("scored", out(
    """SELECT vehicle_id, avg(messages_per_second) AS can_rate, avg(unique_can_ids_window) AS can_id_diversity, avg(can_id_entropy) AS entropy, avg(messages_per_second) AS message_frequency,
        avg(messages_per_second) AS baseline_frequency, avg(window_payload_entropy_mean) AS payload_entropy, avg(window_payload_entropy_mean) AS baseline_entropy,
        round_even(avg(window_delta_time_std), 4) AS signal_drift, round_even(100 - avg(payload_instability_score) * 10, 1) AS twin_integrity
    FROM (SELECT * FROM scored WHERE attack_label = 0 ORDER BY window_index LIMIT 100) GROUP BY ALL""",
    "vehicle_id", "can_rate can_id_diversity entropy message_frequency baseline_frequency payload_entropy baseline_entropy signal_drift twin_integrity")))
def twin_status(ws: Workspace) -> DataFrame:
    return fleet.twin_status(ws.windows())


@question("twin_status_5", build("scored", out(
    """SELECT vehicle_id, avg(messages_per_second) AS can_rate, avg(can_id_entropy) AS entropy, round_even(avg(window_delta_time_std), 4) AS signal_drift
    FROM (SELECT * FROM scored WHERE attack_label = 0 ORDER BY window_index LIMIT 5) GROUP BY ALL""", "vehicle_id", "can_rate entropy signal_drift")))
def twin_status_5(ws: Workspace) -> DataFrame:
    """The first five normal windows, fewer than there are."""
    return fleet.twin_status(ws.windows(), 5).select("vehicle_id", "can_rate", "entropy", "signal_drift")


@question("ecu_status", build("health", f"""SELECT ecu_id, ecu_name, CASE WHEN h >= 60 THEN 'secure' WHEN h >= 30 THEN 'warning' ELSE 'critical' END AS status,
    CAST(round_even(r * rate_frac, 0) AS BIGINT) AS packet_rate, CAST(round_even(rate_frac * 100 * 3e-1, 0) AS BIGINT) AS cpu_load
    FROM ({values(fv.ECUS, 'ecu_id, ecu_name, rate_frac')}) CROSS JOIN (SELECT avg(cyber_health) AS h, avg(messages_per_second) FILTER (attack_label = 0) AS r FROM hs)"""))
def ecu_status(ws: Workspace) -> DataFrame:
    return fleet.ecu_status(ws.service_health())


@question("telemetry_snapshot", build("windows", out(
    """SELECT round_even(avg(messages_per_second) FILTER (attack_label = 0), 1) AS can_rate, round_even(avg(message_burst_score * 100) FILTER (attack_label = 0), 1) AS burst_pct,
        round_even(avg(payload_instability_score * 100) FILTER (attack_label = 0), 1) AS instability_pct, CAST(count(*) // greatest(1, count(*) FILTER (attack_label = 0)) AS BIGINT) AS windows_per_normal_window FROM windows""",
    "windows_per_normal_window", "can_rate burst_pct instability_pct")))
def telemetry_snapshot(ws: Workspace) -> DataFrame:
    return fleet.telemetry_snapshot(ws.windows())


_FLEET = f"""m AS ({METRICS.format(t='classified')})"""


@question("fleet_stats", build("health", out(
    """SELECT total_windows, normal_health, can_rate, windows_per_normal_window, round_even(f1, 4) AS detector_f1 FROM (
        SELECT count(*) AS total_windows, round_even(avg(cyber_health) FILTER (attack_type = 'Normal'), 1) AS normal_health, round_even(avg(messages_per_second) FILTER (attack_label = 0), 1) AS can_rate,
            CAST(count(*) // greatest(1, count(*) FILTER (attack_label = 0)) AS BIGINT) AS windows_per_normal_window FROM hs) CROSS JOIN m""",
    "total_windows windows_per_normal_window", "normal_health can_rate detector_f1"), _FLEET))
def fleet_stats(ws: Workspace) -> DataFrame:
    return fleet.fleet_stats(ws.service_health(), ev.classification_metrics(classified(ws)))

