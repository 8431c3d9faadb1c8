"""Questions that explain windows and choose responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators import evaluate as ev, explain as ex, fleet, respond as re_, series as se
from busvitals.operators.ordering import attach
from busvitals.plans.health_questions import _CHOSEN, METRICS, KEY, SERIES, classified, keyed
from busvitals.plans.reference_sql import (
    CONFIDENCE, EXAMPLES, LEVEL, PLAYBOOK, build, fixed, out, told_examples, trend_of, values, z_of,
)
from busvitals.plans.registry import question
from busvitals.sources.scratch import fresh_path
from busvitals.plans.workspace import Workspace
from busvitals.sources.tables import append_decisions, read_decisions, read_stories, write_stories

_HEALTH = "cyber_health threat_component stability_component pressure_component"
GENERATED = "1970-01-01T00:00:00"


def explained(ws: Workspace) -> DataFrame:
    return ex.root_cause(ws.service_health(), ws.baseline(1))


def regions(ws: Workspace) -> DataFrame:
    return se.region_trends(ws.service_health(), SERIES, "w", "cyber_health")


def stories(ws: Workspace) -> DataFrame:
    """Every window told with its local trend and the projection of its class."""
    local = ex.root_cause(ws.trended(), ws.baseline(1))
    return ex.threat_story(local.join(regions(ws).select(*SERIES, "projected_health"), SERIES))


def example_stories(ws: Workspace) -> DataFrame:
    """The representative window of every class told with the trend and projection of the class."""
    chosen = ex.root_cause(ex.example_windows(ws.service_health()), ws.baseline(1))
    return ex.threat_story(chosen.join(regions(ws).select(*SERIES, "trend", "trend_diff", "projected_health"), SERIES))


def decisions(ws: Workspace) -> DataFrame:
    return re_.response_decision(stories(ws))


# ---- attribution -----------------------------------------------------------------------------------------------

_ATTRIBUTION = "attribution AS MATERIALIZED (SELECT *, CASE WHEN round(importance, 9) > 3e-1 THEN 1 ELSE 0 END AS is_anomalous FROM (" + " UNION ALL ".join(
    f"SELECT h.vehicle_id, h.capture, h.w, h.attack_type, '{c}' AS feature, {i} AS ord, round_even(h.{c}, 4) AS value, (round_even(h.{c}, 4) - b.m_{c}) / b.s_{c} AS z, "
    f"least(1e0, coalesce(abs((round_even(h.{c}, 4) - b.m_{c}) / b.s_{c}), 0) / 5) AS importance FROM hs h CROSS JOIN base_s b"
    for i, c in enumerate(fv.FEATURES)) + "))"
_DRIVER = f"""{_ATTRIBUTION},
drivers AS (
    SELECT vehicle_id, capture, w, attack_type, coalesce(arg_min(feature, (-importance, ord)) FILTER (is_anomalous = 1), '{fv.FEATURES[0]}') AS top_driver,
        coalesce(round_even(max(importance) FILTER (is_anomalous = 1), 4) * 100, 0) AS contribution_pct, sum(is_anomalous) AS anomalous_features
    FROM attribution GROUP BY ALL)""".replace("arg_min(feature, (-importance, ord)) FILTER (is_anomalous = 1)", "(list(feature ORDER BY round_even(importance, 4) DESC, ord) FILTER (is_anomalous = 1))[1]")


@question("zscore_attribution", build("health", keyed("SELECT * FROM attribution", "feature is_anomalous", "value z importance"), _ATTRIBUTION))
def zscore_attribution(ws: Workspace) -> DataFrame:
    return ex.zscore_attribution(ws.scored(), ws.baseline(1)).select(*KEY, "feature", "is_anomalous", "value", "z", "importance")


@question("top_driver", build("health", keyed("SELECT * FROM drivers", "attack_type top_driver", "contribution_pct").replace("SELECT vehicle_id", "SELECT CAST(anomalous_features AS BIGINT) AS anomalous_features, vehicle_id", 1), _DRIVER))
def top_driver(ws: Workspace) -> DataFrame:
    return ex.top_driver(ws.scored(), ws.baseline(1))


@question("feature_importance", build("health", out(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{cat}' AS category, (SELECT round_even(least(1e0, avg(abs({z_of(c)})) / 5), 4) FROM scored h CROSS JOIN base_s b WHERE attack_label = 1) AS importance"
        for c, cat in fv.FEATURE_CATEGORY), "feature category", "importance")))
def feature_importance(ws: Workspace) -> DataFrame:
    return ex.feature_importance(ws.scored(), ws.baseline(1))


@question("feature_separability", build("windows", out(
    " UNION ALL ".join(f"SELECT '{f}' AS feature, " + ", ".join(f"avg({f}) FILTER (attack_type = '{c}') AS {c}" for c in fv.CLASSES) + " FROM windows" for f in fv.FEATURES),
    "feature", " ".join(fv.CLASSES))))
def feature_separability(ws: Workspace) -> DataFrame:
    return ex.feature_separability(ws.windows())


_ROOT_TEXT = "primary_component secondary_component primary_feature primary_label primary_direction secondary_feature secondary_label feature_list n_unhealthy"
_ROOT_NUM = "threat_health stability_health pressure_health primary_z primary_healthiness secondary_z"


@question("root_cause", build("explained", keyed("SELECT * FROM explained", _ROOT_TEXT, _ROOT_NUM)))
def root_cause(ws: Workspace) -> DataFrame:
    first = F.array_join(F.transform(F.slice("unhealthy", 1, 5), lambda a: a["label"]), ", ")
    return explained(ws).withColumns(
        {"feature_list": F.when(F.size("unhealthy") > 0, first).otherwise("none"), "n_unhealthy": F.size("unhealthy").cast("bigint")}
    ).select(*KEY, *_ROOT_TEXT.split(), *_ROOT_NUM.split())


@question("rank_features", build("explained", keyed("SELECT *, CAST(r AS INTEGER) AS rank FROM ranked", "rank feature", "healthiness z_score")))
def rank_features(ws: Workspace) -> DataFrame:
    return ex.rank_features(explained(ws))


@question("simple_root_cause", build("health", keyed(
    "SELECT *, CASE WHEN threat_component < 20 THEN 'Threat' WHEN stability_component < 15 THEN 'Stability' ELSE 'Pressure' END AS simple_component FROM hs", "simple_component")))
def simple_root_cause(ws: Workspace) -> DataFrame:
    return ex.simple_root_cause(ws.service_health()).select(*KEY, "simple_component")


_COMPONENT = "CASE WHEN threat_component < 20 THEN 'Threat' WHEN stability_component < 15 THEN 'Stability' ELSE 'Pressure' END"
_RESPONSE = "CASE WHEN risk_category IN ('Secure', 'Stable') THEN 'Monitor' WHEN risk_category = 'Warning' THEN 'Investigate' ELSE 'Activate countermeasures' END"


@question("simple_response", build("health", keyed(f"SELECT *, {_RESPONSE} AS simple_response, greatest(0e0, cyber_health - 5) AS projected_health FROM hs", "simple_response", "projected_health")))
def simple_response(ws: Workspace) -> DataFrame:
    return ex.simple_response(ws.service_health()).select(*KEY, "simple_response", "projected_health")


# ---- choosing windows ------------------------------------------------------------------------------------------

def _pick_sql(order: str, by: str, where: str = "TRUE") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return keyed(f"SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY {order}) AS r FROM hs WHERE {where}) WHERE r = 1", "attack_type risk_category window_index", _HEALTH)


def _picked(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "attack_type", "risk_category", "window_index", *_HEALTH.split())


@question("worst_window", build("health", _pick_sql("cyber_health, window_index", "attack_type")))
def worst_window(ws: Workspace) -> DataFrame:
    return _picked(ex.worst_window(ws.service_health()))


@question("best_window", build("health", _pick_sql("cyber_health DESC, window_index", "")))
def best_window(ws: Workspace) -> DataFrame:
    return _picked(ex.best_window(ws.service_health()))


@question("head_per_category", build("health", _pick_sql("window_index", "risk_category")))
def head_per_category(ws: Workspace) -> DataFrame:
    return _picked(ex.head_per_category(ws.service_health()))


@question("middle_window", build("health", keyed(
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id, capture) AS n FROM hs) WHERE w = n // 2", "attack_type risk_category window_index", _HEALTH)))
def middle_window(ws: Workspace) -> DataFrame:
    return _picked(ex.middle_window(ws.service_health()))


@question("nearest_to_mean", build("health", keyed("SELECT h.* FROM hs h JOIN near_mean m USING (capture, w)", "attack_type risk_category window_index", _HEALTH), EXAMPLES))
def nearest_to_mean(ws: Workspace) -> DataFrame:
    return _picked(ex.nearest_to_mean(ws.service_health()))


@question("nearest_to_extreme_median", build("health", keyed("SELECT h.* FROM hs h JOIN near_median m USING (capture, w)", "attack_type risk_category window_index", _HEALTH), EXAMPLES))
def nearest_to_extreme_median(ws: Workspace) -> DataFrame:
    return _picked(ex.nearest_to_extreme_median(ws.service_health()))


# ---- wording ---------------------------------------------------------------------------------------------------

@question("template_join", build("health", f"SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, risk_category, summary_t, response_t FROM hs JOIN ({values(fv.TEMPLATES, 'category, summary_t, trend_t, root_t, forecast_t, response_t')}) ON category = risk_category"))
def template_join(ws: Workspace) -> DataFrame:
    return ex.template_join(ws.service_health()).select(*KEY, "risk_category", "summary_t", "response_t")


@question("attack_context_join", build("health", f"""SELECT vehicle_id, capture, CAST(w AS BIGINT) AS w, risk_category, context_type, attack_label_text, mechanism, signature, impact, mitigation
    FROM hs LEFT JOIN ({values(fv.ATTACKS, 'context_type, attack_label_text, mechanism, signature, impact, mitigation')}) ON attack_type = context_type AND risk_category NOT IN ('Secure', 'Stable')"""))
def attack_context_join(ws: Workspace) -> DataFrame:
    return ex.attack_context_join(ws.service_health()).select(
        *KEY, "risk_category", "context_type", "attack_label_text", "mechanism", "signature", "impact", "mitigation"
    )


_STORY = "risk_category trend threat_summary trend_text root_cause_text forecast_text recommended_response context_type narrative"


@question("threat_story", build("stories", keyed("SELECT * FROM stories", _STORY)))
def threat_story(ws: Workspace) -> DataFrame:
    return stories(ws).select(*KEY, *_STORY.split())


@question("stories_all_classes", told_examples(keyed("SELECT * FROM stories", "attack_type window_index " + _STORY, "cyber_health projected_health")))
def stories_all_classes(ws: Workspace) -> DataFrame:
    return example_stories(ws).select(*KEY, "attack_type", "window_index", *_STORY.split(), "cyber_health", "projected_health")


_ALERT = f"""CASE risk_category WHEN 'Secure' THEN 'Cyber Health: ' || h0 || '/100 — All clear.' WHEN 'Stable' THEN 'Cyber Health: ' || h0 || '/100 — Minor variations, monitoring.'
    WHEN 'Warning' THEN 'Cyber Health: ' || h0 || '/100 — Warning. ' || primary_component || ' anomaly detected. Investigate.'
    WHEN 'High Risk' THEN 'ALERT: Cyber Health ' || h0 || '/100 — High Risk. ' || primary_label || ' severely abnormal. Action required.'
    ELSE 'CRITICAL: Cyber Health ' || h0 || '/100 — Attack confirmed. Emergency response active.' END"""


@question("short_alert", build("explained", keyed(f"SELECT *, {_ALERT} AS short_alert FROM (SELECT *, {fixed('round_even(cyber_health, 2)', 0)} AS h0 FROM explained)", "short_alert")))
def short_alert(ws: Workspace) -> DataFrame:
    return ex.short_alert(explained(ws)).select(*KEY, "short_alert")


_SHORT = (
    f"'Cyber Health is ' || {fixed('cyber_health', 0)} || '/100 — ' || risk_category || '. Threat component: ' || {fixed('threat_component', 1)} || '/40, Stability: ' || "
    f"{fixed('stability_component', 1)} || '/30, Pressure: ' || {fixed('pressure_component', 1)} || '/30. Trend: ' || {trend_of('trend_diff')} || '. Attack type: ' || attack_type || '.'"
)


@question("narrative_short", build("trended", keyed(f"SELECT *, {_SHORT} AS narrative_short FROM trended", "narrative_short")))
def narrative_short(ws: Workspace) -> DataFrame:
    return ex.narrative_short(ws.trended()).select(*KEY, "narrative_short")


ASKED = [("normal",), ("dos",), ("fuzzy",), ("gear",), ("RPM",), ("masquerade",), (None,)]
_ASKED = "(VALUES " + ", ".join("(NULL)" if a is None else f"('{a}')" for (a,) in ASKED) + ") asked_for(asked)"
_TOLD = ("attack_type risk_category narrative_short simple_component simple_response window_index", "health_score projected_health threat_component stability_component pressure_component")


@question("class_stories", build("trended", out(f"""SELECT a.vehicle_id, a.asked, t.attack_type, t.risk_category, {_SHORT} AS narrative_short, {_COMPONENT} AS simple_component, {_RESPONSE} AS simple_response,
        t.window_index, cyber_health AS health_score, greatest(0e0, cyber_health - 5) AS projected_health, threat_component, stability_component, pressure_component
    FROM (SELECT v.vehicle_id, asked, CASE WHEN asked IS NULL OR lower(asked) = 'normal' THEN best ELSE coalesce(worst, worst_of_all) END AS window_index
        FROM (SELECT vehicle_id, arg_min(window_index, (-cyber_health, window_index)) AS best, arg_min(window_index, (cyber_health, window_index)) AS worst_of_all FROM trended GROUP BY ALL) v CROSS JOIN {_ASKED}
        LEFT JOIN (SELECT vehicle_id, lower(attack_type) AS asked_class, arg_min(window_index, (cyber_health, window_index)) AS worst FROM trended GROUP BY ALL) c
        ON c.vehicle_id = v.vehicle_id AND c.asked_class = lower(asked)) a
    JOIN trended t USING (vehicle_id, window_index)""", "vehicle_id asked " + _TOLD[0], _TOLD[1])))
def class_stories(ws: Workspace) -> DataFrame:
    """What the service tells when asked for a class, known or not."""
    asked = ws.spark.createDataFrame(ASKED, "asked string")
    return ex.class_stories(ws.trended(), asked).select("vehicle_id", "asked", *_TOLD[0].split(), *_TOLD[1].split())


_ROUTING = values(fv.CATEGORY_ROUTING, "risk_category, audience, channel, urgency")
_AUDIENCE = values([(f, a) for f, _, a, _, _ in fv.TRACKED], "primary_feature, feature_audience")


@question("audience_routing", build("explained", keyed(f"SELECT * FROM explained JOIN ({_ROUTING}) USING (risk_category) JOIN ({_AUDIENCE}) USING (primary_feature)", "risk_category audience channel urgency primary_feature feature_audience")))
def audience_routing(ws: Workspace) -> DataFrame:
    from busvitals.functions.dimensions import tracked_features

    by_feature = tracked_features(ws.spark).select(F.col("feature").alias("primary_feature"), F.col("audience").alias("feature_audience"))
    routed = ex.audience_routing(explained(ws).select(*KEY, "risk_category", "primary_feature"))
    return routed.join(F.broadcast(by_feature), "primary_feature", "left")


_JSON = "scenario risk_category trend_label primary_component primary_feature attack_type narrative"


@question("stories_json", told_examples(out(
    """SELECT vehicle_id, lower(attack_type) AS scenario, CAST(window_index AS BIGINT) AS window_index, risk_category, round_even(cyber_health, 2) AS health_score, trend AS trend_label,
        primary_component, primary_feature, round_even(projected_health, 2) AS projected_health, round_even(stability_health, 4) AS stability_health, primary_z, context_type AS attack_type, narrative FROM stories""",
    "vehicle_id window_index " + _JSON, "health_score projected_health stability_health primary_z")))
def stories_json(ws: Workspace) -> DataFrame:
    """Stories written as JSON documents and read back with the declared schema."""
    path = fresh_path(ws.spark, "stories")
    write_stories(ex.story_struct(example_stories(ws), GENERATED), path)
    s = read_stories(ws.spark, path, ex.STORY_SCHEMA)
    return s.select(
        "vehicle_id", F.col("story.metadata.window_index").alias("window_index"), "scenario",
        F.col("story.risk_category").alias("risk_category"), F.col("story.trend.label").alias("trend_label"),
        F.col("story.root_cause_analysis.primary_component").alias("primary_component"),
        F.col("story.root_cause_analysis.primary_feature.name").alias("primary_feature"),
        F.col("story.attack_context.attack_type").alias("attack_type"), F.col("story.narrative").alias("narrative"),
        F.col("story.health_score").alias("health_score"),
        F.col("story.future_risk_forecast.projected_health").alias("projected_health"),
        F.col("story.root_cause_analysis.component_breakdown")["Stability"].alias("stability_health"),
        F.col("story.root_cause_analysis.feature_attributions")[
            F.col("story.root_cause_analysis.primary_feature.name")
        ]["z_score"].alias("primary_z"),
    )


# ---- responses -------------------------------------------------------------------------------------------------

@question("level_from_risk", build("trended", keyed(f"SELECT *, CAST({LEVEL.format(t='trend')} AS INTEGER) AS response_level FROM trended", "risk_category trend response_level")))
def level_from_risk(ws: Workspace) -> DataFrame:
    return ws.trended().select(*KEY, "risk_category", "trend", re_.level_from_risk(F.col("risk_category"), F.col("trend")).alias("response_level"))


_LEVEL_TEXTS = values([(level[0], text) for level, text in zip(fv.LEVELS, fv.LEVEL_DESCRIPTIONS)], "response_level, description")


@question("level_from_mean_health", build("health", out(f"""SELECT CAST(l.response_level AS INTEGER) AS response_level, l.level_label, d.description, m AS mean_health,
    CAST(l.response_level = c.response_level AS INTEGER) AS active, CAST(c.response_level AS INTEGER) AS current_level, c.level_label AS current_label
    FROM levels_dim l JOIN ({_LEVEL_TEXTS}) d USING (response_level) CROSS JOIN (SELECT avg(cyber_health) AS m FROM hs)
    JOIN levels_dim c ON c.response_level = CASE WHEN m >= 80 THEN 0 WHEN m >= 60 THEN 1 WHEN m >= 40 THEN 2 WHEN m >= 20 THEN 3 ELSE 4 END""",
    "response_level level_label description active current_level current_label", "mean_health"), PLAYBOOK))
def level_from_mean_health(ws: Workspace) -> DataFrame:
    return re_.defense_levels(ws.service_health())


@question("level_from_attack", build("windows", "SELECT attack_type, CAST(CASE WHEN lower(attack_type) IN ('dos', 'fuzzy') THEN 3 ELSE 2 END AS INTEGER) AS response_level, count(*) AS n FROM windows GROUP BY ALL"))
def level_from_attack(ws: Workspace) -> DataFrame:
    return ws.windows().groupBy("attack_type", re_.level_from_attack(F.col("attack_type")).alias("response_level")).agg(F.count(F.lit(1)).alias("n"))


@question("response_confidence", build("explained", keyed(f"SELECT *, {CONFIDENCE.format(h='cyber_health')} AS confidence FROM explained", "risk_category", "confidence")))
def response_confidence(ws: Workspace) -> DataFrame:
    return explained(ws).select(*KEY, "risk_category", re_.response_confidence(F.col("risk_category"), F.col("cyber_health"), F.col("attributions")).alias("confidence"))


@question("playbook_join", build("windows", """SELECT a.attack_type, CAST(l.response_level AS INTEGER) AS response_level, CAST(row_number() OVER (PARTITION BY a.attack_type, l.response_level
        ORDER BY CASE WHEN p.action_level = l.response_level THEN -1 ELSE p.action_level END, p.ord) AS INTEGER) AS position, p.id, p.name, p.target, CAST(p.execution_time_ms AS INTEGER) AS execution_time_ms, p.automated, p.reversible, p.side_effects, a.n
    FROM (SELECT attack_type, count(*) AS n FROM windows GROUP BY ALL) a JOIN playbook p ON p.pb_type = a.attack_type JOIN levels_dim l ON p.action_level <= l.response_level""", PLAYBOOK))
def playbook_join(ws: Workspace) -> DataFrame:
    """Ordered actions of every level for the attacks seen, with the number of windows each would act on."""
    seen = ws.windows().groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    joined = seen.join(F.broadcast(re_.playbook_actions(ws.spark)), F.col("attack_type") == F.col("playbook_type"))
    return joined.select("attack_type", F.col("playbook_level").alias("response_level"), "n", F.posexplode("actions").alias("_p", "a")).select(
        "attack_type", "response_level", "n", (F.col("_p") + 1).alias("position"), "a.id", "a.name", "a.target", "a.execution_time_ms",
        "a.automated", "a.reversible", "a.side_effects",
    )


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"action_ids": F.array_join(F.transform("actions", lambda a: a["id"]), ","), "n_actions": F.size("actions")})


@question("select_actions", build("decisions", keyed("SELECT * FROM decisions", "attack_type response_level action_ids n_actions")))
def select_actions(ws: Workspace) -> DataFrame:
    return _ids(decisions(ws)).select(*KEY, "attack_type", "response_level", "action_ids", "n_actions")


@question("outcome_recovery_safety", build("decisions", keyed("SELECT * FROM decisions", "attack_type response_level expected_outcome recovery_strategy safety_notes")))
def outcome_recovery_safety(ws: Workspace) -> DataFrame:
    return decisions(ws).select(*KEY, "attack_type", "response_level", "expected_outcome", "recovery_strategy", "safety_notes")


_DECISION = "risk_category trend_label attack_type response_level level_label action_ids n_actions expected_outcome recovery_strategy safety_notes"


@question("response_decision", build("decisions", keyed("SELECT * FROM decisions", "window_index " + _DECISION, "health_score confidence")))
def response_decision(ws: Workspace) -> DataFrame:
    return _ids(decisions(ws)).select(*KEY, "window_index", *_DECISION.split(), "health_score", "confidence")


@question("decision_history", build("decisions", keyed("SELECT *, DATE '1970-01-02' AS d FROM decisions UNION ALL SELECT *, DATE '1970-01-01' FROM decisions", _DECISION, "health_score confidence").replace("SELECT vehicle_id", "SELECT CAST(d AS VARCHAR) AS run_date, vehicle_id", 1)))
def decision_history(ws: Workspace) -> DataFrame:
    """The same decisions appended by two runs, read back from the audit log."""
    path = fresh_path(ws.spark, "decisions")
    made = decisions(ws)
    for day in ("1970-01-01", "1970-01-02"):
        append_decisions(made, path, day)
    return _ids(read_decisions(ws.spark, path, made.schema)).select("run_date", *KEY, *_DECISION.split(), "health_score", "confidence")


@question("decision_summary", build("decisions", out(
    """SELECT CAST(l.response_level AS INTEGER) AS response_level, l.level_label, coalesce(c.n, 0) AS n, t.* FROM levels_dim l LEFT JOIN (SELECT response_level, count(*) AS n FROM decisions GROUP BY ALL) c USING (response_level)
    CROSS JOIN (SELECT count(*) AS total_decisions, avg(confidence) AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
        string_agg(DISTINCT coalesce(attack_type, 'None'), ',' ORDER BY coalesce(attack_type, 'None')) AS attack_types FROM decisions) t""",
    "response_level level_label n total_decisions attack_types", "mean_confidence min_confidence max_confidence")))
def decision_summary(ws: Workspace) -> DataFrame:
    return re_.decision_summary(decisions(ws))


@question("ecu_target", build("windows", f"SELECT w.attack_type, t.ecu_id, t.ecu_name, count(*) AS n FROM windows w LEFT JOIN ({values(fv.TARGETS, 'attack_type, ecu_id, ecu_name')}) t USING (attack_type) GROUP BY ALL"))
def ecu_target(ws: Workspace) -> DataFrame:
    return fleet.ecu_target(ws.windows().groupBy("attack_type").agg(F.count(F.lit(1)).alias("n")))


_SUMMARY = f"""{_CHOSEN},
{_DRIVER},
sc AS (SELECT c.*, CASE WHEN c.attack_type = 'Normal' THEN (SELECT quantile_cont(anomaly_score, 0.5) FROM scored WHERE attack_label = 0) ELSE c.anomaly_score END AS score,
    (SELECT threshold FROM threshold) AS threshold, (SELECT stddev_pop(anomaly_score) FROM scored) AS spread FROM chosen c)"""


_RUN_LEVEL = LEVEL.format(t="t.trend").replace("risk_category", "s.risk_category")


@question("attack_run_summary", build("trended", out(
    f"""SELECT s.vehicle_id, s.attack_type, CASE WHEN score < threshold THEN 'anomaly' ELSE 'normal' END AS detection_status, round_even(least(1e0, abs(score - threshold) / (spread * 2)), 4) AS confidence,
        round_even(score, 4) AS anomaly_score, e.ecu_id AS affected_ecu, e.ecu_name AS affected_ecu_name, round_even(b.health_before, 1) AS health_before, round_even(b.health_during, 1) AS health_during,
        round_even(b.health_after, 1) AS health_after, b.recovery_time_ms, CASE WHEN s.attack_type = 'Normal' THEN 'Secure' ELSE 'Restored' END AS final_vehicle_state,
        (SELECT count(*) FROM hs) AS total_windows, (SELECT count(*) FROM hs x WHERE x.attack_type = s.attack_type) AS windows_analyzed, CAST(d.anomalous_features AS BIGINT) AS anomalous_features,
        d.top_driver AS top_anomaly_driver, CAST({_RUN_LEVEL} AS INTEGER) AS defense_level, v.level_label AS defense_label
    FROM sc s JOIN bda b USING (vehicle_id, attack_type) JOIN trended t ON t.capture = s.capture AND t.w = s.w JOIN drivers d ON d.capture = s.capture AND d.w = s.w
    JOIN ({values(fv.TARGETS, 'attack_type, ecu_id, ecu_name')}) e ON e.attack_type = s.attack_type JOIN ({values([x[:2] for x in fv.LEVELS], 'response_level, level_label')}) v ON v.response_level = {_RUN_LEVEL}""",
    "vehicle_id attack_type detection_status affected_ecu affected_ecu_name recovery_time_ms final_vehicle_state total_windows windows_analyzed anomalous_features top_anomaly_driver defense_level defense_label",
    "confidence anomaly_score health_before health_during health_after"), _SUMMARY))
def attack_run_summary(ws: Workspace) -> DataFrame:
    """Detection to recovery in one row per class."""
    return fleet.run_summary(ws.service_health(), classified(ws), ws.baseline(1), ws.trended())


# ---- comparing detectors ---------------------------------------------------------------------------------------

@question("improvement_ratio", build("health", out(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, o.{m} AS old_value, n.{m} AS new_value, n.{m} / nullif(o.{m}, 0) - 1 AS improvement FROM om o CROSS JOIN nm n" for m in ("precision", "recall", "f1")),
    "metric", "old_value new_value improvement"),
    f"""old_classified AS (SELECT h.attack_label, CASE WHEN {z_of('messages_per_second')} > 2 THEN 1 ELSE 0 END AS is_anomaly FROM scored h CROSS JOIN base_e b),
om AS ({METRICS.format(t='old_classified')}), nm AS ({METRICS.format(t='classified')})"""))
def improvement_ratio(ws: Workspace) -> DataFrame:
    """The detector against a rule on the frame rate alone (two sigma above normal)."""
    z = (F.col("messages_per_second") - F.col("m_messages_per_second")) / F.col("s_messages_per_second")
    rule = attach(ws.scored(), ws.baseline(0)).withColumn("is_anomaly", F.when(z > 2, 1).otherwise(0))
    return ev.improvement_ratio(ev.classification_metrics(rule), ev.classification_metrics(classified(ws)))
