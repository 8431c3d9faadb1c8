"""Plain SQL for the same questions, written independently of the operators, to check them against another engine."""

from __future__ import annotations

from busvitals.functions import fixed_values as fv

EDGE_SHIFT = 3.7e-08
ALL = [*fv.FEATURES, "anomaly_score"]
FEATURE_LIST = ", ".join(fv.FEATURES)


def quote(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return f"CAST({value} AS INTEGER)"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list, columns: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def health_of(z: str, direction: str) -> str:
    excess = {"both": f"abs({z})", "positive": f"({z})", "negative": f"(-({z}))"}[direction]
    return f"exp(-greatest(0e0, {excess} - 2e-1) / 15e-1)"


def z_of(column: str, table: str = "b") -> str:
    return f"((h.{column} - {table}.m_{column}) / {table}.s_{column})"


def trend_of(diff: str) -> str:
    return (
        f"CASE WHEN {diff} IS NULL THEN 'Stable' WHEN {diff} > 2e0 THEN 'Improving' "
        f"WHEN {diff} < -2e0 THEN 'Degrading' ELSE 'Stable' END"
    )


def fixed(value: str, digits: int, sign: bool = False) -> str:
    return f"printf('%{'+' if sign else ''}.{digits}f', round_even({value}, {digits}))"


_BYTES = ", ".join(f"CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), {2 * i + 1}, 2) AS INTEGER)" for i in range(8))
_CLASS = (
    "CASE event_type WHEN 'click' THEN 'Normal' WHEN 'purchase' THEN 'DoS' WHEN 'signup' THEN 'Fuzzy' "
    "WHEN 'view' THEN 'Gear' WHEN 'error' THEN 'RPM' END"
)
CLASS_ORD = "CASE attack_type WHEN 'Normal' THEN 0 WHEN 'DoS' THEN 1 WHEN 'Fuzzy' THEN 2 WHEN 'Gear' THEN 3 WHEN 'RPM' THEN 4 END"


def _risk(health: str) -> str:
    return (
        f"CASE WHEN {health} >= 80 THEN 'Secure' WHEN {health} >= 60 THEN 'Stable' WHEN {health} >= 40 THEN 'Warning' "
        f"WHEN {health} >= 20 THEN 'High Risk' ELSE 'Critical' END"
    )


def windows_cte(size: int, name: str = "windows", tail: str = "count(*) = {size}") -> str:
    """CTEs for windows of ``size`` frames, under ``name``."""
    having = tail.format(size=size)
    return f"""
{name}_f AS (SELECT *, CAST(floor(rn / {size}) AS BIGINT) AS w FROM numbered),
{name}_e AS (SELECT vehicle_id, capture, floor(rn / {size}) AS w, min(t_us) AS t0, max(t_us) AS t1 FROM numbered GROUP BY ALL),
{name}_id AS (
    SELECT vehicle_id, capture, w, count(*) AS u, -sum(p * log2(p)) AS ent FROM (
        SELECT vehicle_id, capture, w, can_id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY vehicle_id, capture, w) AS p
        FROM {name}_f GROUP BY vehicle_id, capture, w, can_id) GROUP BY ALL),
{name}_b AS (
    SELECT vehicle_id, capture, w, max(c) AS fullest FROM (
        SELECT f.vehicle_id, f.capture, f.w, coalesce(least(floor(CAST((f.t_us - e.t0) * 10 AS DOUBLE) / nullif(e.t1 - e.t0, 0)), 9), 0) AS s, count(*) AS c
        FROM {name}_f f JOIN {name}_e e USING (vehicle_id, capture, w) GROUP BY ALL) GROUP BY ALL),
{name}_p AS (
    SELECT vehicle_id, capture, w, avg(b) AS pm, stddev_samp(b) AS ps
    FROM (SELECT vehicle_id, capture, w, unnest(payload) AS b FROM {name}_f) GROUP BY ALL),
{name}_a AS (
    SELECT vehicle_id, capture, w, min(attack_type) AS attack_type, min(attack_label) AS attack_label, avg(flag) AS flagged,
        count(*) AS n_frames, count(*) * 1e6 / nullif(max(t_us) - min(t_us), 0) AS messages_per_second,
        avg(delta_time) AS dm, stddev_samp(delta_time) AS ds, min(delta_time) AS dmin, max(delta_time) AS dmax, avg(payload_entropy) AS pe
    FROM {name}_f GROUP BY vehicle_id, capture, w HAVING {having}),
{name} AS MATERIALIZED (
    SELECT a.vehicle_id, a.capture, a.w, a.messages_per_second, CAST(i.u AS DOUBLE) AS unique_can_ids_window, i.ent AS can_id_entropy,
        a.dm AS window_delta_time_mean, a.ds AS window_delta_time_std, a.dmin AS window_delta_time_min, a.dmax AS window_delta_time_max,
        p.pm AS window_payload_mean, p.ps AS window_payload_std, a.pe AS window_payload_entropy_mean,
        CAST(b.fullest AS DOUBLE) / a.n_frames AS message_burst_score, a.dmax / a.dm AS frequency_spike_score,
        p.ps / 127.5e0 AS payload_instability_score, a.attack_label, a.attack_type, a.n_frames, a.flagged
    FROM {name}_a a JOIN {name}_id i USING (vehicle_id, capture, w) JOIN {name}_b b USING (vehicle_id, capture, w)
        LEFT JOIN {name}_p p USING (vehicle_id, capture, w))"""


def _health_cte(name: str, base: str, digits: int | None) -> str:
    stab = " + ".join(health_of(z_of(c), "both") for c in fv.STABILITY_FEATURES)
    pres = " + ".join(health_of(z_of(c), "positive") for c in fv.PRESSURE_FEATURES)
    cut = (lambda c: f"round_even({c}, {digits})") if digits is not None else (lambda c: c)
    return f"""
{name} AS MATERIALIZED (
    SELECT * EXCLUDE (tc, sc, pc, total), {_risk('total')} AS risk_category, {cut('total')} AS cyber_health,
        {cut('tc')} AS threat_component, {cut('sc')} AS stability_component, {cut('pc')} AS pressure_component
    FROM (SELECT *, least(greatest(tc + sc + pc, 0e0), 100e0) AS total FROM (
        SELECT h.*, {health_of(z_of('anomaly_score'), 'negative')} * 40 AS tc, ({stab}) / 3 * 30 AS sc, ({pres}) / 3 * 30 AS pc
        FROM scored h CROSS JOIN {base} b)))"""


def _base_cte(name: str, ddof: int) -> str:
    parts = []
    for c in ALL:
        std = f"greatest(stddev_pop({c}), 1e-10)" if ddof == 0 else (
            f"stddev_pop({c})" if c == "anomaly_score" else f"stddev_samp({c})")
        parts.append(f"avg({c}) AS m_{c}, {std} AS s_{c}")
    return f"{name} AS MATERIALIZED (SELECT {', '.join(parts)} FROM scored WHERE attack_label = 0)"


def _tracked_long() -> str:
    """One row per window and tracked feature with published roundings."""
    within = {f: i for group in (fv.STABILITY_FEATURES, fv.PRESSURE_FEATURES) for i, f in enumerate(group)}
    parts = []
    for i, (feature, label, _, component, direction) in enumerate(fv.TRACKED):
        z = z_of(feature)
        parts.append(
            f"SELECT h.vehicle_id, h.capture, h.w, {i} AS ord, {within.get(feature, 0)} AS member, '{feature}' AS feature, "
            f"'{label}' AS label, '{component}' AS component, h.{feature} AS value, round_even({z}, 3) AS z_score, "
            f"round_even({health_of(z, direction)}, 4) AS healthiness, CASE WHEN {z} > 5e-1 THEN 'above normal' "
            f"WHEN {z} < -5e-1 THEN 'below normal' ELSE 'within normal range' END AS direction FROM hs h CROSS JOIN base_s b"
        )
    return "tracked AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


_SCALED = ", ".join(f"(h.{c} - b.m_{c}) / CASE WHEN b.s_{c} = 0 THEN 1 ELSE b.s_{c} END AS {c}" for c in fv.FEATURES)
_SCALE = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fv.FEATURES)
_DIST = " + ".join(f"(x.{c} - s.{c}) * (x.{c} - s.{c})" for c in fv.FEATURES)

# Building blocks in dependency order; a query names the last block it needs and gets all before it.
BLOCKS: dict[str, str] = {
    "frames": f"""frames AS MATERIALIZED (
    SELECT 'v0' AS vehicle_id, capture, capture AS attack_type, CASE WHEN capture = 'Normal' THEN 0 ELSE 1 END AS attack_label,
        epoch_us(ts) AS t_us, event_id AS seq, flag, dlc,
        CAST(CASE WHEN flag = 0 THEN user_id % 16 WHEN capture = 'DoS' THEN 0 WHEN capture = 'Fuzzy' THEN event_id * 7919 % 2048
            WHEN capture = 'Gear' THEN 1087 ELSE 790 END AS INTEGER) AS can_id,
        (CASE WHEN flag = 0 OR capture = 'Fuzzy' THEN [{_BYTES}] WHEN capture = 'DoS' THEN [0, 0, 0, 0, 0, 0, 0, 0]
            WHEN capture = 'Gear' THEN [0, 16, 32, 48, 64, 80, 96, 112] ELSE [8, 24, 40, 56, 72, 88, 104, 120] END)[1:dlc] AS payload
    FROM (SELECT *, CASE WHEN capture <> 'Normal' AND value >= 35 THEN 1 ELSE 0 END AS flag
        FROM (SELECT *, {_CLASS} AS capture, CAST(event_id % 9 AS INTEGER) AS dlc FROM events)))""",
    "entropies": """bytes AS (SELECT seq, b, count(*) AS c FROM (SELECT seq, unnest(payload) AS b FROM frames) GROUP BY ALL),
entropies AS (
    SELECT seq, -sum(p * log2(p)) AS e FROM (SELECT seq, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY seq) AS p FROM bytes) GROUP BY ALL)""",
    "numbered": """numbered AS MATERIALIZED (
    SELECT f.*, coalesce(e.e, 0e0) + 0e0 AS payload_entropy,
        row_number() OVER (PARTITION BY vehicle_id, capture ORDER BY t_us, f.seq) - 1 AS rn,
        (t_us - lag(t_us) OVER (PARTITION BY vehicle_id, capture ORDER BY t_us, f.seq)) / 1e6 AS delta_time
    FROM frames f LEFT JOIN entropies e ON f.seq = e.seq)""",
    "windows": windows_cte(50).lstrip(),
    "support": f"""scale AS MATERIALIZED (SELECT {_SCALE} FROM windows WHERE attack_label = 0),
scaled AS MATERIALIZED (SELECT h.vehicle_id, h.capture, h.w, h.attack_label, {_SCALED} FROM windows h CROSS JOIN scale b),
support AS MATERIALIZED (
    SELECT * FROM scaled WHERE attack_label = 0
    ORDER BY md5(concat_ws('|', vehicle_id, capture, CAST(w AS VARCHAR), '42')), vehicle_id, capture, w LIMIT 5000)""",
    "scored": f"""kernel AS MATERIALIZED (
    SELECT x.vehicle_id, x.capture, x.w, avg(exp(-({_DIST}) / 13e0)) AS k FROM scaled x CROSS JOIN support s GROUP BY ALL),
offset_ AS (SELECT quantile_cont(k, 0.05) AS rho FROM kernel JOIN windows USING (vehicle_id, capture, w) WHERE attack_label = 0),
scored AS MATERIALIZED (
    SELECT w.*, k.k - o.rho AS anomaly_score, row_number() OVER (PARTITION BY w.vehicle_id ORDER BY {CLASS_ORD}, w.w) - 1 AS window_index
    FROM windows w JOIN kernel k USING (vehicle_id, capture, w) CROSS JOIN offset_ o)""",
    "threshold": """threshold AS MATERIALIZED (SELECT quantile_cont(anomaly_score, 0.05) AS threshold FROM scored WHERE attack_label = 0),
classified AS MATERIALIZED (SELECT s.*, t.threshold, CASE WHEN s.anomaly_score < t.threshold THEN 1 ELSE 0 END AS is_anomaly
    FROM scored s CROSS JOIN threshold t)""",
    "health": _base_cte("base_e", 0) + ",\n" + _base_cte("base_s", 1) + "," + _health_cte("he", "base_e", 2) + ","
    + _health_cte("hs", "base_s", None),
    "trended": f"""local_diff AS (
    SELECT *, CASE WHEN count(*) OVER (PARTITION BY vehicle_id) < 20 THEN 0e0
        ELSE avg(cyber_health) OVER (PARTITION BY vehicle_id ORDER BY window_index ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)
        - avg(cyber_health) OVER (PARTITION BY vehicle_id ORDER BY window_index ROWS BETWEEN 20 PRECEDING AND 11 PRECEDING) END AS trend_diff FROM hs),
trended AS MATERIALIZED (SELECT *, {trend_of('trend_diff')} AS trend FROM local_diff)""",
    "regions": f"""ends AS (SELECT vehicle_id, capture, max(w) AS hi FROM hs GROUP BY ALL),
levels_ AS (
    SELECT h.vehicle_id, h.capture, min(h.attack_type) AS attack_type, count(*) AS n, avg(h.cyber_health) AS mean_value,
        sum((CASE WHEN h.w = 0 THEN 1e0 ELSE 3e-1 END) * pow(7e-1, e.hi - h.w) * h.cyber_health) AS level,
        avg(CASE WHEN e.hi - h.w < 10 THEN h.cyber_health END) - avg(CASE WHEN e.hi - h.w BETWEEN 10 AND 19 THEN h.cyber_health END) AS d0
    FROM hs h JOIN ends e USING (vehicle_id, capture) GROUP BY ALL),
region_trend AS (SELECT *, CASE WHEN n < 20 THEN 0e0 ELSE d0 END AS d, {trend_of('CASE WHEN n < 20 THEN 0e0 ELSE d0 END')} AS trend FROM levels_),
region_forecast AS (
    SELECT r.vehicle_id, r.capture, g.step, CASE WHEN n < 3 THEN 50e0 ELSE least(greatest(
        level * exp(-g.step / 20e0) + mean_value * (1 - exp(-g.step / 20e0)), 0e0), 100e0) END AS forecast
    FROM region_trend r CROSS JOIN (SELECT unnest(range(0, 20)) AS step) g),
regions AS MATERIALIZED (
    SELECT r.*, f.projected_health FROM region_trend r
    JOIN (SELECT vehicle_id, capture, avg(forecast) AS projected_health FROM region_forecast GROUP BY ALL) f USING (vehicle_id, capture))""",
    "explained": _tracked_long() + """,
parts AS (
    SELECT vehicle_id, capture, w, component, avg(healthiness) AS ch, CASE component WHEN 'Threat' THEN 0 WHEN 'Stability' THEN 1 ELSE 2 END AS cord
    FROM tracked GROUP BY ALL),
parts_ranked AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, capture, w ORDER BY round(ch, 10), cord) AS r FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, capture, w ORDER BY healthiness, ord) AS r FROM tracked),
in_part AS (
    SELECT t.*, row_number() OVER (PARTITION BY t.vehicle_id, t.capture, t.w ORDER BY t.healthiness, t.member) AS m
    FROM tracked t JOIN parts_ranked p ON t.vehicle_id = p.vehicle_id AND t.capture = p.capture AND t.w = p.w AND t.component = p.component AND p.r = 1),
bad AS (SELECT vehicle_id, capture, w, string_agg(label, ', ' ORDER BY ord) FILTER (bo <= 5) AS feature_list, count(*) AS n_unhealthy
    FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, capture, w ORDER BY ord) AS bo FROM tracked WHERE healthiness < 5e-1) GROUP BY ALL),
losses AS (SELECT vehicle_id, capture, w, avg(1 - healthiness) AS mean_loss FROM tracked GROUP BY ALL),
explained AS MATERIALIZED (
    SELECT h.*, p1.component AS primary_component, p1.ch AS component_health, p2.component AS secondary_component,
        f1.feature AS primary_feature, f1.label AS primary_label, f1.z_score AS primary_z, f1.direction AS primary_direction,
        f1.healthiness AS primary_healthiness, r2.feature AS secondary_feature, r2.label AS secondary_label, r2.z_score AS secondary_z,
        coalesce(bad.feature_list, 'none') AS feature_list, coalesce(bad.n_unhealthy, 0) AS n_unhealthy, l.mean_loss,
        pt.ch AS threat_health, ps.ch AS stability_health, pp.ch AS pressure_health
    FROM hs h
    JOIN parts_ranked p1 ON h.capture = p1.capture AND h.w = p1.w AND p1.r = 1
    JOIN parts_ranked p2 ON h.capture = p2.capture AND h.w = p2.w AND p2.r = 2
    JOIN parts pt ON h.capture = pt.capture AND h.w = pt.w AND pt.component = 'Threat'
    JOIN parts ps ON h.capture = ps.capture AND h.w = ps.w AND ps.component = 'Stability'
    JOIN parts pp ON h.capture = pp.capture AND h.w = pp.w AND pp.component = 'Pressure'
    JOIN in_part f1 ON h.capture = f1.capture AND h.w = f1.w AND f1.m = 1
    JOIN ranked r2 ON h.capture = r2.capture AND h.w = r2.w AND r2.r = 2
    JOIN losses l ON h.capture = l.capture AND h.w = l.w
    LEFT JOIN bad ON h.capture = bad.capture AND h.w = bad.w)""",
}


def story_sql() -> str:
    texts = {
        "health": fixed("cyber_health", 0), "trend": "lower(trend)", "trend_size": f"coalesce({fixed('abs(trend_diff)', 0)}, 'nan')",
        "lookback": "'10'", "horizon": "'20'", "forecast": fixed("projected_health", 0),
        "primary_component": "primary_component", "primary_label": "primary_label",
        "primary_z": fixed("primary_z", 1, True), "primary_direction": "primary_direction",
        "secondary_component": "secondary_component", "secondary_label": "secondary_label",
        "secondary_z": fixed("secondary_z", 1, True), "component_pct": fixed("component_health * 100", 0),
        "feature_list": "feature_list",
    }

    def filled(column: str) -> str:
        expr = column
        for name, text in texts.items():
            expr = f"replace({expr}, '{{{name}}}', {text})"
        return expr

    return f"""templates AS ({values(fv.TEMPLATES, 'category, summary_t, trend_t, root_t, forecast_t, response_t')}),
known_attacks AS ({values(fv.ATTACKS, 'context_type, attack_label_text, mechanism, signature, impact, mitigation')}),
told AS (
    SELECT e.*, k.context_type, k.attack_label_text, k.signature, k.impact, k.mitigation, t.summary_t AS threat_summary,
        {filled('t.trend_t')} AS trend_text, {filled('t.root_t')} AS root_cause_text, {filled('t.forecast_t')} AS forecast_text,
        t.response_t AS recommended_response
    FROM to_tell e JOIN templates t ON e.risk_category = t.category
    LEFT JOIN known_attacks k ON e.attack_type = k.context_type AND e.risk_category NOT IN ('Secure', 'Stable')),
stories AS MATERIALIZED (
    SELECT *, CASE WHEN risk_category IN ('Secure', 'Stable') THEN threat_summary || ' ' || trend_text
        ELSE threat_summary || ' ' || trend_text || coalesce(' Pattern matches ' || attack_label_text || ' attack: ' || signature || '. Impact: ' || impact || '.', '')
            || ' Root cause: ' || root_cause_text || ' ' || forecast_text || ' Recommended: ' || recommended_response END AS narrative
    FROM told)"""


# Every window told with its local trend and the projection of its class.
BLOCKS["stories"] = """to_tell AS (
    SELECT e.*, t.trend, t.trend_diff, r.projected_health FROM explained e
    JOIN trended t USING (vehicle_id, capture, w) JOIN regions r USING (vehicle_id, capture)),
""" + story_sql()

# One representative window per class told with the trend of its class.
EXAMPLES = """centers AS (SELECT attack_type, avg(cyber_health) AS c FROM hs GROUP BY ALL),
near_mean AS (
    SELECT * FROM (SELECT h.capture, h.w, row_number() OVER (PARTITION BY h.attack_type ORDER BY round(abs(h.cyber_health - c.c), 9), h.window_index) AS r
        FROM hs h JOIN centers c USING (attack_type)) WHERE r = 1),
extreme AS (SELECT * FROM hs WHERE attack_type <> 'Normal' AND risk_category IN ('High Risk', 'Critical')),
medians AS (SELECT attack_type, quantile_cont(cyber_health, 0.5) AS c FROM extreme GROUP BY ALL),
near_median AS (
    SELECT * FROM (SELECT h.capture, h.w, row_number() OVER (PARTITION BY h.attack_type ORDER BY round(abs(h.cyber_health - c.c), 9), h.window_index) AS r
        FROM extreme h JOIN medians c USING (attack_type)) WHERE r = 1),
examples AS (SELECT m.capture, coalesce(x.w, m.w) AS w FROM near_mean m LEFT JOIN near_median x USING (capture))"""

LEVEL = (
    "CASE WHEN risk_category = 'Critical' AND {t} = 'Degrading' THEN 4 WHEN risk_category = 'Critical' THEN 3 "
    "WHEN risk_category = 'High Risk' AND {t} = 'Degrading' THEN 3 WHEN risk_category = 'High Risk' THEN 2 "
    "WHEN risk_category = 'Warning' THEN 1 ELSE 0 END"
)
CONFIDENCE = (
    "CAST(round_even(CAST(least(greatest(3e-1 * mean_loss + 3e-1 * (1 - {h} / 100) + 4e-1 * (CASE risk_category WHEN 'Secure' THEN 0 "
    "WHEN 'Stable' THEN 1 WHEN 'Warning' THEN 2 WHEN 'High Risk' THEN 3 WHEN 'Critical' THEN 4 ELSE 2 END) / 4e0, 0), 1) AS DECIMAL(18, 9)), 4) AS DOUBLE)"
)
PLAYBOOK = f"""playbook AS ({values([(*p, i) for i, p in enumerate(fv.PLAYBOOK)], 'pb_type, action_level, id, name, description, target, execution_time_ms, automated, reversible, side_effects, ord')}),
levels_dim AS ({values(fv.LEVELS, 'response_level, level_label, outcome, recovery, safety')})"""
BLOCKS["decisions"] = f"""{PLAYBOOK},
leveled AS (
    SELECT *, {LEVEL.format(t='trend')} AS response_level, round_even(cyber_health, 2) AS health_2 FROM stories),
actions_of AS (
    SELECT p.pb_type, l.response_level, count(*) AS n_actions,
        string_agg(p.id, ',' ORDER BY CASE WHEN p.action_level = l.response_level THEN -1 ELSE p.action_level END, p.ord) AS action_ids
    FROM playbook p JOIN levels_dim l ON p.action_level <= l.response_level GROUP BY ALL),
decisions AS MATERIALIZED (
    SELECT s.vehicle_id, s.capture, s.w, s.window_index, s.risk_category, s.health_2 AS health_score, s.trend AS trend_label,
        s.context_type AS attack_type, CAST(s.response_level AS INTEGER) AS response_level, d.level_label,
        {CONFIDENCE.format(h='s.health_2')} AS confidence,
        coalesce(a.action_ids, 'gen_l' || s.response_level || '_1') AS action_ids, CAST(coalesce(a.n_actions, 1) AS INTEGER) AS n_actions,
        d.outcome AS expected_outcome, d.recovery AS recovery_strategy,
        d.safety || CASE WHEN s.response_level >= 3 AND s.context_type = 'Gear' THEN '; transmission safety at risk'
            WHEN s.response_level >= 3 AND s.context_type = 'RPM' THEN '; engine safety at risk' ELSE '' END AS safety_notes
    FROM leveled s JOIN levels_dim d ON s.response_level = d.response_level
    LEFT JOIN actions_of a ON s.context_type = a.pb_type AND s.response_level = a.response_level)"""


def build(upto: str, select: str, extra: str = "", skip: tuple[str, ...] = ()) -> str:
    """``WITH`` all blocks up to and including ``upto`` (plus ``extra`` CTEs), then the select."""
    parts = []
    for name, text in BLOCKS.items():
        if name not in skip:
            parts.append(text)
        if name == upto:
            break
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + select


def told_examples(select: str) -> str:
    """Stories of the representative windows, then ``select`` from ``stories``."""
    chosen = EXAMPLES + """,
to_tell AS (
    SELECT e.*, r.trend, round_even(r.d, 2) AS trend_diff, r.projected_health FROM explained e JOIN examples x USING (capture, w)
    JOIN regions r USING (vehicle_id, capture)),
""" + story_sql()
    return build("explained", select, chosen)


def out(body: str, plain: str = "", doubles: str = "") -> str:
    """Outer select: plain columns as they are, doubles shifted off the rounding edge and rounded to six digits."""
    columns = plain.split() + [f"round({c} + {EDGE_SHIFT!r}, 6) AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(columns)} FROM ({body})"
