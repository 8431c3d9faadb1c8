"""Questions that fit or compare detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators import evaluate as ev, forest, frames as fr, neighbors, oneclass, projections, vantage
from busvitals.operators.detect import classify_anomaly, score_threshold
from busvitals.plans.health_questions import KEY, METRICS, keyed
from busvitals.plans.reference_sql import build, out
from busvitals.plans.registry import question
from busvitals.plans.workspace import Workspace
from busvitals.sources.scratch import stored

FRAME_FEATURES = [
    "can_id", "can_id_priority", "dlc", "dlc_normalized", "payload_mean", "payload_std", "payload_sum", "payload_min",
    "payload_max", "payload_non_zero_count", "payload_entropy",
]

_PID = "concat_ws('|', {t}.vehicle_id, {t}.capture, CAST(CAST({t}.w AS BIGINT) AS VARCHAR))"
_KNN = f"""pairs AS (
    SELECT {_PID.format(t='q')} AS pid, {_PID.format(t='t')} AS neighbour, sqrt({' + '.join(f'(q.{c} - t.{c}) * (q.{c} - t.{c})' for c in fv.FEATURES)}) AS distance
    FROM scaled q CROSS JOIN scaled t WHERE t.attack_label = 0),
knn AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, neighbour) AS rank FROM pairs WHERE pid <> neighbour) WHERE rank <= 20)"""


@question("knn_join", build("support", out("SELECT pid, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM knn", "pid rank neighbour", "distance"), _KNN))
def knn_join(ws: Workspace) -> DataFrame:
    """20 nearest normal windows of every window."""
    points = neighbors.as_points(ws.windows())
    return neighbors.knn_join(points, points.where("attack_label = 0"), 20)


@question("knn_join_approximate", build("support", out("SELECT pid, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM knn", "pid rank neighbour", "distance"), _KNN))
def knn_join_approximate(ws: Workspace) -> DataFrame:
    """20 near normal windows of every window; exact while these fit one cell, else with a recall that the tests measure."""
    points = neighbors.as_points(ws.windows())
    return projections.approximate_knn_join(points, points.where("attack_label = 0"), 20)


_LOF = f"""{_KNN.replace("scaled t WHERE t.attack_label = 0", "support t")},
kd AS (SELECT pid AS neighbour, max(distance) AS k_distance FROM knn GROUP BY ALL),
density AS (SELECT pid, 1 / (avg(greatest(distance, k_distance)) + 1e-10) AS density FROM knn JOIN kd USING (neighbour) GROUP BY ALL),
lof AS (SELECT k.pid, avg(n.density) / any_value(d.density) AS lof FROM knn k JOIN density n ON n.pid = k.neighbour JOIN density d ON d.pid = k.pid GROUP BY k.pid)"""


@question("lof_score", build("support", keyed(f"SELECT s.vehicle_id, s.capture, s.w, l.lof FROM scaled s JOIN lof l ON l.pid = {_PID.format(t='s')}", "", "lof"), _LOF))
def lof_score(ws: Workspace) -> DataFrame:
    """Local outlier factor of every window against the training draw."""
    return vantage.lof_score(ws.windows(), vantage.fit_lof(ws.windows())).where("lof IS NOT NULL").select(*KEY, "lof")


def forest_sql(rows: str, keys: str, features: list[str]) -> str:
    """CTEs from ``pool`` to ``forest`` (``tree``, ``node``, ``feature``, ``cut``, ``depth``) and ``forest_scored``: the table
    ``rows`` (with ``attack_label``) and its ``forest_score``, from a forest grown on the normal ones."""
    x = "[" + ", ".join(f"round(CAST({c} AS DOUBLE), {forest.DIGITS})" for c in features) + "]"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in features)
    key = f"concat_ws('|', {keys})"
    hex_ = lambda text, at: f"CAST(('0x' || substr(md5({text}), {at}, {forest._HEX})) AS BIGINT)"
    unit = lambda purpose: hex_(f"concat_ws('|', '{fv.SEED}', tree, node, '{purpose}')", 1) + f" / {float(forest._SPACE)!r}"
    deepest = (forest.SAMPLE - 1).bit_length()
    rest = "CASE WHEN n <= 1 THEN 0e0 WHEN n = 2 THEN 1e0 ELSE 2e0 * (ln(n - 1) + 0.5772156649015329e0) - 2e0 * (n - 1) / n END"
    ctes = [f"""pool AS MATERIALIZED (SELECT *, {key} AS rid, {x} AS x FROM {rows} WHERE {whole}),
drawn AS (SELECT tree, rid, x, (base + tree * stride) % {forest._SPACE} AS d FROM (
    SELECT rid, x, {hex_(f"rid || '|{fv.SEED}'", 1)} AS base, {hex_(f"rid || '|{fv.SEED}'", 1 + forest._HEX)} AS stride FROM pool WHERE attack_label = 0
    ) CROSS JOIN range({forest.TREES}) t(tree)),
level0 AS MATERIALIZED (SELECT tree, x, 1 AS node, least(count(*) OVER (PARTITION BY tree), {forest.SAMPLE}) AS size FROM drawn
    QUALIFY row_number() OVER (PARTITION BY tree ORDER BY d, rid) <= {forest.SAMPLE})"""]
    for depth in range(deepest + 1):
        ctes.append(f"""cuts{depth} AS MATERIALIZED (SELECT tree, node, n, pick.f AS feature, pick.lo + {unit('cut')} * (pick.hi - pick.lo) AS cut FROM (
    SELECT tree, node, n, CASE WHEN n > 1 AND {depth} < ceil(log2(greatest(size, 2))) AND len(open) > 0 THEN open[1 + CAST(floor({unit('feature')} * len(open)) AS INTEGER)] END AS pick FROM (
        SELECT tree, node, max(n) AS n, max(size) AS size, list({{'f': f, 'lo': lo, 'hi': hi}} ORDER BY f) FILTER (WHERE hi > lo) AS open FROM (
            SELECT tree, node, f, count(*) AS n, max(size) AS size, min(v) AS lo, max(v) AS hi FROM (
                SELECT tree, node, size, unnest(range({len(features)})) AS f, unnest(x) AS v FROM level{depth}) GROUP BY ALL)
        GROUP BY ALL))),
level{depth + 1} AS MATERIALIZED (SELECT tree, x, 2 * node + CASE WHEN x[feature + 1] < cut THEN 0 ELSE 1 END AS node, size
    FROM level{depth} JOIN cuts{depth} USING (tree, node) WHERE feature IS NOT NULL)""")
    every = " UNION ALL ".join(f"SELECT tree, node, coalesce(feature, -1) AS feature, cut, {d} + {rest} AS depth FROM cuts{d}" for d in range(deepest + 1))
    # a cut at the least value leaves its left child without rows
    ctes.append(f"grown AS ({every}), forest AS MATERIALIZED (SELECT * FROM grown)")
    ctes.append(f"at0 AS (SELECT rid, x, tree, 1 AS node FROM pool CROSS JOIN range({forest.TREES}) t(tree))")
    for depth in range(deepest):
        ctes.append(f"""at{depth + 1} AS (SELECT rid, x, a.tree, CASE WHEN feature < 0 OR feature IS NULL THEN a.node WHEN x[feature + 1] < cut THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
    FROM at{depth} a LEFT JOIN forest f ON f.tree = a.tree AND f.node = a.node)""")
    norm = forest._average_path(forest.SAMPLE)
    ctes.append(f"""deep AS (SELECT rid, avg(depth) AS depth FROM at{deepest} a JOIN forest f ON f.tree = a.tree AND f.node = a.node GROUP BY rid),
forest_scored AS MATERIALIZED (SELECT p.* EXCLUDE (x), round(-pow(2e0, -depth / {norm!r}), 9) AS forest_score FROM pool p JOIN deep USING (rid))""")
    return ",\n".join(ctes)


_WINDOW_FOREST = forest_sql("windows", "vehicle_id, capture, CAST(CAST(w AS BIGINT) AS VARCHAR)", list(fv.FEATURES))


@question("isolation_forest", build("windows", keyed("SELECT * FROM forest_scored", "attack_type", "forest_score"), _WINDOW_FOREST))
def isolation_forest(ws: Workspace) -> DataFrame:
    """Score of every window under a forest grown on the normal ones."""
    scored = forest.isolation_forest(ws.windows(), KEY).where("forest_score IS NOT NULL")
    return scored.select(*KEY, "attack_type", F.round("forest_score", 9).alias("forest_score"))


_ENGINEERED = """engineered AS MATERIALIZED (
    SELECT n.vehicle_id, n.capture, n.seq, n.attack_type, n.attack_label, n.can_id, 2047 - n.can_id AS can_id_priority, n.dlc, n.dlc / 8e0 AS dlc_normalized,
        payload_entropy, coalesce(m, 0) AS payload_mean, coalesce(s, 0) AS payload_std, coalesce(t, 0) AS payload_sum, coalesce(lo, 0) AS payload_min,
        coalesce(hi, 0) AS payload_max, coalesce(z, 0) AS payload_non_zero_count
    FROM numbered n LEFT JOIN (SELECT seq, avg(b) AS m, stddev_pop(b) AS s, sum(b) AS t, min(b) AS lo, max(b) AS hi, count(*) FILTER (b <> 0) AS z
        FROM (SELECT seq, unnest(payload) AS b FROM frames) GROUP BY seq) x ON n.seq = x.seq)"""


@question("isolation_forest_frames", build("numbered", out("""SELECT attack_type, count(*) AS samples, avg(CASE WHEN forest_score < t THEN 1e0 ELSE 0e0 END) AS detection_rate
    FROM forest_scored CROSS JOIN (SELECT quantile_cont(forest_score, 0.05) AS t FROM forest_scored WHERE attack_label = 0) GROUP BY attack_type""",
    "attack_type samples", "detection_rate"), _ENGINEERED + ",\n" + forest_sql("engineered", "vehicle_id, capture, CAST(seq AS VARCHAR)", FRAME_FEATURES)))
def isolation_forest_frames(ws: Workspace) -> DataFrame:
    """The per-frame baseline: the same forest on single frames, as detection rate per class."""
    frames = ws.engineered()
    # nine digits: the order in which trees are added up must not decide which of equal frames is below the threshold
    scored = forest.isolation_forest(frames, ["vehicle_id", "capture", "seq"], FRAME_FEATURES).withColumn("forest_score", F.round("forest_score", 9))
    scored = stored(scored, "frame-scores")
    return ev.detection_rate_by_attack(classify_anomaly(scored, score_threshold(scored, "forest_score"), "forest_score"))


@question("ocsvm_fit")
def ocsvm_fit(ws: Workspace) -> DataFrame:
    """Score of every window under the one-class machine trained on all normal ones."""
    model = oneclass.ocsvm_fit(ws.windows())
    return oneclass.ocsvm_score(ws.windows(), model).select(*KEY, "attack_type", "ocsvm_score")


DETECTORS = ("parzen", "isolation_forest", "lof", "ocsvm")


def detector_scores(ws: Workspace, detectors: tuple[str, ...] = DETECTORS) -> dict[str, DataFrame]:
    """Score table of each detector, low = anomalous."""
    keep = [*KEY, "attack_type", "attack_label"]
    windows = ws.scored()
    makers = {
        "parzen": lambda: windows.select(*keep, F.col("anomaly_score").alias("score")),
        "isolation_forest": lambda: forest.isolation_forest(windows, KEY, out="score").select(*keep, "score"),
        "lof": lambda: vantage.lof_score(windows, vantage.fit_lof(windows)).select(*keep, (-F.col("lof")).alias("score")),
        "ocsvm": lambda: oneclass.ocsvm_score(windows, oneclass.ocsvm_fit(windows), "score").select(*keep, "score"),
    }
    return {name: makers[name]() for name in detectors}


def classified_by_detector(ws: Workspace) -> DataFrame:
    parts = [
        classify_anomaly(df, score_threshold(df, "score"), "score").withColumn("detector", F.lit(name))
        for name, df in ((n, stored(d, f"scores-{n}")) for n, d in detector_scores(ws).items())
    ]
    return fr.union_captures(*parts)


@question("model_comparison")
def model_comparison(ws: Workspace) -> DataFrame:
    """Metrics of all detectors side by side, best F1 first."""
    return ev.model_comparison(classified_by_detector(ws))


_POOLED = f"""{_LOF},
{_WINDOW_FOREST},
pooled AS (
    SELECT 'parzen' AS detector, attack_label, round(anomaly_score, 9) AS score FROM scored
    UNION ALL SELECT 'isolation_forest', attack_label, forest_score FROM forest_scored
    UNION ALL SELECT 'lof', s.attack_label, -round(l.lof, 9) FROM scaled s JOIN lof l ON l.pid = {_PID.format(t='s')}),
limits AS (SELECT detector, quantile_cont(score, 0.05) AS t FROM pooled WHERE attack_label = 0 GROUP BY detector),
judged AS MATERIALIZED (SELECT detector, attack_label, score, CASE WHEN score < t THEN 1 ELSE 0 END AS is_anomaly FROM pooled JOIN limits USING (detector)),
areas AS (SELECT p.detector, sum(CASE WHEN p.score < n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0 END) / count(*) AS auc
    FROM judged p JOIN judged n ON p.detector = n.detector WHERE p.attack_label = 1 AND n.attack_label = 0 GROUP BY p.detector),
curves AS (SELECT detector, pos, sum(neg) OVER (PARTITION BY detector ORDER BY score) AS cneg, sum(pos) OVER (PARTITION BY detector ORDER BY score) AS cpos, sum(pos) OVER (PARTITION BY detector) AS npos FROM (
    SELECT detector, score, count(*) FILTER (attack_label = 1) AS pos, count(*) FILTER (attack_label = 0) AS neg FROM judged GROUP BY ALL)),
precisions AS (SELECT detector, sum(pos * 1e0 / npos * cpos / (cpos + cneg)) AS avg_precision FROM curves GROUP BY detector),
measured AS (SELECT detector, {METRICS.removeprefix("SELECT ").replace("(SELECT ", "(SELECT detector, ").format(t="judged GROUP BY detector")})"""


@question("model_comparison_checked", build("scored", out(
    """SELECT detector, precision, recall, f1, fpr, detection_rate, auc, avg_precision, CAST(row_number() OVER (ORDER BY round(f1, 9) DESC, detector) AS INTEGER) AS f1_rank
    FROM measured JOIN areas USING (detector) JOIN precisions USING (detector)""",
    "detector f1_rank", "precision recall f1 fpr detection_rate auc avg_precision"), _POOLED))
def model_comparison_checked(ws: Workspace) -> DataFrame:
    """Metrics of the detectors that SQL can compute too, best F1 first; scores to nine digits, so that ties are ties in any engine."""
    parts = []
    for name, scores in detector_scores(ws, ("parzen", "isolation_forest", "lof")).items():
        scores = stored(scores.withColumn("score", F.round("score", 9)), f"scores-{name}")
        parts.append(classify_anomaly(scores, score_threshold(scores, "score"), "score").withColumn("detector", F.lit(name)))
    return ev.model_comparison(fr.union_captures(*parts))
