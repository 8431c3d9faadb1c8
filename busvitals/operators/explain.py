"""Attribution of a window's health to features and components, and its wording.

Everything about one window is computed inside its row (short arrays of seven features); the only joins are
against the fixed text tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busvitals.functions import dimensions as dims
from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import (
    deviation_direction, fill, fixed_text, healthiness_of_z, trend_label, zscore,
)
from busvitals.operators.baseline import zscores_long
from busvitals.operators.ordering import attach
from busvitals.operators.quantiles import exact_percentiles

KEY = ("vehicle_id", "capture", "w")

STORY_SCHEMA = """
    metadata STRUCT<generated_at: STRING, window_index: BIGINT, window_size: INT>,
    threat_summary STRING, risk_category STRING, health_score DOUBLE,
    trend STRUCT<label: STRING, magnitude: DOUBLE, description: STRING>,
    root_cause_analysis STRUCT<
        primary_component: STRING,
        component_breakdown: MAP<STRING, DOUBLE>,
        primary_feature: STRUCT<name: STRING, label: STRING, z_score: DOUBLE, deviation: STRING>,
        feature_attributions: MAP<STRING, STRUCT<label: STRING, z_score: DOUBLE, healthiness: DOUBLE>>,
        root_cause_text: STRING>,
    future_risk_forecast STRUCT<horizon_windows: INT, projected_health: DOUBLE, forecast_text: STRING>,
    recommended_response STRING,
    attack_context STRUCT<attack_type: STRING,
        attack_info: STRUCT<attack_type: STRING, mechanism: STRING, signature: STRING, impact: STRING, mitigation: STRING>>,
    narrative STRING
"""


# ---- attribution -----------------------------------------------------------------------------------------------

def zscore_attribution(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per feature of each window: min(1, |z|/5) on the value rounded to 4 digits, anomalous above 0.3."""
    rounded = windows.withColumns({c: F.bround(F.col(c), 4) for c in fv.FEATURES})
    long = zscores_long(rounded, baseline, fv.FEATURES, (*KEY, "attack_type"))
    importance = F.least(F.lit(1.0), F.coalesce(F.abs("z"), F.lit(0.0)) / 5.0)
    # compared without the last digits, so that a deviation of exactly 1.5 is never decided by rounding noise
    return long.withColumn("importance", importance).withColumn("is_anomalous", (F.round("importance", 9) > 0.3).cast("int"))


def top_driver(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per window the anomalous feature of the largest importance, compared at 4 digits, the first one on ties; without
    one, the first feature at 0 percent."""
    items = []
    for i, c in enumerate(fv.FEATURES):
        z = zscore(F.bround(F.col(c), 4), F.col(f"m_{c}"), F.col(f"s_{c}"))
        importance = F.least(F.lit(1.0), F.coalesce(F.abs(z), F.lit(0.0)) / 5.0)
        items.append(F.struct(
            F.bround(importance, 4).alias("rounded"), F.lit(-i).alias("neg"), F.lit(c).alias("feature"), importance.alias("importance")
        ))
    anomalous = F.filter(F.array(*items), lambda a: F.round(a["importance"], 9) > 0.3)
    found = attach(windows, baseline).withColumn("_f", anomalous).withColumn("_b", F.array_max("_f"))
    return found.select(
        *KEY,
        "attack_type",
        F.coalesce(F.col("_b.feature"), F.lit(fv.FEATURES[0])).alias("top_driver"),
        F.coalesce(F.col("_b.rounded") * 100, F.lit(0.0)).alias("contribution_pct"),
        F.size("_f").cast("bigint").alias("anomalous_features"),
    )


def feature_importance(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean |z| of the attack windows / 5, capped at 1; a constant baseline gives 0.

    All features are averaged in one pass over the windows; only the one row of means is turned on its side.
    """
    z = {c: zscore(F.col(c), F.col(f"m_{c}"), F.col(f"s_{c}")) for c in fv.FEATURES}
    means = attach(windows.where("attack_label = 1"), baseline).agg(*[F.avg(F.abs(z[c])).alias(c) for c in fv.FEATURES])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_z")) for c in fv.FEATURES])).alias("_r"))
    ranked = long.select("_r.*").withColumn("importance", F.bround(F.least(F.lit(1.0), F.coalesce(F.col("_z"), F.lit(0.0)) / 5.0), 4))
    named = ranked.join(F.broadcast(dims.feature_categories(windows.sparkSession)), "feature", "left")
    return named.select("feature", "importance", F.coalesce("category", F.lit("Other")).alias("category")).orderBy(
        F.desc("importance"), "feature"
    )


def feature_separability(windows: DataFrame) -> DataFrame:
    """Mean of every feature per class, one row per feature and one column per class, from one pass over the windows."""
    means = windows.agg(*[
        F.avg(F.when(F.col("attack_type") == k, F.col(c).cast("double"))).alias(f"{c}|{k}") for c in fv.FEATURES for k in fv.CLASSES
    ])
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{k}`").alias(k) for k in fv.CLASSES]) for c in fv.FEATURES]
    return means.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def _tracked(windows_columns: Sequence[str] = ()) -> Column:
    """Array with one struct per tracked feature, in fixed order."""
    within: dict[str, int] = {}
    for component, members in (("Stability", fv.STABILITY_FEATURES), ("Pressure", fv.PRESSURE_FEATURES)):
        within.update({f: i for i, f in enumerate(members)})
    items = []
    for i, (feature, label, _, component, direction) in enumerate(fv.TRACKED):
        z = zscore(F.col(feature), F.col(f"m_{feature}"), F.col(f"s_{feature}"))
        items.append(
            F.struct(
                F.bround(healthiness_of_z(z, direction), 4).alias("healthiness"),
                F.lit(i).alias("ord"),
                F.lit(within.get(feature, 0)).alias("member"),
                F.lit(feature).alias("feature"),
                F.lit(label).alias("label"),
                F.lit(component).alias("component"),
                F.col(feature).cast("double").alias("value"),
                F.bround(z, 3).alias("z_score"),
                deviation_direction(z).alias("direction"),
            )
        )
    return F.array(*items)


def root_cause(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds attributions, component means, weakest component and feature, runner-ups and the unhealthy features."""
    attributed = attach(windows, baseline).withColumn("attributions", _tracked()).drop(*baseline.columns)
    ranked = attributed.withColumn("ranked", F.sort_array("attributions"))

    def mean_of(component: str) -> Column:
        members = F.filter("attributions", lambda a: a["component"] == component)
        return F.aggregate(members, F.lit(0.0), lambda s, a: s + a["healthiness"]) / F.size(members)

    parts = F.array(*[
        F.struct(mean_of(c).alias("health"), F.lit(i).alias("ord"), F.lit(c).alias("name"))
        for i, c in enumerate(fv.COMPONENTS)
    ])
    with_parts = ranked.withColumn("_parts", parts).withColumn("_weak", F.sort_array("_parts"))
    primary = F.col("_weak")[0]["name"]
    inside = F.array_sort(
        F.transform(
            F.filter("attributions", lambda a: a["component"] == primary),
            lambda a: F.struct(a["healthiness"].alias("h"), a["member"].alias("m"), a.alias("a")),
        )
    )
    out = with_parts.withColumn("_primary", inside[0]["a"])
    columns = {
        "threat_health": F.col("_parts")[0]["health"],
        "stability_health": F.col("_parts")[1]["health"],
        "pressure_health": F.col("_parts")[2]["health"],
        "primary_component": primary,
        "secondary_component": F.col("_weak")[1]["name"],
        "component_health": F.col("_weak")[0]["health"],
        "primary_feature": F.col("_primary.feature"),
        "primary_label": F.col("_primary.label"),
        "primary_z": F.col("_primary.z_score"),
        "primary_healthiness": F.col("_primary.healthiness"),
        "primary_direction": F.col("_primary.direction"),
        "secondary_feature": F.col("ranked")[1]["feature"],
        "secondary_label": F.col("ranked")[1]["label"],
        "secondary_z": F.col("ranked")[1]["z_score"],
        "unhealthy": F.filter("attributions", lambda a: a["healthiness"] < 0.5),
    }
    return out.withColumns(columns).drop("_parts", "_weak", "_primary", "ranked")


def rank_features(explained: DataFrame, keep: Sequence[str] = KEY) -> DataFrame:
    """Tracked features of each window from least to most healthy, ties in list order."""
    return explained.select(*keep, F.posexplode(F.sort_array("attributions")).alias("rank", "_a")).select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("_a.feature").alias("feature"),
        F.col("_a.healthiness").alias("healthiness"), F.col("_a.z_score").alias("z_score"),
    )


# ---- choosing windows ------------------------------------------------------------------------------------------

def worst_window(health: DataFrame, by: Sequence[str] = ("attack_type",), idx: str = "window_index") -> DataFrame:
    """First row with the lowest health per group."""
    return _pick(health, by, F.col("cyber_health"), idx)


def best_window(health: DataFrame, by: Sequence[str] = (), idx: str = "window_index") -> DataFrame:
    """First row with the highest health."""
    return _pick(health, by, -F.col("cyber_health"), idx)


def head_per_category(health: DataFrame, idx: str = "window_index") -> DataFrame:
    return _pick(health, ["risk_category"], F.col(idx), idx)


def _pick(df: DataFrame, by: Sequence[str], measure: Column, idx: str) -> DataFrame:
    """Per group the row with the smallest measure, the first of them by ``idx``.

    Keeping whole rows in an aggregation buffer would sort the table. Instead the minimum is found first (a number,
    hashed and combined map-side), and only rows that reach it are compared as rows.
    """
    usable = df.withColumn("_m", measure).where("_m IS NOT NULL")
    least = usable.groupBy(*by).agg(F.min("_m").alias("_least"))
    near = (usable.join(least, list(by)) if by else attach(usable, least)).where(F.col("_m") == F.col("_least"))
    chosen = F.min_by(F.struct(*[F.col(c) for c in df.columns]), idx).alias("_row")
    return near.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(chosen).select("_row.*")


def middle_window(health: DataFrame) -> DataFrame:
    """Row at position n // 2 of each series; ``w`` is dense, so nothing is ordered."""
    n = health.groupBy("vehicle_id", "capture").agg((F.max("w") + 1).alias("_n"))
    return health.join(n, ["vehicle_id", "capture"]).where(F.expr("w = _n div 2")).drop("_n")


def nearest_to_mean(health: DataFrame, by: Sequence[str] = ("attack_type",), idx: str = "window_index") -> DataFrame:
    """Row whose health is closest to the mean of its class."""
    center = health.groupBy(*by).agg(F.avg("cyber_health").alias("_c"))
    return _nearest(health, center, by, idx)


def nearest_to_extreme_median(health: DataFrame, idx: str = "window_index") -> DataFrame:
    """For attacks: the High Risk or Critical row closest to the median of such rows of the class."""
    extreme = health.where("attack_type <> 'Normal' AND risk_category IN ('High Risk', 'Critical')")
    center = exact_percentiles(extreme, ["attack_type"], "cyber_health", {"_c": 0.5})
    return _nearest(extreme, center, ["attack_type"], idx)


def _nearest(rows: DataFrame, center: DataFrame, by: Sequence[str], idx: str) -> DataFrame:
    # an even count puts two rows at the same distance from its median: compare without the last digits
    distance = F.round(F.abs(F.col("cyber_health") - F.col("_c")), 9)
    return _pick(rows.join(F.broadcast(center), list(by)), by, distance, idx).select(*rows.columns)


def example_windows(health: DataFrame) -> DataFrame:
    """One representative window per class: the extreme one where an attack has any, else the average one."""
    picks = nearest_to_mean(health).withColumn("_p", F.lit(1)).unionByName(
        nearest_to_extreme_median(health).withColumn("_p", F.lit(0))
    )
    return picks.groupBy("attack_type").agg(
        F.min_by(F.struct(*[F.col(c) for c in health.columns if c != "attack_type"]), "_p").alias("_row")
    ).select("attack_type", "_row.*").select(*health.columns)


# ---- wording ---------------------------------------------------------------------------------------------------

def template_join(rows: DataFrame) -> DataFrame:
    """The five texts of the row's category; an unknown category uses those of Warning."""
    known = F.col("risk_category").isin([c for c, _ in fv.CATEGORIES])
    keyed = rows.withColumn("category", F.when(known, F.col("risk_category")).otherwise(F.lit("Warning")))
    return keyed.join(F.broadcast(dims.templates(rows.sparkSession)), "category", "left").drop("category")


def attack_context_join(rows: DataFrame) -> DataFrame:
    """Attack knowledge for rows of a known attack whose category is neither Secure nor Stable."""
    known = dims.attacks(rows.sparkSession).withColumnRenamed("attack_type", "context_type")
    applies = (F.col("attack_type") == F.col("context_type")) & ~F.col("risk_category").isin("Secure", "Stable")
    return rows.join(F.broadcast(known), applies, "left")


def threat_story(explained: DataFrame, lookback: int = 10, horizon: int = 20) -> DataFrame:
    """Texts for rows of ``root_cause`` that also carry trend, trend_diff and projected_health."""
    named = F.array_join(F.transform(F.slice("unhealthy", 1, 5), lambda a: a["label"]), ", ")
    texts = {
        "health": fixed_text(F.col("cyber_health"), 0),
        "trend": F.lower("trend"),
        "trend_size": F.when(F.col("trend_diff").isNull(), F.lit("nan")).otherwise(fixed_text(F.abs("trend_diff"), 0)),
        "lookback": F.lit(str(lookback)),
        "horizon": F.lit(str(horizon)),
        "forecast": fixed_text(F.col("projected_health"), 0),
        "primary_component": F.col("primary_component"),
        "primary_label": F.col("primary_label"),
        "primary_z": fixed_text(F.col("primary_z"), 1, sign=True),
        "primary_direction": F.col("primary_direction"),
        "secondary_component": F.col("secondary_component"),
        "secondary_label": F.col("secondary_label"),
        "secondary_z": fixed_text(F.col("secondary_z"), 1, sign=True),
        "component_pct": fixed_text(F.col("component_health") * 100, 0),
        "feature_list": F.when(F.size("unhealthy") > 0, named).otherwise(F.lit("none")),
    }
    filled = attack_context_join(template_join(explained)).withColumns(
        {
            "threat_summary": F.col("summary_t"),
            "trend_text": fill(F.col("trend_t"), **texts),
            "root_cause_text": fill(F.col("root_t"), **texts),
            "forecast_text": fill(F.col("forecast_t"), **texts),
            "recommended_response": F.col("response_t"),
        }
    )
    context = F.when(
        F.col("context_type").isNotNull(),
        F.concat(F.lit("Pattern matches "), "attack_label_text", F.lit(" attack: "), "signature",
                 F.lit(". Impact: "), "impact", F.lit(".")),
    )
    calm = F.col("risk_category").isin("Secure", "Stable")
    detail = F.concat_ws(
        " ", context, F.concat(F.lit("Root cause: "), "root_cause_text"), F.col("forecast_text"),
        F.concat(F.lit("Recommended: "), "recommended_response"),
    )
    return filled.withColumn(
        "narrative", F.concat_ws(" ", "threat_summary", "trend_text", F.when(~calm, detail))
    ).drop("summary_t", "trend_t", "root_t", "forecast_t", "response_t")


def story_struct(stories: DataFrame, generated_at: str, horizon: int = 20) -> DataFrame:
    """Nest a story row as published: one struct column ``story`` next to the row's keys."""
    pairs = F.map_from_entries(
        F.transform(
            "attributions",
            lambda a: F.struct(a["feature"], F.struct(a["label"].alias("label"), a["z_score"].alias("z_score"),
                                                      a["healthiness"].alias("healthiness"))),
        )
    )
    context = F.when(
        F.col("context_type").isNotNull(),
        F.struct(
            F.col("context_type").alias("attack_type"),
            F.struct(F.col("attack_label_text").alias("attack_type"), "mechanism", "signature", "impact", "mitigation").alias(
                "attack_info"
            ),
        ),
    )
    story = F.struct(
        F.struct(F.lit(generated_at).alias("generated_at"), "window_index", F.lit(fv.WINDOW_SIZE).alias("window_size")).alias("metadata"),
        "threat_summary",
        "risk_category",
        F.bround("cyber_health", 2).alias("health_score"),
        F.struct(F.col("trend").alias("label"), F.bround("trend_diff", 2).alias("magnitude"),
                 F.col("trend_text").alias("description")).alias("trend"),
        F.struct(
            "primary_component",
            F.create_map(
                F.lit("Threat"), F.bround("threat_health", 4), F.lit("Stability"), F.bround("stability_health", 4),
                F.lit("Pressure"), F.bround("pressure_health", 4),
            ).alias("component_breakdown"),
            F.struct(F.col("primary_feature").alias("name"), F.col("primary_label").alias("label"),
                     F.col("primary_z").alias("z_score"), F.col("primary_direction").alias("deviation")).alias("primary_feature"),
            pairs.alias("feature_attributions"),
            "root_cause_text",
        ).alias("root_cause_analysis"),
        F.struct(F.lit(horizon).alias("horizon_windows"), F.bround("projected_health", 2).alias("projected_health"),
                 "forecast_text").alias("future_risk_forecast"),
        "recommended_response",
        context.alias("attack_context"),
        "narrative",
    )
    return stories.select("vehicle_id", "attack_type", story.alias("story"))


def short_alert(stories: DataFrame) -> DataFrame:
    """One line per story for the driver; health is the published value (two digits) rounded again."""
    health = fixed_text(F.bround("cyber_health", 2), 0)
    head = F.concat(F.lit("Cyber Health: "), health, F.lit("/100 — "))
    category = F.col("risk_category")
    text = (
        F.when(category == "Secure", F.concat(head, F.lit("All clear.")))
        .when(category == "Stable", F.concat(head, F.lit("Minor variations, monitoring.")))
        .when(category == "Warning",
              F.concat(head, F.lit("Warning. "), "primary_component", F.lit(" anomaly detected. Investigate.")))
        .when(category == "High Risk",
              F.concat(F.lit("ALERT: Cyber Health "), health, F.lit("/100 — High Risk. "), "primary_label",
                       F.lit(" severely abnormal. Action required.")))
        .otherwise(F.concat(F.lit("CRITICAL: Cyber Health "), health,
                            F.lit("/100 — Attack confirmed. Emergency response active.")))
    )
    return stories.withColumn("short_alert", text)


def simple_root_cause(health: DataFrame) -> DataFrame:
    return health.withColumn(
        "simple_component",
        F.when(F.col("threat_component") < 20, "Threat").when(F.col("stability_component") < 15, "Stability").otherwise("Pressure"),
    )


def simple_response(health: DataFrame) -> DataFrame:
    category = F.col("risk_category")
    return health.withColumns(
        {
            "simple_response": F.when(category.isin("Secure", "Stable"), "Monitor")
            .when(category == "Warning", "Investigate")
            .otherwise("Activate countermeasures"),
            "projected_health": F.greatest(F.lit(0.0), F.col("cyber_health") - 5.0),
        }
    )


def narrative_short(trended: DataFrame) -> DataFrame:
    """One sentence per number, for rows that carry a local trend."""
    return simple_response(simple_root_cause(trended)).withColumn(
        "narrative_short",
        F.concat(
            F.lit("Cyber Health is "), fixed_text(F.col("cyber_health"), 0), F.lit("/100 — "), "risk_category",
            F.lit(". Threat component: "), fixed_text(F.col("threat_component"), 1),
            F.lit("/40, Stability: "), fixed_text(F.col("stability_component"), 1),
            F.lit("/30, Pressure: "), fixed_text(F.col("pressure_component"), 1),
            F.lit("/30. Trend: "), trend_label(F.col("trend_diff")), F.lit(". Attack type: "), "attack_type", F.lit("."),
        ),
    )


def class_stories(trended: DataFrame, asked: DataFrame) -> DataFrame:
    """Per vehicle, the short story for each class in ``asked`` (``asked``, in any case): the worst window of that class; of an
    unknown class the worst of all; for none or the normal one the best of all. Rows carry a local trend.

    ``asked`` is what a user asks for, a few rows, and so broadcast.
    """
    whole = F.struct(*[F.col(c) for c in trended.columns if c != "vehicle_id"])

    def picked(rows: DataFrame, name: str, *by: Column) -> DataFrame:
        return rows.select("vehicle_id", *by, whole.alias(name))

    of_class = picked(worst_window(trended, ("vehicle_id", "attack_type")), "of_class", F.lower("attack_type").alias("class"))
    of_all = picked(worst_window(trended, ("vehicle_id",)), "of_all").join(picked(best_window(trended, ("vehicle_id",)), "best"), "vehicle_id")
    name = F.coalesce(F.lower("asked"), F.lit("normal"))
    rows = of_all.crossJoin(F.broadcast(asked.withColumn("class", name))).join(of_class, ["vehicle_id", "class"], "left")
    told = rows.select("vehicle_id", "asked", F.when(F.col("class") == "normal", F.col("best")).otherwise(F.coalesce("of_class", "of_all")).alias("row"))
    return narrative_short(told.select("vehicle_id", "asked", "row.*")).withColumn("health_score", F.col("cyber_health"))


def audience_routing(rows: DataFrame) -> DataFrame:
    """Audience, channel and urgency of a category."""
    return rows.join(F.broadcast(dims.category_routing(rows.sparkSession)), "risk_category", "left")
