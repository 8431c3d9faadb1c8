"""Response levels, playbook actions and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busvitals.functions import dimensions as dims
from busvitals.functions import fixed_values as fv
from busvitals.functions.scalars import category_index

ACTION = ["id", "name", "description", "target", "execution_time_ms", "automated", "reversible", "side_effects"]


def level_from_risk(category: Column, trend: Column) -> Column:
    worsening = trend == "Degrading"
    return (
        F.when((category == "Critical") & worsening, 4)
        .when(category == "Critical", 3)
        .when((category == "High Risk") & worsening, 3)
        .when(category == "High Risk", 2)
        .when(category == "Warning", 1)
        .otherwise(0)
    )


def level_from_mean_health(mean: Column) -> Column:
    """The fleet policy: the index of the category the mean health falls into."""
    expr = F.lit(len(fv.CATEGORIES) - 1)
    for i, (_, lower) in reversed(list(enumerate(fv.CATEGORIES[:-1]))):
        expr = F.when(mean >= lower, F.lit(i)).otherwise(expr)
    return expr


def level_from_attack(attack_type: Column) -> Column:
    return F.when(F.lower(attack_type).isin("dos", "fuzzy"), 3).otherwise(2)


def response_confidence(category: Column, health: Column, attributions: Column) -> Column:
    """0.3 * mean loss of the features + 0.3 * loss of health + 0.4 * severity of the category, 4 digits."""
    loss = F.aggregate(attributions, F.lit(0.0), lambda s, a: s + (1.0 - a["healthiness"])) / F.greatest(
        F.size(attributions), F.lit(1)
    )
    raw = 0.3 * loss + 0.3 * (1.0 - health / 100.0) + 0.4 * category_index(category) / (len(fv.CATEGORIES) - 1)
    # rounded as a decimal, so that exact halves are not decided by noise in the last binary digits
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).cast("decimal(18,9)"), 4).cast("double")


def playbook_actions(spark: SparkSession) -> DataFrame:
    """(attack, level) → ordered actions: those of the level, then the lower levels upwards. 20 rows."""
    pb = dims.playbook(spark)
    ladder = dims.levels(spark).select("response_level")
    chosen = pb.join(F.broadcast(ladder), pb["action_level"] <= ladder["response_level"])
    rank = F.when(F.col("action_level") == F.col("response_level"), -1).otherwise(F.col("action_level"))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("_r"), "ord", F.struct(*ACTION).alias("action"))))
    return chosen.groupBy(F.col("attack_type").alias("playbook_type"), F.col("response_level").alias("playbook_level")).agg(
        F.transform(listed, lambda a: a["action"]).alias("actions")
    )


def select_actions(rows: DataFrame, attack: str = "attack_type", level: str = "response_level") -> DataFrame:
    """Adds ``actions``; an unknown or missing attack gets the single generic action of its level."""
    label = F.lit("Monitor")
    for lvl, name, *_ in fv.LEVELS:
        label = F.when(F.col(level) == lvl, F.lit(name)).otherwise(label)
    generic = F.struct(
        F.concat(F.lit("gen_l"), F.col(level).cast("string"), F.lit("_1")).alias("id"),
        label.alias("name"),
        F.lit(fv.GENERIC_ACTION_TEXT).alias("description"),
        F.lit("network").alias("target"),
        F.lit(None).cast("int").alias("execution_time_ms"),
        (F.col(level) < 2).alias("automated"),
        F.lit(True).alias("reversible"),
        F.lit(None).cast("string").alias("side_effects"),
    )
    on = (F.col(attack) == F.col("playbook_type")) & (F.col(level) == F.col("playbook_level"))
    return (
        rows.join(F.broadcast(playbook_actions(rows.sparkSession)), on, "left")
        .withColumn("actions", F.coalesce("actions", F.array(generic)))
        .drop("playbook_type", "playbook_level")
    )


def outcome_recovery_safety(rows: DataFrame, attack: str = "attack_type", level: str = "response_level") -> DataFrame:
    """Outcome, recovery strategy and safety note; the note names the drivetrain part from level 3 on."""
    suffix = F.lit("")
    for name, text in reversed(fv.SAFETY_SUFFIX):
        suffix = F.when(F.lower(F.col(attack)).contains(name), F.lit(text)).otherwise(suffix)
    joined = rows.join(F.broadcast(dims.levels(rows.sparkSession).withColumnRenamed("response_level", "_lvl")),
                       F.col(level) == F.col("_lvl"), "left").drop("_lvl")
    return joined.withColumn("safety", F.when(F.col(level) >= 3, F.concat("safety", suffix)).otherwise(F.col("safety"))).withColumnsRenamed(
        {"outcome": "expected_outcome", "recovery": "recovery_strategy", "safety": "safety_notes"}
    )


def response_decision(stories: DataFrame) -> DataFrame:
    """A decision per story row. The attack counts only where the story has an attack context."""
    base = stories.select(
        "vehicle_id", "capture", "w", "window_index", "risk_category",
        F.bround("cyber_health", 2).alias("health_score"),
        F.col("trend").alias("trend_label"),
        F.col("context_type").alias("attack_type"),
        "attributions",
    ).withColumn("response_level", level_from_risk(F.col("risk_category"), F.col("trend_label")))
    scored = base.withColumn(
        "confidence", response_confidence(F.col("risk_category"), F.col("health_score"), F.col("attributions"))
    ).drop("attributions")
    return outcome_recovery_safety(select_actions(scored))


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Per level 0-4 the number of decisions, next to the overall count, confidences and attacks seen."""
    spark = decisions.sparkSession
    per = decisions.groupBy("response_level").agg(F.count(F.lit(1)).alias("n"))
    overall = decisions.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.array_join(F.sort_array(F.collect_set(F.coalesce("attack_type", F.lit("None")))), ",").alias("attack_types"),
    )
    ladder = dims.levels(spark).select("response_level", "level_label")
    counted = ladder.join(F.broadcast(per), "response_level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.crossJoin(F.broadcast(overall))


def defense_levels(health: DataFrame) -> DataFrame:
    """The five levels with their meaning, the one the mean health calls for marked active, and its label with each."""
    mean = health.agg(F.avg("cyber_health").alias("mean_health"))
    ladder = dims.levels(health.sparkSession).select("response_level", "level_label", "description")
    current = ladder.select(F.col("response_level").alias("current_level"), F.col("level_label").alias("current_label"))
    placed = mean.withColumn("current_level", level_from_mean_health(F.col("mean_health"))).join(F.broadcast(current), "current_level")
    return ladder.crossJoin(F.broadcast(placed)).withColumn("active", (F.col("response_level") == F.col("current_level")).cast("int"))
