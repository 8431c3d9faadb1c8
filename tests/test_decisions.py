"""Published decisions and stories as golden values, and properties of the scoring."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.functions import scalars as sc
from busvitals.operators import explain as ex, respond as re_
from busvitals.operators.health import health_score

NAMES = [t[0] for t in fv.TRACKED]
# case: health, category, trend, trend size, attack, projected health, z of the tracked features in order
GOLDEN = {
    "normal": (80.61, "Secure", "Degrading", -3.4, "Normal", 82.29, [-0.929, -1.171, -1.421, -0.027, -0.136, 0.02, -0.409]),
    "dos": (22.28, "High Risk", "Stable", 1.86, "DoS", 65.71, [5.831, -2.93, -25.217, 2.82, 0.417, -1.114, -11.273]),
    "fuzzy": (13.45, "Critical", "Degrading", -3.22, "Fuzzy", 64.89, [0.531, 14.657, 12.771, 1.883, 2.798, 5.114, -11.272]),
    "gear": (33.29, "High Risk", "Improving", 2.93, "Gear", 59.55, [5.355, -2.051, -11.005, -2.614, -2.183, -2.575, -10.392]),
    "rpm": (32.46, "High Risk", "Improving", 2.82, "RPM", 63.27, [3.741, -2.93, -12.76, -1.742, -1.481, 0.226, -9.939]),
}
DECISIONS = {"normal": (0, 0.1245, 1), "dos": (2, 0.7378, 4), "fuzzy": (4, 0.9021, 9), "gear": (2, 0.6576, 4), "rpm": (2, 0.6637, 4)}


@pytest.fixture(scope="module")
def told(spark):
    rows = [
        ("v", case, i, 100 + i, attack, health, category, trend, size, projected, *z)
        for i, (case, (health, category, trend, size, attack, projected, z)) in enumerate(GOLDEN.items())
    ]
    names = ", ".join(f"{n} double" for n in NAMES)
    windows = spark.createDataFrame(rows, "vehicle_id string, capture string, w bigint, window_index bigint, attack_type string, "
                                          f"cyber_health double, risk_category string, trend string, trend_diff double, projected_health double, {names}")
    unit = spark.range(1).select(*[F.lit(0.0).alias(f"m_{n}") for n in NAMES], *[F.lit(1.0).alias(f"s_{n}") for n in NAMES])
    return ex.threat_story(ex.root_cause(windows, unit)).persist()


def test_published_decisions(told):
    got = {r["capture"]: r for r in re_.response_decision(told).collect()}
    for case, (level, confidence, n_actions) in DECISIONS.items():
        assert (got[case]["response_level"], got[case]["confidence"], len(got[case]["actions"])) == (level, confidence, n_actions)
    assert got["normal"]["attack_type"] is None and got["normal"]["actions"][0]["id"] == "gen_l0_1"
    assert [a["id"] for a in got["fuzzy"]["actions"]][:4] == ["fz_emer_1", "fz_emer_2", "fz_emer_3", "fz_mon_1"]
    assert [a["id"] for a in got["dos"]["actions"]] == ["dos_cont_1", "dos_cont_2", "dos_mon_1", "dos_alert_1"]


def test_published_root_causes(told):
    got = {r["capture"]: r for r in told.collect()}
    assert (got["normal"]["primary_component"], got["normal"]["primary_feature"]) == ("Stability", "can_id_entropy")
    for case, stability, pressure in (("normal", 0.5272, 1.0), ("dos", 0.0618, 0.6799), ("fuzzy", 0.2675, 0.1801), ("rpm", 0.0855, 0.9943)):
        assert abs(got[case]["stability_health"] - stability) < 2e-4 and abs(got[case]["pressure_health"] - pressure) < 2e-4
    # the runner-up feature may be the primary one itself
    assert got["rpm"]["secondary_feature"] == got["rpm"]["primary_feature"] == "anomaly_score"
    assert got["rpm"]["root_cause_text"].endswith("Secondary feature: overall anomaly signal at -9.9 sigma.")


def test_published_texts(told):
    got = {r["capture"]: r for r in told.collect()}
    assert got["normal"]["narrative"] == (
        "Vehicle cybersecurity status is Secure. No anomalous activity detected. Cyber Health is 81/100 and degrading over the "
        "last 10 windows. All monitoring dimensions show normal behavior.")
    assert "Health has degrading by 3 points over the last 10 windows." in got["fuzzy"]["narrative"]
    assert "outside safe bounds: CAN ID diversity, CAN identifier entropy, message burst activity, timing irregularity, payload variation." in got["fuzzy"]["narrative"]
    assert "Health projected at 66/100 in 20 windows" in got["dos"]["narrative"]


def test_short_alerts(told):
    got = {r["capture"]: r["short_alert"] for r in ex.short_alert(told).collect()}
    assert got["normal"] == "Cyber Health: 81/100 — All clear."
    assert got["gear"].startswith("ALERT: Cyber Health 33/100 — High Risk. overall anomaly signal")
    assert got["fuzzy"].startswith("CRITICAL: Cyber Health 13/100")


def test_story_json_round_trip(told, spark, tmp_path):
    from busvitals.sources.tables import read_stories, write_stories

    write_stories(ex.story_struct(told, "2000-01-01T00:00:00"), str(tmp_path / "s"))
    back = {r["scenario"]: r["story"] for r in read_stories(spark, str(tmp_path / "s"), ex.STORY_SCHEMA).collect()}
    assert back["normal"]["attack_context"] is None
    assert back["fuzzy"]["attack_context"]["attack_info"]["attack_type"] == "Fuzzy"
    assert back["gear"]["root_cause_analysis"]["feature_attributions"]["can_id_entropy"]["z_score"] == -11.005
    assert back["dos"]["root_cause_analysis"]["component_breakdown"]["Threat"] == pytest.approx(0.0006, abs=1e-4)


def test_actions_grow_with_the_level(spark):
    levels = spark.createDataFrame([(a, l) for a in ("DoS", "Fuzzy", "Gear", "RPM", "Other", None) for l in range(5)], "attack_type string, response_level int")
    got = {(r["attack_type"], r["response_level"]): [a["id"] for a in r["actions"]] for r in re_.select_actions(levels).collect()}
    for attack in ("DoS", "Fuzzy", "Gear", "RPM"):
        for level in range(1, 5):
            assert set(got[attack, level]) > set(got[attack, level - 1])
    assert got["Other", 3] == ["gen_l3_1"] and got[None, 0] == ["gen_l0_1"]


def test_safety_notes(spark):
    df = spark.createDataFrame([("Gear", 3), ("RPM", 4), ("DoS", 4), ("Gear", 2), (None, 0), (None, 3)], "attack_type string, response_level int")
    got = {(r["attack_type"], r["response_level"]): r["safety_notes"] for r in re_.outcome_recovery_safety(df).collect()}
    assert got["Gear", 3].endswith("; transmission safety at risk") and got["RPM", 4].endswith("; engine safety at risk")
    assert got["DoS", 4] == "HIGH — vehicle may enter limp-home mode" and got["Gear", 2] == "Minimal — actions are reversible"
    assert got[None, 0] == "No safety impact" and ";" not in got[None, 3]


@pytest.mark.parametrize("value,name", [(100.0, "Secure"), (80.0, "Secure"), (79.99, "Stable"), (60.0, "Stable"), (40.0, "Warning"),
                                        (20.0, "High Risk"), (19.9, "Critical"), (0.0, "Critical")])
def test_category_edges(spark, value, name):
    assert spark.range(1).select(sc.risk_category(F.lit(value))).first()[0] == name


def test_scalar_edges(spark):
    z = spark.createDataFrame([(0.5,), (-0.5,), (0.51,), (-0.51,)], "z double").select(sc.deviation_direction(F.col("z"))).collect()
    assert [r[0] for r in z] == ["within normal range", "within normal range", "above normal", "below normal"]
    d = spark.createDataFrame([(2.0,), (2.1,), (-2.1,), (float("nan"),), (None,)], "d double").select(sc.trend_label(F.col("d"))).collect()
    assert [r[0] for r in d] == ["Stable", "Improving", "Degrading", "Stable", "Stable"]
    t = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.04,)], "x double").select(sc.fixed_text(F.col("x"), 0)).collect()
    assert [r[0] for r in t][:3] == ["0", "2", "2"]
    h = spark.createDataFrame([(i / 4 - 5.0,) for i in range(41)], "z double").select(
        *[sc.healthiness_of_z(F.col("z"), d).alias(d) for d in ("both", "positive", "negative")]).collect()
    assert all(0.0 < v <= 1.0 for r in h for v in r)
    assert [r["positive"] for r in h] == sorted((r["positive"] for r in h), reverse=True)
    assert [r["negative"] for r in h] == sorted(r["negative"] for r in h)
    assert h[0]["both"] == h[-1]["both"] == pytest.approx(math.exp(-4.8 / 1.5))


def test_components_sum_to_health_and_nulls_stay_null(spark):
    columns = [*fv.FEATURES, "anomaly_score"]
    rows = [tuple(float((i * (j + 3)) % 13) for j in range(14)) for i in range(40)] + [tuple([None] + [1.0] * 13)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    base = spark.range(1).select(*[F.lit(5.0).alias(f"m_{c}") for c in columns], *[F.lit(2.0).alias(f"s_{c}") for c in columns])
    got = health_score(df, base).collect()
    for r in got[:-1]:
        assert 0 <= r["cyber_health"] <= 100
        assert r["cyber_health"] == pytest.approx(r["threat_component"] + r["stability_component"] + r["pressure_component"])
    assert got[-1]["cyber_health"] is None and got[-1]["risk_category"] is None


def test_top_driver_ties_are_decided_at_four_digits(spark):
    """3.5001 and 3.5002 deviations both make 0.7000: the first feature wins, as if they were equal."""
    from busvitals.functions import fixed_values as fv
    from busvitals.operators.explain import top_driver

    values = {c: 0.0 for c in fv.FEATURES} | {"messages_per_second": 3.5001, "can_id_entropy": 3.5002}
    window = spark.createDataFrame([("v", "DoS", 0, "DoS", *values.values())], "vehicle_id string, capture string, w bigint, attack_type string, "
                                   + ", ".join(f"{c} double" for c in values))
    baseline = spark.createDataFrame([tuple([0.0] * len(values) + [1.0] * len(values))], ", ".join(
        [f"m_{c} double" for c in values] + [f"s_{c} double" for c in values]))
    row = top_driver(window, baseline).first()
    assert (row.top_driver, row.contribution_pct, row.anomalous_features) == ("messages_per_second", 70.0, 2)


def test_unknown_events_are_not_normal(spark):
    from pyspark.sql import functions as F

    from busvitals.sources.event_frames import frames_from_events, unknown_events

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(5).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "click").otherwise("new kind"))
    rows = frames_from_events(events).collect()
    assert {(r.capture, r.attack_label) for r in rows} == {("Normal", 0), (None, None)}
    assert unknown_events(events).count() == sum(r.capture is None for r in rows)
