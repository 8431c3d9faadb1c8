from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from busvitals.operators.quantiles import exact_percentiles, value_sketches
from busvitals.operators.sampling import sample_rows

PROBS = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p75": 0.75, "p100": 1.0}


@pytest.mark.parametrize("n,distinct", [(1, 1), (2, 2), (41, 41), (5000, 5000), (5000, 3), (5000, 400)])
@pytest.mark.parametrize("size", [4_096, 200])
def test_equal_to_linear_interpolation(spark, n, distinct, size):
    values = np.random.default_rng(n + distinct).permutation(np.arange(n) % distinct * 1.7 - 3.0)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_percentiles(df, [], "v", PROBS, size=size).first()
    for name, p in PROBS.items():
        assert abs(got[name] - np.percentile(values, 100 * p)) < 1e-9


def test_groups_nulls_and_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 4, 4000)] + [("cold", float(v)) for v in rng.normal(size=7)]
    df = spark.createDataFrame(rows + [("hot", None), ("cold", None)], "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", PROBS, size=100).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v in rows if k == g]
        for name, p in PROBS.items():
            assert np.isclose(got[g][name], np.percentile(values, 100 * p), rtol=1e-12)


def test_stored_sketches_of_finer_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{i % 7}", "ab"[i % 7 > 3], float(v)) for i, v in enumerate(rng.lognormal(0, 2, 6000))]
    df = spark.createDataFrame(rows, "capture string, g string, v double").persist()
    sketches = value_sketches(df, ["capture", "g"], "v", 100).persist()
    assert sketches.count() == 7
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", PROBS, size=100, sketches=sketches).collect()}
    whole = exact_percentiles(df, [], "v", PROBS, size=100, sketches=sketches).first()
    for name, p in PROBS.items():
        assert np.isclose(whole[name], np.percentile([r[2] for r in rows], 100 * p), rtol=1e-12)
        for g in "ab":
            assert np.isclose(got[g][name], np.percentile([r[2] for r in rows if r[1] == g], 100 * p), rtol=1e-12)


def test_rank_outside_its_bracket_stops(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    wrong = value_sketches(df.where("v < 100 OR v > 4990").union(df.where("v > 4990")), [], "v", 50).withColumn("n", F.lit(5000).cast("bigint"))
    with pytest.raises(Exception, match="outside the sketch bracket"):
        exact_percentiles(df, [], "v", {"p": 0.5}, size=50, sketches=wrong).collect()


def test_draw_is_exact_and_independent_of_partitions(spark):
    df = spark.range(20_000).withColumn("k", F.col("id"))
    a = sample_rows(df.repartition(3), ["k"], 500)
    b = sample_rows(df.repartition(17), ["k"], 500)
    assert a.count() == 500 and a.exceptAll(b).count() == 0
    assert sample_rows(df.limit(20), ["k"], 500).count() == 20
