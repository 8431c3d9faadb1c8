"""Numbering, running totals and neighbourhoods must not depend on how a series is cut."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from busvitals.operators import ordering as o
from busvitals.operators.series import ema_series, recovery_islands, rolling_mean_centered, step_trend, trend_at_window

SMALL = {"block_rows": 50, "max_blocks": 1000}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with two thirds of the rows, many equal times, rows in no order."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(40)).alias("t"),
        F.col("id").alias("seq"),
        (F.pmod(F.hash("id"), F.lit(100))).cast("double").alias("v"),
    ).repartition(5)


def plain(df, keys):
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    return df.withColumns({"rn": F.row_number().over(w).cast("bigint") - 1, "prev": F.lag("t").over(w)})


@pytest.mark.parametrize("keys", [["key"], []])
def test_numbering_equals_plain_window(skewed, keys):
    ours = o.number_rows(skewed, keys, ["t", "seq"], "rn", {"prev": "t"}, **SMALL)
    assert sorted(map(str, ours.select("key", "t", "seq", "v", "rn", "prev").collect())) == sorted(
        map(str, plain(skewed, keys).select("key", "t", "seq", "v", "rn", "prev").collect())
    )


def test_hot_key_is_cut_and_blocks_are_small(skewed):
    sizes = o.ordered_blocks(skewed, ["key"], ["t", "seq"], **SMALL).groupBy("key", "_blk").count().collect()
    hot = [r["count"] for r in sizes if r["key"] == "hot"]
    assert len(hot) > 40 and max(hot) < 800
    calm = o.ordered_blocks(skewed, ["key"], ["t", "seq"], block_rows=1500, max_blocks=1000)
    assert {r["key"] for r in calm.where("_cut").select("key").distinct().collect()} == {"hot"}


def test_one_time_for_everything(spark):
    """Equal times are told apart by the sequence number alone."""
    df = spark.range(3000).select(F.lit("a").alias("key"), F.lit(7).alias("t"), F.col("id").alias("seq"))
    got = o.number_rows(df, ["key"], ["t", "seq"], "rn", **SMALL)
    assert got.where("rn <> seq").count() == 0
    assert o.ordered_blocks(df, ["key"], ["t", "seq"], **SMALL).select("_blk").distinct().count() > 20


def test_counted_rows_take_the_short_way(skewed):
    short = o.number_rows(skewed, ["key"], ["t", "seq"], "rn", {"prev": "t"}, total_rows=6000)
    long = o.number_rows(skewed, ["key"], ["t", "seq"], "rn", {"prev": "t"}, **SMALL)
    assert short.select("seq", "rn", "prev").exceptAll(long.select("seq", "rn", "prev")).count() == 0


def test_running_totals(skewed):
    w = Window.partitionBy("key").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["seq"]: r["s"] for r in skewed.withColumn("s", F.sum("v").over(w)).collect()}
    got = o.running_totals(skewed, ["key"], ["t", "seq"], {"s": "v"}, **SMALL).collect()
    assert len(got) == 6000 and all(abs(r["s"] - want[r["seq"]]) < 1e-6 for r in got)


@pytest.fixture(scope="module")
def series(spark):
    return spark.range(700).select(
        F.when(F.col("id") < 500, "a").otherwise("b").alias("key"),
        F.when(F.col("id") < 500, F.col("id")).otherwise(F.col("id") - 500).alias("i"),
        (F.pmod(F.xxhash64("id"), F.lit(100))).cast("double").alias("v"),
    )


@pytest.mark.parametrize("op", [
    lambda d, b: trend_at_window(d, ["key"], "i", "v", block=b).select("key", "i", "trend", F.round("trend_diff", 9)),
    lambda d, b: ema_series(d, ["key"], "i", "v", block=b).select("key", "i", F.round("ema", 9)),
    lambda d, b: rolling_mean_centered(d, ["key"], "i", "v", 100, block=b).select("key", "i", F.round("rolling_mean", 9)),
    lambda d, b: step_trend(d, ["key"], "i", "v", block=b).select("key", "i", "trend"),
    lambda d, b: recovery_islands(d, ["key"], "i", "v", above=30.0, block=b),
])
def test_blocks_do_not_change_series_results(series, op):
    whole, cut = op(series, 1 << 20), op(series, 64)
    assert whole.count() == cut.count() > 0
    assert whole.exceptAll(cut).count() == 0


def test_steps_are_between_neighbours_only(spark):
    rows = [("a", 0, 50.0), ("a", 1, 90.0), ("a", 2, 20.0), ("a", 4, 80.0), ("a", 5, 80.0), ("b", 3, None), ("b", 4, 7.0)]
    df = spark.createDataFrame(rows, "key string, i bigint, v double")
    got = {(r.key, r.i): r.trend for r in step_trend(df, ["key"], "i", "v", block=2).collect()}
    assert got == {("a", 0): "Stable", ("a", 1): "Improving", ("a", 2): "Degrading", ("a", 4): "Stable", ("a", 5): "Stable",
                   ("b", 3): "Stable", ("b", 4): "Stable"}
    assert step_trend(df.limit(0), ["key"], "i", "v").count() == 0


def test_ema_follows_its_recursion(series):
    rows = sorted(ema_series(series.where("key = 'a'"), ["key"], "i", "v", block=64).collect(), key=lambda r: r["i"])
    level = rows[0]["v"]
    for r in rows[1:]:
        level = 0.3 * r["v"] + 0.7 * level
        assert abs(level - r["ema"]) < 1e-9


def test_run_longer_than_many_blocks(spark):
    df = spark.range(1000).select(F.lit("a").alias("key"), F.col("id").alias("i"), F.when(F.col("id") == 10, 0.0).otherwise(99.0).alias("v"))
    runs = sorted(map(tuple, recovery_islands(df, ["key"], "i", "v", block=16).collect()))
    assert runs == [("a", 0, 9, 10, 2), ("a", 11, 999, 989, 13)]


def test_smoothing_with_a_long_memory(spark):
    """A memory far longer than a block is carried over; checked against the recursion."""
    from busvitals.operators.series import ema_level

    rows = [("a", i, 10.0 if i < 1 else 20.0 + (i * 37 % 11)) for i in range(3_000)] + [("b", i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, i bigint, v double")
    for alpha in (0.001, 0.01, 0.3, 1.0):
        want, level = {}, {}
        for key, i, v in rows:
            level[key] = v if i == 0 else alpha * v + (1 - alpha) * level[key]
            want[key, i] = level[key]
        for block in (64, 5_000):
            got = {(r.key, r.i): r.ema for r in ema_series(df, ["key"], "i", "v", alpha=alpha, block=block).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert all(abs(r.level - level[r.key]) < 1e-9 for r in ema_level(df, ["key"], "i", "v", alpha=alpha).collect())


def test_short_series_have_no_trend(spark):
    rows = [("a", i, 90.0 - 3 * i) for i in range(15)] + [("b", i, 90.0 - 3 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, i bigint, v double")
    got = {(r.key, r.i): (r.trend, r.trend_diff) for r in trend_at_window(df, ["key"], "i", "v").collect()}
    assert all(got["a", i] == ("Stable", 0.0) for i in range(15))
    assert got["b", 19][0] == "Degrading"
