"""Exact, linearly interpolated percentiles without bringing a group into one task.

``percentile`` keeps every distinct value of a group in one final aggregation buffer. Here a mergeable sketch only narrows
the search: it gives a value bracket around each wanted rank. Values inside the brackets are counted, the brackets are cut into
blocks, and only the block that holds the rank is looked into. Sketches may be stored when the values are, a few per capture, and
merged to any grouping later; then the values are scanned once, else twice. The rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busvitals.sources.scratch import stored

SIZE = 4_096  # of a sketch
BLOCKS = 1_024  # of a bracket


def rank_error(size: int) -> float:
    """How far, as a share of all ranks, a sketch of this size errs in one of a hundred cases."""
    return 2.296 / size**0.9021


def value_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """One row per group of ``keys``: ``n`` (nulls left out), ``least``, ``most`` and ``sketch`` of its values."""
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of finer groups as those of coarser ones."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], size: int = SIZE, sketches: DataFrame | None = None
) -> DataFrame:
    """One row per group with a DOUBLE column per entry of ``probs`` (name -> probability in [0, 1]).

    Nulls are ignored. ``sketches`` are those of the very rows of ``df``, by ``keys`` or finer, of size ``size``. A bracket is
    four rank errors wide to either side; a rank that still fell outside stops the query instead of giving a wrong number.
    """
    names = list(probs)
    slack = 4.0 * rank_error(size)
    flat = F.array(*[F.lit(p) for n in names for p in (max(0.0, probs[n] - slack), min(1.0, probs[n] + slack))])
    keys = list(keys)
    work = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    work = work if keys else work.withColumn("_all", F.lit(0))
    gkeys = keys or ["_all"]
    if sketches is None:
        sketches = value_sketches(work, gkeys, "_v", size)
    elif not keys:
        sketches = sketches.withColumn("_all", F.lit(0))
    brackets = merged_sketches(sketches, gkeys).select(
        *gkeys, F.col("n").alias("_n"), F.col("least").alias("_min"), F.col("most").alias("_max"), F.kll_sketch_get_quantile_double("sketch", flat).alias("_q"))
    wanted = []
    for i, n in enumerate(names):
        p = probs[n]
        few = F.col("_n") <= size  # small groups are searched whole
        lo = F.when(few | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i])
        hi = F.when(few | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1])
        pos = (F.col("_n") - 1) * F.lit(p)
        wanted.append(
            F.struct(F.lit(n).alias("name"), lo.alias("lo"), hi.alias("hi"), F.floor(pos).alias("r0"),
                     F.ceil(pos).alias("r1"), (pos - F.floor(pos)).alias("frac"))
        )
    # sketches are random: a second evaluation would give other brackets than those that were counted in, so they are stored
    ranks = stored(brackets.select(*gkeys, F.explode(F.array(*wanted)).alias("_w")).select(*gkeys, "_w.*"), "brackets")

    # Below every bracket only a count is needed; inside, one row per distinct value (map-side combined).
    marked = work.join(F.broadcast(ranks.select(*gkeys, "name", "lo", "hi")), gkeys).where(F.col("_v") <= F.col("hi"))
    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
    part = F.coalesce(F.try_divide((F.col("_v") - F.col("lo")) * BLOCKS, F.col("hi") - F.col("lo")), F.lit(0.0))
    block = F.when(F.col("_v") < F.col("lo"), -1).otherwise(F.least(F.floor(part), F.lit(BLOCKS - 1))).cast("int")
    counted = marked.groupBy(*gkeys, "name", inside.alias("_v"), block.alias("_block")).agg(F.count(F.lit(1)).alias("_c"))
    # blocks of a bracket, at most BLOCKS + 1 for each group and rank
    in_order = Window.partitionBy(*gkeys, "name").orderBy("_block")
    blocks = counted.groupBy(*gkeys, "name", "_block").agg(F.sum("_c").alias("_in")).withColumn("_before", F.sum("_in").over(in_order) - F.col("_in"))
    hit = blocks.join(ranks, [*gkeys, "name"]).where((F.col("_before") <= F.col("r1")) & (F.col("_before") + F.col("_in") > F.col("r0")))
    # values of the blocks that hold the ranks
    upto = Window.partitionBy(*gkeys, "name", "_block").orderBy("_v")
    cumulated = counted.where(F.col("_v").isNotNull()).join(hit.drop("lo", "hi"), [*gkeys, "name", "_block"]).withColumn(
        "_cum", F.col("_before") + F.sum("_c").over(upto))
    hits = cumulated.groupBy(*gkeys, "name", "frac", "r0").agg(
        F.min(F.when(F.col("_cum") > F.col("r0"), F.col("_v"))).alias("_v0"),
        F.min(F.when(F.col("_cum") > F.col("r1"), F.col("_v"))).alias("_v1"),
        F.min(F.col("_cum") - F.col("_c")).alias("_below"),
    )
    # a rank below or beyond its bracket has no block
    hits = ranks.select(*gkeys, "name", "frac", "r0").join(hits.drop("frac", "r0"), [*gkeys, "name"], "left")
    checked = F.when(
        F.col("_v0").isNull() | F.col("_v1").isNull() | (F.col("_below") > F.col("r0")),
        F.raise_error(F.lit("percentile rank fell outside the sketch bracket")).cast("double"),
    ).otherwise(F.col("_v0") + F.col("frac") * (F.col("_v1") - F.col("_v0")))
    wide = hits.withColumn("_p", checked).groupBy(*gkeys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in names]
    )
    return wide.select(*keys, *names)
