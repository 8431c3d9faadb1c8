"""Isolation forest: trees grown in parallel on small hashed samples, scoring vectorised and narrow.

Samples and cuts are drawn from digests of the row's key and of (seed, tree, node), so a forest depends on the data alone and
any engine with md5 grows the same one. Nodes are numbered as in a heap: 1 is the root, 2n and 2n + 1 are the children of n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.ordering import attach

TREES = 100
SAMPLE = 256
DIGITS = 9  # of features; what differs by less is rounding noise, which must not open a cut
_HEX = 13
_SPACE = 16**_HEX  # 52 bits, so sums of a hundred strides stay whole numbers
NODES = "tree int, node int, feature int, cut double, depth double"


def fit_forest(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str] = tuple(fv.FEATURES), trees: int = TREES,
    sample: int = SAMPLE, seed: int = fv.SEED,
) -> DataFrame:
    """Node table of all trees (fewer than 4 * sample nodes per tree).

    Each row decides by hash in which trees' samples it may be; only about sample + 10*sqrt(sample) rows per tree are
    shuffled, and the ``sample`` smallest hashes of each tree are used.
    """
    usable = rows.dropna(subset=list(features)).select(*keys, *[F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in features])
    count = usable.agg(F.count(F.lit(1)).alias("_rows"))
    room = sample + 10 * math.sqrt(sample) + 10

    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    start, stride = (F.conv(F.substring(digest, at, _HEX), 16, 10).cast("bigint") for at in (1, 1 + _HEX))

    def draw(tree):
        """One digest per row is enough: the draws of any two trees are independent."""
        return (F.col("_start") + tree * F.col("_stride")) % _SPACE

    member = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t).cast("double") * F.col("_rows") <= F.lit(room * _SPACE)
    )
    drawn = attach(usable.withColumns({"_start": start, "_stride": stride}), count).withColumn("tree", F.explode(member)).withColumn("_d", draw(F.col("tree")))
    first = Window.partitionBy("tree").orderBy("_d", *keys)
    chosen = drawn.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample)
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[names].to_numpy(dtype="float64"), seed, tree)
        return pd.DataFrame(nodes, columns=["node", "feature", "cut", "depth"]).assign(tree=tree)[["tree", "node", "feature", "cut", "depth"]]

    return chosen.select("tree", *names).groupBy("tree").applyInPandas(grow, NODES)


def uniform(seed: int, tree: int, node: int, purpose: str) -> float:
    """A number from 0 to below 1 that belongs to a node."""
    return int(hashlib.md5(f"{seed}|{tree}|{node}|{purpose}".encode()).hexdigest()[:_HEX], 16) / _SPACE


def _grow(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Level by level, random cuts until rows are alone, equal, or log2(n) deep; leaves hold their depth plus the expected rest."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []
    level = {1: np.arange(len(x))}
    for depth in range(limit + 1):
        below = {}
        for node, rows in level.items():
            low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            open_features = np.flatnonzero(high > low)
            if depth == limit or len(rows) <= 1 or not len(open_features):
                nodes.append((node, -1, 0.0, depth + _average_path(len(rows))))
                continue
            f = int(open_features[int(uniform(seed, tree, node, "feature") * len(open_features))])
            cut = float(low[f] + uniform(seed, tree, node, "cut") * (high[f] - low[f]))
            nodes.append((node, f, cut, 0.0))
            below |= {2 * node: rows[x[rows, f] < cut], 2 * node + 1: rows[x[rows, f] >= cut]}
        level = below
    return nodes


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree over n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def score_forest(
    rows: DataFrame, nodes: DataFrame, features: Sequence[str] = tuple(fv.FEATURES), sample: int = SAMPLE,
    out: str = "forest_score",
) -> DataFrame:
    """-2^(-mean depth / expected depth): low = anomalous. The node table has a fixed maximal size and is broadcast."""
    spark: SparkSession = rows.sparkSession
    trees = []
    for _, g in nodes.toPandas().groupby("tree", sort=True):
        tree = {c: np.zeros(g["node"].max() + 1, g[c].dtype) for c in ("feature", "cut", "depth")}
        for c in tree:
            tree[c][g["node"]] = g[c]
        trees.append(tree)
    shared = spark.sparkContext.broadcast(trees)
    norm = _average_path(sample)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for tree in shared.value:
            at = np.ones(len(x), dtype="int64")
            while True:
                f = tree["feature"][at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_right = ~(x[every, np.maximum(f, 0)] < tree["cut"][at])
                at = np.where(inner, 2 * at + goes_right, at)
            total += tree["depth"][at]
        return pd.Series(-(2.0 ** (-(total / len(shared.value)) / norm)))

    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    return rows.withColumn(out, score(*[F.round(F.col(c).cast("double"), DIGITS) for c in features])).withColumn(
        out, F.when(complete, F.col(out))
    )


def isolation_forest(rows: DataFrame, keys: Sequence[str], features: Sequence[str] = tuple(fv.FEATURES), out: str = "forest_score") -> DataFrame:
    """Grown on the normal rows, applied to all."""
    return score_forest(rows, fit_forest(rows.where("attack_label = 0"), keys, features), features, out=out)
