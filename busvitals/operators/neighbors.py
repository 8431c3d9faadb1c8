"""Exact k-nearest-neighbour join.

No all-pairs join: train rows are assigned to their nearest pivot and, inside that cell, to a ring of distances to the
pivot. For every query row the ring counts give an upper bound on its k-th distance, and the triangle inequality then
rules out all rings that cannot hold a neighbour. What is left is matched block by block: rings are cut into blocks of
bounded size on both sides, so a crowded ring becomes many small groups and no row is dropped. A block's train rows are
searched by a vantage-point tree. In many dimensions few rings are ruled out, and a query row is copied once for each ring
that is left; so rings are as large as a task holds with ease, and the tree rules out what lies far inside of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.baseline import standard_scale
from busvitals.operators.sampling import sample_rows

PIVOTS = 256
RINGS = 16
ROWS_PER_RING = 50_000
BLOCK_TRAIN = 50_000
BLOCK_QUERY = 20_000
AT_ONCE = 256
KEY = ["vehicle_id", "capture", "w"]


def as_points(windows: DataFrame, features: Sequence[str] = tuple(fv.FEATURES)) -> DataFrame:
    """(pid, x): a text key and the scaled feature vector of every complete window."""
    pid = F.concat_ws("|", *[F.col(k).cast("string") for k in KEY])
    return standard_scale(windows).dropna(subset=list(features)).select(*KEY, "attack_label", pid.alias("pid"), F.array(*features).alias("x"))


def knn_join(queries: DataFrame, train: DataFrame, k: int, rows_per_ring: int = ROWS_PER_RING,
             block_train: int = BLOCK_TRAIN, block_query: int = BLOCK_QUERY) -> DataFrame:
    """(pid, rank, neighbour, distance): the k nearest train rows of each query row, never itself. Both are (pid, x).

    Pivots and rings grow with the train table up to 256 x 16; beyond that the rings hold more rows.
    """
    spark = queries.sparkSession
    n_train = train.count()
    if not n_train:
        raise ValueError("no train rows")
    n_rings = max(1, min(RINGS, n_train // rows_per_ring))
    n_pivots = max(1, min(PIVOTS, n_train // (rows_per_ring * n_rings)))
    anchors = sample_rows(train.select("pid", "x"), ["pid"], n_pivots).select("x").collect()
    pivot = spark.sparkContext.broadcast(np.array([r["x"] for r in anchors]))

    @F.pandas_udf("struct<cell: int, dist: double>")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = _distances(np.array(x.tolist()), pivot.value)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": d[np.arange(len(d)), cell]})

    celled = train.select("pid", "x", nearest("x").alias("_n")).select("pid", "x", "_n.*")
    radius = celled.groupBy("cell").agg(F.max("dist").alias("radius"))
    share = F.coalesce(F.try_divide(F.col("dist") * n_rings, F.col("radius")), F.lit(0.0))
    ringed = celled.join(F.broadcast(radius), "cell").withColumn(
        "ring", F.col("cell") * n_rings + F.least(F.floor(share).cast("int"), F.lit(n_rings - 1))
    )
    # at most pivots x RINGS rows, whatever the size of the train table
    summary = ringed.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")
    ).orderBy("ring").collect()
    rings = spark.sparkContext.broadcast(
        {
            "cell": np.array([r["cell"] for r in summary]),
            "ring": np.array([r["ring"] for r in summary], dtype="int32"),
            "n": np.array([r["n"] for r in summary]),
            "near": np.array([r["near"] for r in summary]),
            "far": np.array([r["far"] for r in summary]),
        }
    )
    wanted = k + 1  # a query row may itself be among the counted train rows

    @F.pandas_udf("array<int>")
    def reachable(x: pd.Series) -> pd.Series:
        r = rings.value
        found: list[np.ndarray] = []
        points = np.array(x.tolist())
        for start in range(0, len(points), AT_ONCE):
            to_pivot = _distances(points[start : start + AT_ONCE], pivot.value)[:, r["cell"]]
            upper = to_pivot + r["far"]
            order = np.argsort(upper, axis=1)
            counted = np.cumsum(r["n"][order], axis=1)
            enough = (counted >= wanted).argmax(axis=1)
            enough[counted[:, -1] < wanted] = len(r["ring"]) - 1
            bound = np.take_along_axis(upper, order, axis=1)[np.arange(len(order)), enough]
            slack = bound * 1e-12 + 1e-12
            lower = np.maximum(r["near"] - to_pivot, to_pivot - r["far"])
            found += [r["ring"][row] for row in lower <= (bound + slack)[:, None]]
        return pd.Series(found)

    asked = queries.select("pid", "x").withColumn("ring", F.explode(reachable("x")))
    load = asked.groupBy("ring").agg(F.count(F.lit(1)).alias("_q"))
    sizes = spark.createDataFrame([(int(r["ring"]), int(r["n"])) for r in summary], "ring int, _t long")
    cuts = sizes.join(load, "ring").select(
        "ring",
        F.ceil(F.col("_t") / block_train).cast("int").alias("_nt"),
        F.ceil(F.col("_q") / block_query).cast("int").alias("_nq"),
    )
    block = ["ring", "bt", "bq"]
    own = F.pmod(F.xxhash64("pid"), F.col("_nt")).cast("int")
    train_side = ringed.join(F.broadcast(cuts), "ring").select(
        F.col("ring").alias("t_ring"), own.alias("t_bt"), F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("t_bq"),
        F.col("pid").alias("neighbour"), F.col("x").alias("at"),
    )
    own_q = F.pmod(F.xxhash64("pid"), F.col("_nq")).cast("int")
    query_side = asked.join(F.broadcast(cuts), "ring").select(
        "ring", F.explode(F.sequence(F.lit(0), F.col("_nt") - 1)).alias("bt"), own_q.alias("bq"), "pid", "x"
    )

    def match(_: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        from busvitals.operators.vantage import Tree  # which takes this module's distances

        if not len(q) or not len(t):
            return pd.DataFrame({"pid": [], "neighbour": [], "distance": []})
        vectors = np.array(t["at"].tolist())
        order = t["neighbour"].reset_index(drop=True).sort_values(kind="stable").index.to_numpy()
        order = order[np.isfinite(vectors[order]).all(axis=1)]  # what has no distance is nobody's neighbour
        if not len(order):
            return pd.DataFrame({"pid": [], "neighbour": [], "distance": []})
        names, vectors = t["neighbour"].to_numpy()[order], vectors[order]
        number, name = pd.factorize(names, use_na_sentinel=False)  # rows of one name are one point's
        tree = Tree.over(vectors, most=k + int(np.bincount(number).max()), owner=number)
        itself = pd.Index(name).get_indexer(q["pid"])
        found: dict[str, list[np.ndarray]] = {"pid": [], "neighbour": [], "distance": []}
        for start in range(0, len(q), AT_ONCE):
            part = q.iloc[start : start + AT_ONCE]
            distance, best = tree.nearest(np.array(part["x"].tolist()), k, itself[start : start + AT_ONCE])
            usable = best >= 0
            found["pid"].append(np.repeat(part["pid"].to_numpy(), usable.sum(axis=1)))
            found["neighbour"].append(names[best[usable]])
            found["distance"].append(distance[usable])
        return pd.DataFrame({c: np.concatenate(v) for c, v in found.items()})

    candidates = (
        query_side.groupBy(*block).cogroup(train_side.groupBy(*[f"t_{b}" for b in block]))
        .applyInPandas(match, "pid string, neighbour string, distance double")
    )
    nearest_first = Window.partitionBy("pid").orderBy("distance", "neighbour")
    return candidates.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select(
        "pid", "rank", "neighbour", "distance"
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences (no cancellation), in slices of bounded size."""
    result = np.empty((len(a), len(b)))
    step = max(1, 500_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        result[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return result
