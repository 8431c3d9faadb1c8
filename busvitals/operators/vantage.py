"""Nearest neighbours in a vantage-point tree of bounded size, and the local outlier factor against it.

The tree holds the training draw (at most ``MAX_TRAIN_ROWS`` windows), so it fits every task; windows are scored where they
lie. A node splits its rows by their distance to one of them, inside the median or outside; the triangle inequality rules out
a side whose rows must all be farther than the k-th neighbour found so far. A batch of queries goes down together: the
nearer side first, then those queries that the other side may still serve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.kernel import scaler
from busvitals.operators.neighbors import KEY, _distances
from busvitals.operators.sampling import subsample_normal

LEAF = 96
NEIGHBOURS = 20
AT_ONCE = 1_024
TINY = 1e-10


@dataclass(frozen=True)
class Tree:
    """Points in a fixed order and the nodes over them: a leaf has ``rows``; an inner node its vantage point, the largest and
    least distances of its rows inside and outside, and two children. ``owner`` numbers the names of points, if these repeat."""

    points: np.ndarray
    nodes: list[tuple]
    owner: np.ndarray | None = None

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF, most: int | None = None, owner: np.ndarray | None = None) -> "Tree":
        """The vantage point of a node is its row farthest from its first one, so trees of equal points are equal.

        Of equal points only the first ``most`` are kept, if given: as many as are ever asked for, and those left out with a query.
        """
        nodes: list[tuple] = []

        def grow(rows: np.ndarray) -> int:
            here = len(nodes)
            nodes.append(())
            gaps = _distances(points[rows[:1]], points[rows])[0]
            if len(rows) <= leaf or not gaps.max() > 0:  # a node of equal rows stays whole
                nodes[here] = (rows if gaps.max() > 0 else rows[:most],)
                return here
            vantage = int(rows[gaps.argmax()])
            away = _distances(points[[vantage]], points[rows])[0]
            cut = np.median(away)
            inside = away <= cut
            if inside.all():
                inside = away < cut
            bounds = (away[inside].min(), away[inside].max(), away[~inside].min(), away[~inside].max())
            nodes[here] = (vantage, bounds, grow(rows[inside]), grow(rows[~inside]))
            return here

        if len(points):
            grow(np.arange(len(points)))
        return cls(points, nodes, owner)

    def nearest(self, asked: np.ndarray, k: int, itself: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the ``k`` nearest points of each query, ties to the smaller number, inf and -1 where there
        are fewer. ``itself`` names the point that is the query (-1: none), which is left out; with ``owner``, all points of it."""
        n = len(asked)
        best = np.full((n, k), np.inf)
        which = np.full((n, k), -1, np.int64)
        itself = np.full(n, -1) if itself is None else itself

        def offer(queries: np.ndarray, rows: np.ndarray) -> None:
            d = _distances(asked[queries], self.points[rows])
            owners = rows if self.owner is None else self.owner[rows]
            d[itself[queries][:, None] == owners[None, :]] = np.inf
            some = (d <= best[queries, -1:]).any(axis=1) & np.isfinite(d).any(axis=1)
            queries, d = queries[some], d[some]
            both = np.concatenate([best[queries], d], axis=1)
            names = np.concatenate([which[queries], np.broadcast_to(rows, d.shape)], axis=1)
            order = np.lexsort((np.where(np.isfinite(both), names, np.iinfo(np.int64).max), both), axis=1)[:, :k]
            best[queries] = np.take_along_axis(both, order, axis=1)
            which[queries] = np.where(np.isfinite(best[queries]), np.take_along_axis(names, order, axis=1), -1)

        def visit(node: int, queries: np.ndarray) -> None:
            if not len(queries):
                return
            if len(self.nodes[node]) == 1:
                offer(queries, self.nodes[node][0])
                return
            vantage, (near_in, far_in, near_out, far_out), inner, outer = self.nodes[node]
            d = _distances(asked[queries], self.points[[vantage]])[:, 0]
            # least distance that a row of either side can have
            from_in = np.maximum(np.maximum(near_in - d, d - far_in), 0.0)
            from_out = np.maximum(np.maximum(near_out - d, d - far_out), 0.0)
            inside = from_in <= from_out
            for first, then, group, bound in ((inner, outer, inside, from_out), (outer, inner, ~inside, from_in)):
                own = queries[group]
                visit(first, own)
                visit(then, own[bound[group] <= best[own, -1] * (1 + 1e-9) + 1e-12])

        if self.nodes:
            visit(0, np.arange(n))
        return best, which


@dataclass(frozen=True)
class OutlierModel:
    """Scaler, tree over the training draw, and each training row's name, k-distance and density."""

    mean: np.ndarray
    std: np.ndarray
    names: np.ndarray
    tree: Tree
    k: int
    k_distance: np.ndarray
    density: np.ndarray

    def densities(self, x: np.ndarray, itself: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Density of rows, and the neighbours that it is taken over."""
        far, near = self.tree.nearest(x, self.k, itself)
        reach = np.where(near >= 0, np.maximum(far, self.k_distance[near]), 0.0).sum(axis=1)
        some = (near >= 0).any(axis=1)
        out = np.full(len(x), np.nan)
        out[some] = 1.0 / (reach[some] / (near[some] >= 0).sum(axis=1) + TINY)
        return out, near

    def factors(self, names: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Local outlier factors; nan for rows with a missing feature or no neighbour."""
        out = np.full(len(x), np.nan)
        whole = np.flatnonzero(~np.isnan(x).any(axis=1))
        place = np.searchsorted(self.names, names[whole])
        place = np.minimum(place, len(self.names) - 1)
        itself = np.where(self.names[place] == names[whole], place, -1)
        for a in range(0, len(whole), AT_ONCE):
            rows = whole[a : a + AT_ONCE]
            own, near = self.densities((x[rows] - self.mean) / self.std, itself[a : a + AT_ONCE])
            around = np.where(near >= 0, self.density[near], 0.0).sum(axis=1)
            some = ~np.isnan(own)
            out[rows[some]] = around[some] / (near[some] >= 0).sum(axis=1) / own[some]
        return out


def row_name() -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in KEY])


def fit_lof(windows: DataFrame, k: int = NEIGHBOURS) -> OutlierModel:
    """A model of the training draw. Fitting is an action: the draw, and so the model, has a fixed maximal size."""
    mean, std = scaler(windows)
    drawn = subsample_normal(windows).select(row_name().alias("name"), *fv.FEATURES).toPandas()
    if not len(drawn):
        raise ValueError("no complete normal windows to fit on")
    # by name in byte order, which is what ties are decided by
    drawn = drawn.loc[sorted(drawn.index, key=lambda i: drawn["name"][i].encode())].drop_duplicates("name")
    points = (drawn[list(fv.FEATURES)].to_numpy(dtype="float64") - mean) / std
    tree = Tree.over(points)
    far, near = tree.nearest(points, k, np.arange(len(points)))
    k_distance = np.where(near >= 0, far, -np.inf).max(axis=1)
    names = np.array([n.encode() for n in drawn["name"]], dtype=object)
    raw = OutlierModel(mean, std, names, tree, k, k_distance, np.zeros(len(points)))
    density, _ = raw.densities(points, np.arange(len(points)))
    return OutlierModel(mean, std, names, tree, k, k_distance, density)


def lof_score(windows: DataFrame, model: OutlierModel, out: str = "lof") -> DataFrame:
    """Local outlier factor of every window against the model (about 1 inside, larger outside, null for incomplete windows).

    Density of a row = 1 / mean reachability distance to its neighbours; the factor compares it with theirs. Narrow.
    """
    shared = windows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def factor(name: pd.Series, *features: pd.Series) -> pd.Series:
        names = np.array([n.encode() for n in name], dtype=object)
        return pd.Series(shared.value.factors(names, np.column_stack([f.to_numpy(dtype="float64") for f in features])))

    scored = windows.withColumn(out, factor(row_name(), *[F.col(c) for c in fv.FEATURES]))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))
