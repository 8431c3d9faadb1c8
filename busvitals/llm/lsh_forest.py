"""Nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long string of bits, the sides of random hyperplanes it lies on, and keeps its strings sorted, so
the rows that share a prefix are one interval of the array. A query descends in every tree to its longest matching prefix.
Then all trees ascend together, one bit at a time, until the intervals of that prefix length hold enough candidates; these
are compared exactly. How long the prefix is therefore depends on how crowded the place is.

The forest is sharded: rows go to shards of about ``SHARD_ROWS`` by a hash of their id, each shard sorts its own strings, and
blocks of queries visit every shard; the nearest of each shard are merged. Every row is indexed. Equal vectors are found
together or not at all and only those of the smallest ids can be among the nearest, so a shard keeps ``k + 1`` of them, and
equal queries are searched once: a vector that a third of the rows share costs no more than another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.sources.scratch import stored

NEAREST = 5
TREES = 64
STRING_BITS = 32
SHARD_ROWS = 12_000
QUERY_ROWS = 4_000
SEED = 11
#: Candidates per tree: CROWD * rows ** GROWTH. Measured for recall of 0.95 and more on unstructured 64-dimensional vectors.
CROWD, GROWTH = 0.17, 0.72

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` (doubles) of the rows that take part: an id, and a vector that is finite and not zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, wide)


class Forest:
    """Sorted strings of some vectors, one array per tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, keep: int, seed: int) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1)))
        begins = np.flatnonzero(new)
        nth = np.arange(len(ids)) - np.repeat(begins, np.diff(begins, append=len(ids)))
        self.ids, self.vectors = ids[nth < keep], vectors[nth < keep]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.planes = np.random.Generator(np.random.PCG64([seed, vectors.shape[1]])).standard_normal((trees, vectors.shape[1], STRING_BITS))
        self.order, self.strings = [], []
        for plane in self.planes:
            s = self._string(self.vectors, plane)
            o = np.argsort(s, kind="stable")
            self.order.append(o)
            self.strings.append(s[o])

    @staticmethod
    def _string(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
        bits = (vectors @ plane > 0).astype(np.uint64)
        return (bits << np.arange(STRING_BITS, dtype=np.uint64)[::-1]).sum(1, dtype=np.uint64)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows of the longest common prefix length at which all trees together hold enough."""
        asked = [self._string(queries, plane) for plane in self.planes]
        todo = np.arange(len(queries))
        for free in range(STRING_BITS + 1):  # descend to whole strings, then ascend in all trees at once
            if not len(todo):
                return
            low, high = [], []
            for s, q in zip(self.strings, asked):
                first = q[todo] >> np.uint64(free) << np.uint64(free)
                low.append(np.searchsorted(s, first))
                high.append(np.searchsorted(s, first + (np.uint64(1) << np.uint64(free))))
            low, high = np.array(low), np.array(high)
            full = (high - low).sum(0) >= enough
            if free == STRING_BITS:
                full[:] = True
            for k in np.flatnonzero(full):
                seen = np.zeros(len(self.ids), bool)
                for o, a, b in zip(self.order, low[:, k], high[:, k]):
                    seen[o[a:b]] = True
                yield todo[k], np.flatnonzero(seen)
            todo = todo[~full]

    def nearest(self, queries: np.ndarray, k: int, enough: int):
        """(query number, ids, scores) of the k nearest candidates, ties to the smaller id."""
        for at, rows in self.candidates(queries, enough):
            q = queries[at]
            score = (self.vectors[rows] * q).sum(1) / (self.norms[rows] * math.sqrt((q * q).sum()))
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield at, self.ids[rows[best]], score[best]


def enough_candidates(rows: int, trees: int) -> int:
    """Candidates at which the ascent ends, all trees counted."""
    return math.ceil(trees * CROWD * rows**GROWTH)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, trees: int = TREES, shard_rows: int = SHARD_ROWS, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine of the original vectors in doubles): each query's k nearest
    found, itself left out; ties go to the smaller id.

    Both inputs have the id and vector columns. Rows without an id, and vectors that are null, empty, zero, or hold a null or a
    non-finite component take no part, as candidate or as query; vectors only meet vectors of their own length; rows with the
    query's own id are never its neighbours; repeated rows are candidates each; a query with fewer candidates gets all; other columns
    are not read; empty tables give an empty result.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = stored(usable(queries, id_col, vector_col), "queries")
    distinct = stored(asked.groupBy("v").agg(F.min("vec_id").alias("query_id")), "distinct-queries")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(distinct.count() / QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), every(blocks).alias("block"), F.size("v").alias("wide"), "vec_id", "v")
    right = distinct.select(every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.size("v").alias("wide"), "query_id", "v")

    def visit(own: pa.Table, asked_: pa.Table) -> pa.Table:
        out = ([], [], [])
        if own.num_rows and asked_.num_rows:
            wide = own.column("wide")[0].as_py()
            forest = Forest(own.column("vec_id").to_numpy(), _matrix(own.column("v"), wide), trees, k + 1, seed)
            names = asked_.column("query_id").to_numpy()
            for at, ids, scores in forest.nearest(_matrix(asked_.column("v"), wide), k + 1, enough_candidates(len(forest.ids), trees)):
                out[0].append(np.full(len(ids), names[at]))
                out[1].append(ids)
                out[2].append(scores)
        whole = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": pa.array(whole[0], pa.int64()), "vec_id": pa.array(whole[1], pa.int64()), "score": pa.array(whole[2], pa.float64())})

    keys = ("shard", "block", "wide")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(visit, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    few = stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "nearest")
    # equal queries share what was found; each leaves itself out
    named = stored(asked.join(distinct.withColumnRenamed("query_id", "same"), "v").select("vec_id", "same").distinct(), "named-queries")
    own = named.select(F.col("vec_id").alias("query_id"), "same").join(few.withColumnRenamed("query_id", "same"), "same").where("vec_id <> query_id")
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
