"""Ordered work over series that may be far larger than one task.

A plain window partitioned by the series key puts a whole series into one task. Two ways around that are
used throughout the package, both exact and both pure functions of the data (no partition ids, no sampling
that could differ between two evaluations of the same plan):

* ``ordered_blocks`` cuts every over-long series into contiguous blocks at split points taken from a
  hash-selected subset of its own sort keys. The split points only steer balance; numbering, lags and running
  totals are made whole again with one carried row per block.
* ``halo_blocks`` is for series that already have a dense integer position: block = position div size, and each
  block also receives the few neighbours its frames need.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2_000_000  # rows aimed at in one ordered block
MAX_BLOCKS = 20_000  # bound on split points, and so on every table broadcast here

_ALL = "_all"
_BLK = "_blk"
_SPLITS = "_splits"


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (broadcast of a single row)."""
    return df.crossJoin(F.broadcast(one_row))


def _split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int, max_blocks: int) -> DataFrame:
    """Per over-long series one row with its sorted split points.

    A series is cut only if it exceeds two blocks, so at most total/step series and about total/step split
    points exist, and step >= total/max_blocks. A series with a null key is never cut.
    """
    # stating the null check lets both uses of the counts share one exchange
    keyed = df.where(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    hot = (
        attach(sizes, total)
        .withColumn("_step", F.greatest(F.lit(block_rows).cast("bigint"), F.ceil(F.col("_total") / F.lit(max_blocks))))
        .where(F.col("_n") > 2 * F.col("_step"))
        .select(*keys, "_step")
    )
    chosen = (
        df.select(*keys, *order)
        .join(F.broadcast(hot), list(keys))
        .where(F.pmod(F.xxhash64(*keys, *order), F.col("_step")) == 0)
    )
    return chosen.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*order))).alias(_SPLITS))


def _splits_at_or_below(splits: Column, point: Column, max_blocks: int) -> Column:
    """Binary search inside the split array; runs only for rows of series that were cut."""
    steps = math.ceil(math.log2(8 * max_blocks))

    def halve(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.shiftright(lo + hi, 1)
        return (
            F.when(lo >= hi, state)
            .when(F.get(splits, mid) <= point, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def ordered_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Add ``_blk`` (position-preserving block inside the series) and ``_cut`` (series has several blocks)."""
    splits = _split_points(df, keys, order, block_rows, max_blocks)
    joined = df.join(F.broadcast(splits), list(keys), "left")
    block = _splits_at_or_below(F.col(_SPLITS), F.struct(*order), max_blocks)
    return (
        joined.withColumn("_cut", F.col(_SPLITS).isNotNull())
        .withColumn(_BLK, F.when(F.col("_cut"), block).otherwise(F.lit(0)))
        .drop(_SPLITS)
    )


def _carried(blocked: DataFrame, keys: Sequence[str], totals: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """What each block of a cut series inherits from the blocks before it (at most a few rows per split)."""
    per_block = blocked.where("_cut").groupBy(*keys, _BLK).agg(
        *[c.alias(n) for n, c in totals.items()], *[c.alias(n) for n, c in lasts.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys,
        _BLK,
        *[F.sum(n).over(before).alias(n) for n in totals],
        *[F.last(n).over(before).alias(n) for n in lasts],
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    previous: dict[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
    max_blocks: int = MAX_BLOCKS,
    total_rows: int | None = None,
) -> DataFrame:
    """0-based row number inside each series, plus optional previous-row values ``{new column: source column}``.

    ``order`` must identify a row inside its series. One shuffle of the rows, on (keys, block). A caller that has
    counted the rows passes ``total_rows``: if they all fit two blocks, no series can need cutting.
    """
    keys = list(keys)
    work = df if keys else df.withColumn(_ALL, F.lit(0))
    keys = keys or [_ALL]
    previous = previous or {}
    if total_rows is not None and total_rows <= 2 * block_rows:
        whole = Window.partitionBy(*keys).orderBy(*order)
        numbered = work.withColumn(out, F.row_number().over(whole).cast("bigint") - 1)
        for n, src in previous.items():
            numbered = numbered.withColumn(n, F.lag(src).over(whole))
        return numbered.drop(_ALL)
    blocked = ordered_blocks(work, keys, order, block_rows, max_blocks)
    carried = _carried(
        blocked,
        keys,
        {"_before": F.count(F.lit(1))},
        # the leading sort column ends a block at its maximum; only other columns need the whole sort key
        {f"_last_{n}": F.max(src) if src == order[0] else F.max_by(src, F.struct(*order)) for n, src in previous.items()},
    )
    inside = Window.partitionBy(*keys, _BLK).orderBy(*order)
    numbered = blocked.join(F.broadcast(carried), [*keys, _BLK], "left").withColumn(
        out, F.row_number().over(inside).cast("bigint") - 1 + F.coalesce(F.col("_before"), F.lit(0))
    )
    for n, src in previous.items():
        numbered = numbered.withColumn(n, F.coalesce(F.lag(src).over(inside), F.col(f"_last_{n}")))
    return numbered.drop(_BLK, "_cut", "_before", _ALL, *[f"_last_{n}" for n in previous])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    block_rows: int = BLOCK_ROWS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Inclusive running sums ``{new column: source column}`` along the order, over all blocks of a series."""
    keys = list(keys)
    work = df if keys else df.withColumn(_ALL, F.lit(0))
    keys = keys or [_ALL]
    blocked = ordered_blocks(work, keys, order, block_rows, max_blocks)
    carried = _carried(blocked, keys, {f"_before_{n}": F.sum(src) for n, src in sums.items()}, {})
    upto = Window.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(F.broadcast(carried), [*keys, _BLK], "left")
    for n, src in sums.items():
        out = out.withColumn(n, F.sum(src).over(upto) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)))
    return out.drop(_BLK, "_cut", _ALL, *[f"_before_{n}" for n in sums])


def halo_blocks(df: DataFrame, position: str, behind: int, ahead: int = 0, block: int = 65_536) -> DataFrame:
    """Cut a densely numbered series into blocks that carry their neighbours.

    Each row goes to its own block and, if it lies within ``behind`` rows before the next block (or ``ahead`` rows
    after the previous one), there as well. ``_own`` marks the row in its own block; filter on it after the
    window functions. Copies are at most (behind + ahead) / block of the rows.
    """
    own = F.floor(F.col(position) / block)
    targets = F.sequence(
        F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(position) - ahead) / block)),
        F.floor((F.col(position) + behind) / block),
    )
    return df.withColumn(_BLK, F.explode(targets)).withColumn("_own", F.col(_BLK) == own)


def halo_window(keys: Sequence[str], position: str) -> Window:
    """The window spec that matches ``halo_blocks``."""
    return Window.partitionBy(*keys, _BLK).orderBy(position)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the neighbour copies made by ``halo_blocks``."""
    return df.where("_own").drop("_own", _BLK)
