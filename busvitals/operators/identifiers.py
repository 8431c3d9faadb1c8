"""Which identifiers talk, and how often: deviation from normal shares, and distinct ones from stored sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.frames import SERIES

LOG_SIZE = 14  # of a sketch: 2 ** 14 registers


def normal_id_shares(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each identifier in normal traffic, over all (default) or per vehicle: ``can_id``, ``share``. One row per identifier."""
    counts = frames.where("attack_label = 0 AND can_id IS NOT NULL").groupBy(*by, "can_id").agg(F.count(F.lit(1)).alias("_c"))
    if by:
        return counts.join(counts.groupBy(*by).agg(F.sum("_c").alias("_n")), list(by)).select(*by, "can_id", (F.col("_c") / F.col("_n")).alias("share"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_n")))).select("can_id", (F.col("_c") / F.col("_n")).alias("share"))


def id_frequency_deviation(framed: DataFrame, shares: DataFrame, size: int = fv.WINDOW_SIZE, by: Sequence[str] = ()) -> DataFrame:
    """Per full window, how far the identifiers' frequencies are from normal ones: ``id_deviation``, the total-variation
    distance (0 = as normal, 1 = nothing in common), ``unseen_ids`` and ``unseen_frames``, identifiers that normal traffic does
    not have and their frames, and ``loudest_id``, the one most above its share (smallest on ties).

    ``framed`` carries ``w``. Frames without an identifier are nobody's and count as unseen. Identifiers missing from the window
    need no rows: what the present ones leave of the shares is theirs.
    """
    key = [*SERIES, "w"]
    counts = framed.groupBy(*key, "can_id").agg(F.count(F.lit(1)).alias("_c"))
    joined = counts.join(shares, [*by, "can_id"], "left")
    share, part = F.coalesce("share", F.lit(0.0)), F.col("_c") / F.lit(float(size))
    above = F.round(part - share, 9)
    return joined.groupBy(*key).agg(
        F.sum("_c").alias("_n"),
        ((F.sum(F.abs(part - share)) + F.lit(1.0) - F.sum(share)) / 2).alias("id_deviation"),
        F.count_if(F.col("share").isNull()).alias("unseen_ids"),
        F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("_c"))), F.lit(0).cast("bigint")).alias("unseen_frames"),
        F.min_by("can_id", F.struct((-above).alias("a"), F.col("can_id").alias("b"))).alias("loudest_id"),
    ).where(F.col("_n") == size).drop("_n")


def id_sketches(frames: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """One row per series, to be stored when its capture is: number of frames and a sketch of its identifiers."""
    return frames.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("frames"), F.hll_sketch_agg("can_id", log_size).alias("ids"))


def unique_ids(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frames and distinct identifiers of any grouping of captures, from their sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("frames").alias("frames"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("unique_ids"))


def estimate_error(log_size: int = LOG_SIZE) -> float:
    """Three standard errors of an estimate, as a share of it."""
    return 3 * 1.04 / 2 ** (log_size / 2)
