"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources get shares of all words by weight, none more than ``most_copies`` times what it has; what a source
cannot take is shared again by weight. The result is found in one pass over the sources: with r = cap / weight and the
sources in the order of r, the first k are full where the level (rest of the words / rest of the weights) reaches r.

Sampling: the expected copies of each document are prefix-summed within its source, one random offset per source is
added, and a document is emitted once per integer boundary crossed. Expected copies are whole numbers of 10^-12, so sums
are exact and do not depend on the order of addition. Documents are visited in the order of their size (up in one block,
down in the next), so what one document is rounded up the next of nearly the same size is rounded down, and the words
taken come close to the target. A source is cut into blocks by a hash of the document, each block sums for itself and
inherits one carried number, so no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busvitals.llm.text import word_count

MOST_COPIES = 3
UNIT = 10**12
BLOCK_ROWS = 2_000  # at least so many documents of a source in a block, if it has them
WEIGHTS = (1, 2, 3)
SEED = "mix"

_DEC = "decimal(38,0)"


def _hash(*parts: Column | str) -> Column:
    """The first 32 bits of an MD5, as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """Targets of sources from one row per source (``source``, ``source_size``, ``n_docs``).

    Adds ``weight`` (by the sources' order, null last, repeating), ``target`` (double) and ``expected``, the expected
    copies of each of the source's documents in units of 10^-12. The windows run over one row per source, not over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fullest = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = fullest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = sizes.select(
        "*", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
        .cast("bigint").alias("weight"),
    ).withColumn("_cap", F.col("source_size") * most_copies)
    # what is left, and among what weights, before and after this source is full
    levels = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.sum("_cap").over(full) + F.col("_cap")).alias("_left"),
        (F.sum("weight").over(everything) - F.sum("weight").over(full) + F.col("weight")).alias("_among"),
    )
    # full if its cap is not above its share of what is left; once one is not full, none after it is
    open_ = levels.withColumn("_open", F.col("_cap").cast(_DEC) * F.col("_among") > F.col("_left").cast(_DEC) * F.col("weight"))
    first = open_.withColumn("_at", F.when(F.col("_open"), F.struct("_left", "_among"))).withColumn(
        "_level", F.first("_at", ignorenulls=True).over(fullest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level_left, level_among = F.col("_level")["_left"], F.col("_level")["_among"]
    share = level_left.cast(_DEC) * F.col("weight")
    return first.select(
        "source", "source_size", "n_docs", "weight",
        F.when(F.col("_open"), level_left.cast("double") * F.col("weight") / level_among)
        .otherwise(F.col("_cap").cast("double")).alias("target"),
        F.when(F.col("source_size") == 0, F.lit(0).cast("bigint"))
        .when(F.col("_open"), F.expr(f"(cast(_level._left as {_DEC}) * weight * {UNIT}L) div (cast(_level._among as {_DEC}) * source_size)"))
        .otherwise(F.lit(most_copies * UNIT)).cast("bigint").alias("expected"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", size_col: str | None = None, seed: str = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The input rows, with ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to ``most_copies``) added.

    Sizes are counted from ``text_col``, or taken from ``size_col``. An input column of such a name is replaced. Null and empty texts have size 0; a null source is a source of its own, the
    last; a null id counts as -1 in the order; repeated rows are sampled each, and equal rows may swap their copies; an empty
    table stays empty. Reruns agree, as offsets and blocks come from hashes.
    """
    size = word_count(F.col(text_col)) if size_col is None else F.col(size_col).cast("bigint")
    sized = docs.withColumn("size", size).drop("source_size", "target", "copies")
    slim_source = F.col(source_col)
    stats = sized.groupBy(slim_source.alias("source")).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = source_targets(stats, weights, most_copies).select(
        F.col("source").alias("_source"), "source_size", "target", F.col("expected").alias("_expected"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(
            F.col("n_docs") / F.greatest(F.lit(block_rows).cast("double"), 10 * F.sqrt("n_docs")))).alias("_blocks"),
        F.pmod(_hash(F.lit(seed), F.coalesce("source", F.lit("\0"))) * F.lit(UNIT // 2**32), F.lit(UNIT)).alias("_offset"),
    )
    # Spark broadcasts the sources' rows if they are small, else splits the skewed side of the join
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1))
    joined = sized.join(plan, slim_source.eqNullSafe(F.col("_source"))).withColumn(
        "_block", F.pmod(_hash(F.lit(seed), key.cast("string")), F.col("_blocks")))
    carried = joined.groupBy("_source", "_block").agg(F.sum("_expected").alias("_total")).select(
        F.col("_source").alias("_s"), F.col("_block").alias("_b"),
        F.coalesce(F.sum(F.col("_total").cast(_DEC)).over(
            Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_DEC)).alias("_carry"),
    )
    up = F.when(F.pmod("_block", F.lit(2)) == 0, F.col("size")).otherwise(-F.col("size"))
    inside = Window.partitionBy("_source", "_block").orderBy("_up", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = joined.withColumn("_up", up).withColumn("_key", key).withColumn("_inside", F.sum("_expected").over(inside))
    end = (F.col("_carry") + F.col("_offset") + F.col("_inside")).cast(_DEC)
    copies = F.expr(f"(_end div {UNIT}L) - ((_end - _expected) div {UNIT}L)").cast("bigint")
    return (
        summed.join(carried, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        .withColumn("_end", end).withColumn("copies", copies)
        .drop("_source", "_s", "_b", "_block", "_blocks", "_expected", "_offset", "_up", "_key", "_inside", "_carry", "_end")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every input row as many times as it is taken, with the columns of the input."""
    plain = docs.columns
    taken = mix(docs.select(F.struct("*").alias("_row"), *[F.col(how.get(k, d)).alias(d) for k, d in (
        ("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))]), **{
        k: v for k, v in how.items() if k not in ("id_col", "source_col", "text_col")})
    return taken.where("copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*[F.col("_row")[c].alias(c) for c in plain])
