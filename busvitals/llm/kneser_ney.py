"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are UTF-16 code units of the lower-cased text with white space runs as one space, four to a gram, so a gram is one
64-bit number and every count table a narrow table of numbers. Counts come from all trusted text. Lower orders count
distinct continuations; discounts of grams seen once, twice and more follow from the counts of counts.

The corpus's distinct grams are joined with the count tables of every order, which are sharded by gram and by context, and so
become one table of logarithms. It is cut by hash into shards of at most ``SHARD_GRAMS`` grams; each shard is broadcast, its size
being bounded by that cut, and adds up its grams of every document where the text lies. So texts are never shuffled for scoring,
and a larger model only means more shards.

Documents above their language's limit go: a quantile of the trusted documents' perplexity in that language, plus a share of
its distance from the median (short texts scatter).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.sources.scratch import stored

ORDER = 4
SHARD_GRAMS = 2_000_000  # of 12 bytes: the bound on what is broadcast at once
MOST_IDS = 2_000_000  # trusted ids that are broadcast; more are joined by a shuffle
QUANTILE = 0.99
SLACK = 2.0
MIN_TRUSTED = 50  # trusted documents a language needs for a limit of its own
BINS = 1_000  # of log-perplexity per unit, for exact quantiles from bounded counts
UNITS = 1 << 16

GRAMS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
PARTIAL = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text_hash", T.LongType()),
    T.StructField("n_grams", T.LongType()), T.StructField("minus", T.DoubleType())])
_SPACE = re.compile(r"\s+")
PART = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """The grams of a text as unsigned numbers, one per symbol; three marks stand before the text."""
    line = _SPACE.sub(" ", text or "").strip().lower()
    if not line:
        return np.empty(0, np.uint64)
    u = np.frombuffer(("\x02" * (ORDER - 1) + line).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    g = u[: len(u) - ORDER + 1]
    for k in range(1, ORDER):
        g = g << np.uint64(16) | u[k:len(u) - ORDER + 1 + k]
    return g


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts and how often each occurs, a bounded number of grams at a time."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    held, size = [], 0

    def fold() -> None:
        nonlocal keys, counts, held, size
        k, n = np.unique(np.concatenate(held), return_counts=True)
        every = np.concatenate((keys, k))
        keys, where = np.unique(every, return_inverse=True)
        counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        held, size = [], 0

    for text in texts:
        g = grams(text)
        if len(g):
            held.append(g)
            size += len(g)
            if size >= PART:
                fold()
    if held:
        fold()
    return keys, counts


def gram_counts(trusted: DataFrame) -> DataFrame:
    """``gram``, ``n`` of the highest order over all trusted texts (column ``text``)."""

    def run(batches):
        for batch in batches:
            keys, counts = _counted(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    return trusted.select("text").mapInArrow(run, GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))


def _last(gram, units: int):
    return gram.bitwiseAND(F.lit((1 << 16 * units) - 1))


def order_tables(top: DataFrame) -> list[tuple[DataFrame, DataFrame, tuple[float, float, float]]]:
    """For each order from 1: counts (``gram``, ``n``), contexts (``context``, ``total``, ``back``), discounts.

    Below the highest order ``n`` is the number of different symbols before the gram.
    """
    counts, levels = stored(top, "grams4"), []
    for order in range(ORDER, 0, -1):
        seen = {r["n"]: r["c"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        d = discounts(*[seen.get(k, 0) for k in (1, 2, 3, 4)])
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("bigint")
        weight = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        contexts = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(weight).alias("back"))
        levels.append((counts, stored(contexts, f"contexts{order}"), d))
        if order > 1:
            counts = stored(counts.groupBy(_last(F.col("gram"), order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{order - 1}")
    return levels[::-1]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more; plain values where the counts of counts give none."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(k, max(0.1, d)) for k, d in zip((0.95, 1.9, 2.8), raw))


def log_probabilities(asked: DataFrame, levels: list[tuple[DataFrame, DataFrame, tuple[float, float, float]]]) -> DataFrame:
    """``gram``, ``lp``: the natural logarithm of a gram's last symbol given those before, for distinct grams."""
    out, p = asked.select("gram"), F.lit(1.0 / UNITS)
    for order, (counts, contexts, d) in enumerate(levels, 1):
        gram = _last(F.col("gram"), order) if order < ORDER else F.col("gram")
        context = F.shiftrightunsigned(gram, 16) if order > 1 else F.lit(0).cast("bigint")
        out = (
            out.withColumn("_g", gram).withColumn("_c", context)
            .join(counts.select(F.col("gram").alias("_g"), F.col("n").alias("_n")), "_g", "left")
            .join(contexts.select(F.col("context").alias("_c"), "total", "back"), "_c", "left")
        )
        cut = F.when(F.col("_n") == 1, d[0]).when(F.col("_n") == 2, d[1]).otherwise(d[2])
        own = F.coalesce(F.col("_n") - cut, F.lit(0.0))
        lower = p if order == 1 else F.col("_p")
        out = out.withColumn("_q", F.when(F.col("total").isNull(), lower).otherwise((own + F.col("back") * lower) / F.col("total")))
        out = out.select("gram", F.col("_q").alias("_p"))
    return out.select("gram", F.log("_p").alias("lp"))


def corpus_grams(docs: DataFrame) -> DataFrame:
    """The distinct grams of all texts (column ``text``)."""

    def run(batches):
        for batch in batches:
            keys, _ = _counted(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.ones(len(keys), np.int64))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, GRAMS).select("gram").distinct()


def perplexities(docs: DataFrame, probabilities: DataFrame, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``doc_id``, ``lang``, ``n_grams``, ``log_ppl`` (mean negative log-probability of a symbol; 0 if none) of every row."""
    spark = docs.sparkSession
    shards = max(1, math.ceil(1.1 * probabilities.count() / shard_grams))
    slim = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "text")

    def part(number: int) -> DataFrame:
        own = probabilities.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == number).toArrow()
        keys, lp = own.column("gram").to_numpy(), own.column("lp").to_numpy()
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], lp[order].astype(np.float64)))

        def run(batches):
            keys, lp = held.value
            for batch in batches:
                n, minus = [], []
                for text in batch.column(3):
                    g = grams(text.as_py()).view(np.int64)
                    if shards > 1:  # only this shard's grams are here
                        at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                        here = keys[at] == g if len(keys) else np.zeros(len(g), bool)
                        at = at[here]
                    else:
                        at = np.searchsorted(keys, g)
                    n.append(len(at))
                    minus.append(-float(lp[at].sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(minus, pa.float64())], names=PARTIAL.names)

        return slim.mapInArrow(run, PARTIAL)

    mean = lambda n, minus: F.when(F.col(n) > 0, F.col(minus) / F.col(n)).otherwise(F.lit(0.0))
    if shards == 1:
        return part(0).select("doc_id", "lang", "n_grams", mean("n_grams", "minus").alias("log_ppl"))
    sums = None
    for number in range(shards):
        one = stored(part(number), "partial")
        sums = one if sums is None else sums.unionByName(one)
    # equal rows are summed together; their mean is the same, and their number is how often the shards saw them
    whole = sums.groupBy("doc_id", "lang", "text_hash").agg(
        F.sum("n_grams").alias("n"), F.sum("minus").alias("minus"), (F.count(F.lit(1)) / shards).cast("bigint").alias("rows"))
    return whole.select(
        "doc_id", "lang", (F.col("n") / F.col("rows")).cast("bigint").alias("n_grams"), mean("n", "minus").alias("log_ppl"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_row")).drop("_row")


def limits(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, min_trusted: int = MIN_TRUSTED) -> DataFrame:
    """``lang`` (null: all together), ``limit``: exact quantiles of the trusted documents from counts by narrow bins."""
    bins = scored.where("trusted and n_grams > 0").select("lang", F.round(F.col("log_ppl") * BINS).cast("bigint").alias("bin"))
    counts = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where("lang is not null").unionByName(counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n"))
    up = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = counts.withColumn("below", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("below") >= F.col("all") * q, F.col("bin"))) / F.lit(float(BINS))
    return below.where((F.col("all") >= min_trusted) | F.col("lang").isNull()).groupBy("lang").agg(at(0.5).alias("mid"), at(quantile).alias("high")).select(
        "lang", (F.col("high") + slack * (F.col("high") - F.col("mid"))).alias("limit"))


def quality(
    docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", shard_grams: int = SHARD_GRAMS,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``lang``, ``n_grams``, ``log_ppl``, ``perplexity`` (per symbol), ``limit`` (of
    log_ppl) and ``kept``.

    ``trusted``: one column ``doc_id``, the ids of documents whose text the model is trained on. Null and empty texts have no
    grams and are not kept; a null or rare language takes the limit of all trusted documents together; null ids are never trusted;
    repeated rows count and are scored each; other columns are not read; without trusted text nothing can be told, and all texts
    with words are kept (limit null). An empty table gives an empty result.
    """
    ids = trusted.select(F.col("doc_id").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = stored(ids, "trusted")
    few = F.broadcast(ids) if ids.count() <= MOST_IDS else ids  # 8 bytes each
    levels = order_tables(gram_counts(slim.join(few, F.col("doc_id") == F.col("_t"), "left_semi")))
    probabilities = stored(log_probabilities(corpus_grams(slim), levels), "probabilities")
    scored = stored(perplexities(slim, probabilities, shard_grams), "perplexities").join(
        ids, F.col("doc_id") == F.col("_t"), "left").withColumn("trusted", F.col("_t").isNotNull())
    by_lang = stored(limits(scored, quantile, slack), "limits")
    general = by_lang.where("lang is null").agg(F.max("limit").alias("_all"))  # one row, also of an empty table
    own = by_lang.where("lang is not null").select(F.col("lang").alias("_l"), F.col("limit").alias("_own"))
    limit = F.coalesce("_own", "_all")
    return (
        scored.join(own, F.col("lang") == F.col("_l"), "left").crossJoin(F.broadcast(general))
        .select("doc_id", "lang", "n_grams", "log_ppl", F.exp("log_ppl").alias("perplexity"), limit.alias("limit"),
                ((F.col("n_grams") > 0) & F.coalesce(F.col("log_ppl") <= limit, F.lit(True))).alias("kept"))
    )
