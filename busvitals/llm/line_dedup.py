"""Line deduplication by range-partitioned hashes.

Every line becomes one narrow row: a 128-bit hash of its key, the document, the line's number. These rows are dealt out
by *ranges* of (hash, document, line) and sorted so, hence a line that fills a third of the corpus covers several
neighbouring partitions instead of one. Each partition is streamed once with bounded memory: a run of equal hashes is
held only until it is known to be frequent (or to end). The first and the last run of a partition may go on next door;
what is undecided there, and one witness row of each frequent one, is settled by a small aggregation on the hash. No text
is moved for any of this. The result is one compressed bitmap per document, a bit per line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from busvitals.llm.arrow import BATCH_ROWS, batched, portions
from busvitals.llm.text import own_name
from busvitals.sources.scratch import stored

MIN_DOCS = 10  # a line found in so many documents goes
MIN_CHARS = 1  # shorter keys are never counted, in code points
PORTION_BYTES = 4 << 20

LINES = T.StructType([
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", T.LongType()),
    T.StructField("tag", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("first", T.BooleanType()),
    T.StructField("part", T.IntegerType()),
])
ORDER = ("h1", "h2", "doc", "tag", "at", "part")
DECIDED, OPEN = 0, 1
FOUND = T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("at", T.IntegerType()),
    T.StructField("n", T.LongType()),
])
MAPS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType()),
])


def tag(text: Column) -> Column:
    """What tells texts of equal ids apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_key(line: bytes) -> bytes:
    """A line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; both methods know just those ASCII characters."""
    return line.strip().lower()


def line_rows(doc: int | None, tag_: int, text: bytes | None, part: int, min_chars: int) -> Iterator[tuple]:
    """One row per line that counts; ``first`` marks the first line of its key in the document."""
    seen = set()
    for at, line in enumerate((text or b"").split(b"\n")):
        key = line_key(line)
        if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
            continue
        digest = xxhash.xxh3_128_digest(key)
        yield (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True),
               doc, tag_, at, digest not in seen, part)
        seen.add(digest)


def judged(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition: rows of lines to drop (``DECIDED``), and of runs that touch its ends (``OPEN``).

    An open row counts ``n`` documents: those it stands for, or ``min_docs`` at once when its run is frequent already.
    """
    shape = to_arrow_schema(FOUND)

    def out(kind: int, cols: dict[str, np.ndarray], n: np.ndarray | int) -> Iterator[pa.RecordBatch]:
        size = len(cols["at"])
        for a in range(0, size, BATCH_ROWS):
            part = {k: v[a:a + BATCH_ROWS] for k, v in cols.items()}
            m = len(part["at"])
            docs = pa.array(part["doc"], mask=part["none"])
            count = np.full(m, n, np.int64) if np.isscalar(n) else n[a:a + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, kind, np.int8)), pa.array(part["h1"]), pa.array(part["h2"]), docs, pa.array(part["tag"]),
                 pa.array(part["at"]), pa.array(count)], schema=shape)

    def picked(cols: dict[str, np.ndarray], where) -> dict[str, np.ndarray]:
        return {k: v[where] for k, v in cols.items()}

    def same_place(cols: dict[str, np.ndarray], row: dict) -> np.ndarray:
        """Rows at the document and line of ``row``: repeated rows of the input share their decision."""
        return (cols["none"] == row["none"]) & (cols["doc"] == row["doc"]) & (cols["tag"] == row["tag"]) & (cols["at"] == row["at"])

    key, head, at_start, count, held = None, None, True, 0, []  # the run that is still open

    def end(last: bool) -> Iterator[pa.RecordBatch]:
        """The open run ends; ``last`` if the partition does so with it."""
        if key is None or count >= min_docs or not (at_start or last):
            return  # frequent runs have been given out, rare ones inside the partition stay
        for cols in held:
            yield from out(OPEN, cols, cols["first"].astype(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(2)
        cols = {n: batch.column(i).to_numpy() for i, n in enumerate(LINES.names) if n in ("h1", "h2", "tag", "at")}
        cols["none"] = doc.is_null().to_numpy(zero_copy_only=False)
        cols["doc"] = doc.fill_null(0).to_numpy()
        cols["first"] = batch.column(5).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((np.diff(cols["h1"]) != 0) | (np.diff(cols["h2"]) != 0)) + 1
        edges = np.concatenate([[0], cut, [batch.num_rows]])
        inner = np.zeros(batch.num_rows, bool)  # rows of whole runs inside the batch that are frequent
        if len(edges) > 3:
            a, b = edges[1], edges[-2]
            sums = np.add.reduceat(cols["first"][a:b].astype(np.int64), edges[1:-2] - a)
            inner[a:b] = np.repeat(sums >= min_docs, np.diff(edges[1:-1]))
            if keep_first:
                starts = edges[1:-2]
                mine = np.repeat(starts, np.diff(edges[1:-1]))
                alike = np.ones(b - a, bool)
                for n in ("none", "doc", "tag", "at"):
                    alike &= cols[n][a:b] == cols[n][mine]
                inner[a:b] &= ~alike
        if inner.any():
            yield from out(DECIDED, picked(cols, inner), 0)
        for j in sorted({0, len(edges) - 2}):  # the batch's first and last run
            run = picked(cols, slice(edges[j], edges[j + 1]))
            own = (int(run["h1"][0]), int(run["h2"][0]))
            if own != key:
                yield from end(False)
                at_start = key is None
                key, count, held, head = own, 0, [], picked(run, slice(0, 1))
            before, count = count, count + int(run["first"].sum())
            if count < min_docs:
                held.append(run)
                continue
            if before < min_docs:  # frequent from here on: its first row is the witness, kept or not by all partitions together
                yield from out(OPEN, head, min_docs)
            row = {k: v[0] for k, v in head.items()}
            for part in [*held, run]:
                yield from out(DECIDED, picked(part, ~same_place(part, row)), 0)
            held = []
    yield from end(True)


def dropped_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Lines to drop, as ``doc``, ``tag`` (of the text) and ``at`` (from 0): those whose key is found in ``min_docs`` rows
    or more; with ``keep_first`` the corpus's first occurrence, by id (nulls last), text tag and line, stays.

    Every row counts as a document, repeated rows too; they share their decisions. Null and empty texts are one empty
    line, which is never counted while ``min_chars`` is positive. Other columns are not read; an empty table drops nothing.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for batch in (part for whole in batches for part in portions(whole, "text", PORTION_BYTES)):
                for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    yield from line_rows(doc, mark, text.as_py(), part_id, min_chars)

        yield from batched(rows(), LINES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from judged(batches, min_docs, keep_first)

    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), tag(F.col(text_col)).alias("tag"),
        F.col(text_col).cast("string").cast("binary").alias("text"))
    order = [F.col(c).asc_nulls_last() for c in ORDER]
    dealt = slim.mapInArrow(lines, LINES).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(judge, FOUND), "lines")
    edge = found.where(F.col("kind") == OPEN)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "tag", "at")
    frequent = edge.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min(place).alias("least")).where(F.col("n") >= min_docs)
    settled = edge.drop("n").join(frequent, ["h1", "h2"])
    if keep_first:
        settled = settled.where(place != F.col("least"))
    return found.where(F.col("kind") == DECIDED).select("doc", "tag", "at").unionByName(settled.select("doc", "tag", "at"))


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per id and text: ``doc_id``, ``tag``, ``n_lines``, ``n_dropped`` and ``keep``, the compressed bitmap of the
    lines that stay (most significant bit first). Repeated rows have one bitmap together."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    every = docs.select(F.col(id_col).cast("bigint").alias("doc"), tag(F.col(text_col)).alias("tag"),
                        F.lit(None).cast("int").alias("at"), total.alias("n"))
    gone = dropped_lines(docs, min_docs, min_chars, keep_first, id_col, text_col).withColumn("n", F.lit(None).cast("bigint"))
    # a document's line numbers, each once: as long as the document itself
    grouped = every.unionByName(gone).groupBy("doc", "tag").agg(F.max("n").alias("n"), F.collect_set("at").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, mark, n, gone_ in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                    keep = np.ones(n, bool)
                    keep[gone_.values.to_numpy()] = False
                    yield doc, mark, n, n - int(keep.sum()), zlib.compress(np.packbits(keep).tobytes())

        yield from batched(rows(), MAPS, lambda r: 64 + len(r[4]))

    return grouped.mapInArrow(pack, MAPS)


def _cut(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """The input rows joined with their bitmaps; the names of the columns with the bitmap and with the cut text."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        out = []
        for text, keep in zip(texts, keeps):
            lines = text.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
            out.append("\n".join([line for line, stays in zip(lines, bits) if stays]))
        return pd.Series(out, dtype=object)

    held, kept = own_name(docs, "bitmap"), own_name(docs, "kept_text")
    right = bitmaps.select(F.struct(*bitmaps.columns).alias(held))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(held)["doc_id"]) & (tag(F.col(text_col)) == F.col(held)["tag"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut_text = F.when(F.col(held)["n_dropped"] == 0, text).otherwise(cut(text, F.col(held)["keep"]))
    return docs.join(right, same).withColumn(kept, cut_text), held, kept


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_lines``, ``n_dropped`` and ``text`` as its bitmap leaves it (null as empty)."""
    both, held, kept = _cut(docs, bitmaps, id_col, text_col)
    return both.select(F.col(id_col).alias("doc_id"), F.col(held)["n_lines"].alias("n_lines"), F.col(held)["n_dropped"].alias("n_dropped"), F.col(kept).alias("text"))


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The input rows, all columns, without their repeated lines (null texts stay null); ``rule`` as in ``dropped_lines``."""
    both, _, kept = _cut(docs, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **rule), id_col, text_col)
    new = F.when(F.col(text_col).isNotNull(), F.col(kept))
    return both.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
