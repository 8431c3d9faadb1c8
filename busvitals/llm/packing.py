"""Packing by concatenating and cutting.

All documents' tokens, each document followed by an end token, form one long stream that is cut every ``length`` tokens.
Pass one encodes each text once and writes the tokens with the document's offset inside its partition; the partitions'
token totals, one row per partition, are prefix-summed to global offsets. Pass two adds the two offsets and cuts. A
document that crosses a cut leaves one piece on either side (the boundary records), so nothing is ever gathered: not a
document, not a sequence, not the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.llm.tokens import VOCABULARY, ids, packed
from busvitals.sources.scratch import fresh_path

LENGTH = 1024
END_ID = 0

TOKENS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenized(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> DataFrame:
    """Stored table of every document's tokens with its token offset inside its partition.

    ``part`` names the partition in which the row was encoded. It is only meaningful because the rows are written once
    and read back: a task that is run again writes all its rows again, under the same number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ids(vocabulary), packed([end_id])

        def rows() -> Iterator[tuple]:
            part, before = TaskContext.get().partitionId(), 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = packed(encoder.encode(text.as_py() or "")) + end
                    yield part, before, doc, len(found) // 4, found
                    before += len(found) // 4

        yield from batched(rows(), TOKENS, lambda r: len(r[4]))

    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    path = fresh_path(spark, "tokens")
    slim.mapInArrow(run, TOKENS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


def pack(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` in its document, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``
    in the sequence, and ``ids`` (little-endian unsigned 32-bit). Every sequence but the last is full.

    Null and empty texts are one end token; null ids stay null; repeated rows are packed each; other columns are not
    read; an empty table has no pieces. Long texts become many pieces.
    """
    stored = tokenized(docs, id_col, text_col, vocabulary, end_id)
    # one row per partition of pass one, as many as one stage has tasks (Spark's own limits keep that far below 10^6),
    # whatever the number of documents: 16 bytes each, so the broadcast is bounded
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, held, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    whole = held.as_py()
                    n, start = len(whole) // 4, 0
                    while start < n:
                        sequence, offset = divmod(at + start, length)
                        size = min(length - offset, n - start)
                        yield doc, start, size, n, sequence, offset, whole[4 * start:4 * (start + size)]
                        start += size

        yield from batched(rows(), PIECES, lambda r: len(r[6]) + 64)

    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from their pieces: ``sequence_id``, ``n_tokens``, ``ids``. A sequence has a fixed size, so each
    group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )
