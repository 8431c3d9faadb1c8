"""Rows to record batches of bounded size, for operators that stream through ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_BYTES = 4 << 20
BATCH_ROWS = 20_000


def batched(rows: Iterable[tuple], schema: T.StructType, weigh: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES`` by ``weigh``, at most ``BATCH_ROWS`` rows each."""
    shape = to_arrow_schema(schema)
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), shape.types)], schema=shape)

    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def portions(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``most_bytes`` each (at least one row)."""
    texts = batch.column(batch.schema.get_field_index(column))
    begin = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)
