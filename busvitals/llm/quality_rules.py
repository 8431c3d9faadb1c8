"""Quality rules: repetition and length rules, then compression bands.

A text's zstandard ratio (raw bytes / compressed bytes) grows with its length, so every length has its own band of
accepted ratios: below it the text is incompressible (keys, encoded data, noise), above it repetitive (boilerplate,
symbol padding). The same test runs on chunks, with the limits of the chunk's length, so that a junk stretch inside a text
counts as well: chunks are at most half as long as the text, if it is long enough, and the last one ends where the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.llm.text import WHITE, byte_words

SYMBOLS = "#*$%&|<>"
#: (from this many bytes on, least ratio, greatest ratio) of whole texts; linear in the logarithm of the length between.
WHOLE_BANDS = ((128, 1.05, 1.90), (256, 1.15, 2.02), (512, 1.22, 2.10), (1024, 1.32, 2.19), (2048, 1.42, 2.30),
               (4096, 1.50, 2.41), (8192, 1.55, 2.50), (16384, 1.60, 2.57), (32768, 1.60, 2.63), (131072, 1.60, 3.00))
#: (bytes, least ratio, greatest ratio) of a chunk: what all 3,054 labelled-good texts of sf0.1 have that pass the other rules,
#: with a hundredth to both sides; and the share of a text's chunks that may lie outside.
CHUNK_BANDS = ((512, 1.38, 1.94), (1024, 1.64, 2.03), (2048, 1.87, 2.16), (4096, 2.05, 2.28))
CHUNK_SHARE = 0.05
LEVEL = 3


@dataclass(frozen=True)
class Limits:
    """All parameters of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    whole: tuple[tuple[float, float, float], ...] = WHOLE_BANDS
    chunks: tuple[tuple[int, float, float], ...] = CHUNK_BANDS
    chunk_share: float = CHUNK_SHARE
    level: int = LEVEL


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()),
    T.StructField("n_chunks_outside", T.LongType()),
])


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window whose words occur as such a window at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds = len(seen)
    # number the pairs first, so that a window is one integer without overflow
    _, pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:n - 2 + shift] |= twice
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def within(size: int, ratio: float, bands: tuple[tuple[float, float, float], ...]) -> bool:
    """Is the ratio accepted at this length? Texts shorter than the first band are."""
    if size < bands[0][0]:
        return True
    at = np.log([b[0] for b in bands])
    low = np.interp(np.log(size), at, [b[1] for b in bands])
    high = np.interp(np.log(size), at, [b[2] for b in bands])
    return bool(low <= ratio <= high)


def chunks_of(raw: bytes, bands: tuple[tuple[int, float, float], ...]) -> tuple[list[bytes], float, float]:
    """The chunks of a text, all of one length, and their limits; no chunks if it is shorter than the least length."""
    size, low, high = max((b for b in bands if 2 * b[0] <= len(raw)), default=bands[0])
    chunks = [raw[k:k + size] for k in range(0, len(raw) - size + 1, size)]
    if chunks and len(raw) % size:
        chunks.append(raw[-size:])
    return chunks, low, high


def judge(text: str | None, squeeze: zstandard.ZstdCompressor, limits: Limits) -> tuple:
    """Counts and verdict of one whole text, in the order of ``SCHEMA`` without the id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = byte_words(text)
    n, repeats = len(words), repeat_words(words)
    failed = n < limits.min_words or 100 * repeats > limits.max_repeat_percent * n
    ratio = len(raw) / len(squeeze.compress(raw)) if raw else 0.0
    chunks, low, high = chunks_of(raw, limits.chunks)
    outside = sum(not low <= len(c) / len(squeeze.compress(c)) <= high for c in chunks)
    kept = not failed and within(len(raw), ratio, limits.whole) and outside <= limits.chunk_share * len(chunks)
    return (
        n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats,
        failed, kept, ratio, len(chunks), outside,
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base counts, ``base_failed``, the compression figures and ``kept``.

    A narrow pass over whole texts, no shuffle. Null and empty texts have no words, so ``base_failed`` is true; a null id
    stays null; repeated rows are judged each; other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=limits.level)
        rows = ((i, *judge(t.as_py(), squeeze, limits))
                for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1)))
        yield from batched(rows, SCHEMA)

    slim = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, SCHEMA)


def kept_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The input rows, all columns, that the rules keep: the same judgement as a vectorised filter, so rows with equal
    or null ids are judged by their own text."""

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=limits.level)
        at = SCHEMA.names.index("kept") - 1
        return pd.Series([judge(t, squeeze, limits)[at] for t in texts], dtype=bool)

    return docs.where(passes(F.col(text_col).cast("string")))
