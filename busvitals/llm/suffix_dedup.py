"""Removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler order.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. The strings that several
documents share are found as suffix-array intervals: suffixes with a common prefix stand together, and prefixing a byte
(backward extension) carries each interval of common prefix L to intervals of L + 1 by one stable counting sort by the
preceding byte, the LF step of the transform. Going breadth first, common prefixes come in increasing value; intervals
left with one suffix are dropped, and the walk stops at ``length``.

One transform of the whole corpus would need all of it in one place, so the corpus is cut into shards that hold together
every string that can be equal:

1. Anchors. Each string of ``length`` bytes has an anchor, its 16-byte piece of least hash (the first on ties). Equal
   strings have equal anchors at equal offsets. Consecutive strings mostly share theirs, so there is one anchor per 17
   bytes. Only anchors that occur in two documents or more can carry shared strings. Their hashes are compared in packed
   blocks: a task keeps what it can decide itself (anchors seen in two of its documents) and sends one witness pair for
   them, so an anchor that a third of all documents share does not fill one task.
2. Contexts. For a shared anchor, its document's stretch of strings that own it. Equal stretches are folded where they lie;
   one representative goes to the anchor's shard. Of anchors with very many occurrences the stretch is cut to single
   strings, dealt by their own hash: what surrounds a common passage differs in every document and would else meet in one
   shard.
3. Expansion in each shard, of about ``SHARD_BYTES`` of text's worth of anchors. Equal contexts from several tasks are folded
   again before it.
4. The found runs go back to their documents and are merged and cut out.

Hashes only route. What is removed is decided by the bytes (except that contexts of one task are folded by equality, which
is the same).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched, portions
from busvitals.llm.text import own_name
from busvitals.sources.scratch import stored

LENGTH = 50
ANCHOR = 16
SHARD_BYTES = 4 << 20
PORTION_BYTES = 6 << 20  # of texts that a task works on at a time
PIECE = 1 << 20  # strings of a long text whose anchors are sought at a time
HOT_ROWS = 5_000  # occurrences from which an anchor's strings are dealt one by one
MOST_HOT = 1_000_000  # such anchors at most: the bound on what the driver gets and sends (8 bytes each)
START = 8  # bytes of the first intervals, sorted as one number
LAST = (1 << 63) - 1
#: Keys from here on stand for null ids, told apart by a hash of the text so that their rows need not meet. All of them have
#: this one rank, after every id below.
NULLS = LAST - (1 << 40) + 1

BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.BinaryType())])
SHARED = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("hot", T.LongType())])
RUNS = T.StructType([T.StructField("key", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
KEPT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])

ASK, KNOWN, TEXT, RUN = 0, 1, 2, 3
_TAG_BITS, _OFF_BITS, _N_BITS = 20, 6, 6

#: Odd multipliers and byte values of the anchors' hash, made from a fixed seed.
_RNG = np.random.Generator(np.random.PCG64(50))
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64)
_MUL = _RNG.integers(0, 1 << 63, 8, np.uint64) | np.uint64(1)


def _join_hash(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    h = left * _MUL[step] + right
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of each 16-byte piece, by doubling."""
    h, size, step = _BYTE[text], 1, 0
    while size < ANCHOR:
        h = _join_hash(h[:-size], h[size:], step)
        size, step = 2 * size, step + 1
    return h * _MUL[7]


def hashes_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same hash for some places only."""
    h, step = _BYTE[text[at[:, None] + np.arange(ANCHOR)]], 0
    while h.shape[1] > 1:
        h = _join_hash(h[:, 0::2], h[:, 1::2], step)
        step += 1
    return h[:, 0] * _MUL[7]


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text of at least ``length`` bytes: hash, first owning string, number of owning strings, offset in it."""
    h = gram_hashes(text)
    wide = length - ANCHOR + 1
    n = len(h) - wide + 1
    value, least, size = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * size <= wide:
        least = np.where(value[:-size] <= value[size:], least[:-size], least[size:])
        value, size = np.minimum(value[:-size], value[size:]), 2 * size
    last = slice(wide - size, wide - size + n)
    own = np.where(value[:n] <= value[last], least[:n], least[last])
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return h[own[first]], first, np.diff(first, append=n), own[first] - first


def _route(h: np.ndarray, bits: int) -> np.ndarray:
    """Shards of anchors. An anchor is the least hash of its string, so the hash is mixed again to be even."""
    return ((h ^ (h >> np.uint64(32))) * _MUL[6] >> np.uint64(64 - bits)).astype(np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.uint32(len(arrays[0])).tobytes(), *[a.tobytes() for a in arrays]]))


def _unpack(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def _by_part(part: np.ndarray, arrays: list[np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    begins = _runs_of(part)
    for a, b in zip(begins, np.append(begins[1:], len(part))):
        yield int(part[a]), kind, _pack([x[a:b] for x in arrays])


def anchor_blocks(keys: list[int], texts: list[bytes], length: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed anchors of some documents. Those that two of the documents share are known to be shared: they skip the
    question, and only the first and last document go along as witnesses, with the number they stand for."""
    found = []
    for key, text in zip(keys, texts):
        if len(text) >= length:
            tag = zlib.crc32(text) & (1 << _TAG_BITS) - 1
            raw = np.frombuffer(text, np.uint8)
            for begin in range(0, len(text) - length + 1, PIECE):
                h, first, n, off = anchors(raw[begin:begin + PIECE + length - 1], length)
                at = ((first.astype(np.int64) + begin << _N_BITS | n) << _OFF_BITS | off) << _TAG_BITS | tag
                found.append((h, np.full(len(h), key, np.int64), at))
    if not found:
        return
    h, key, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, h))
    h, key, at = h[order], key[order], at[order]
    begins = _runs_of(h)
    times = np.diff(begins, append=len(h))
    ends = begins + times - 1
    several = key[begins] < np.minimum(key[ends], NULLS)
    alone = ~np.repeat(several, times)
    part = _route(h, bits)
    witness = np.concatenate((begins[several], ends[several]))
    asked = np.concatenate((np.flatnonzero(alone), witness))
    place = np.concatenate((at[alone], np.full(len(witness), -1)))
    count = np.concatenate((np.ones(int(alone.sum()), np.uint32), (times[several] - 1).astype(np.uint32), np.ones(int(several.sum()), np.uint32)))
    yield from _by_part(part[asked], [h[asked], key[asked], place, count], ASK)
    known = ~alone
    yield from _by_part((key[known] * 40_503 >> 4) % (1 << bits), [key[known], at[known]], KNOWN)


def shared_anchors(blocks: list[tuple[int, bytes]], hot_rows: int) -> Iterator[tuple[int, int, int | None]]:
    """(key, place, None) of anchors that stand in two documents or more, (None, None, hash) of the very common ones."""
    for kind, block in blocks:
        if kind == KNOWN:
            key, at = _unpack(block, ("i8", "i8"))
            yield from zip(key.tolist(), at.tolist(), [None] * len(key))
    asks = [_unpack(b, ("u8", "i8", "i8", "u4")) for kind, b in blocks if kind == ASK]
    if not asks:
        return
    h, key, at, count = (np.concatenate(x) for x in zip(*asks))
    order = np.argsort(h, kind="stable")
    h, key, at, count = h[order], key[order], at[order], count[order]
    begins = _runs_of(h)
    shared = np.minimum.reduceat(key, begins) < np.minimum(np.maximum.reduceat(key, begins), NULLS)
    hot = np.add.reduceat(count.astype(np.int64), begins) >= hot_rows
    out = np.repeat(shared, np.diff(begins, append=len(h))) & (at >= 0)
    yield from zip(key[out].tolist(), at[out].tolist(), [None] * int(out.sum()))
    yield from ((None, None, x) for x in h[begins[shared & hot]].view(np.int64).tolist())


def context_blocks(
    keys: list[int], texts: list[bytes], places: list[list[int]], hot: frozenset[int], length: int, bits: int
) -> Iterator[tuple[int, int, bytes]]:
    """Contexts of shared anchors, packed by shard; runs that equal ones of a smaller document right here are done at once."""
    groups: dict[bytes, list[tuple[int, int, int]]] = {}
    routes: dict[bytes, int] = {}
    for key, text, own in zip(keys, texts, places):
        at = np.unique(np.array(own, np.int64))
        tag = zlib.crc32(text) & (1 << _TAG_BITS) - 1
        at = at[(at & (1 << _TAG_BITS) - 1) == tag] >> _TAG_BITS  # another row of this id may have another text
        off, n, first = at & (1 << _OFF_BITS) - 1, at >> _OFF_BITS & (1 << _N_BITS) - 1, at >> _OFF_BITS + _N_BITS
        ok = first + n + length - 1 <= len(text)
        off, n, first = off[ok], n[ok], first[ok]
        if not len(off):
            continue
        h = hashes_at(np.frombuffer(text, np.uint8), first + off)
        route = _route(h, bits).tolist()
        for f, m, r, x in zip(first.tolist(), n.tolist(), route, h.view(np.int64).tolist()):
            if x in hot:
                for k in range(f, f + m):
                    piece = text[k:k + length]
                    groups.setdefault(piece, []).append((key, tag, k))
                    routes[piece] = zlib.crc32(piece) >> 32 - bits
            else:
                piece = text[f:f + m + length - 1]
                groups.setdefault(piece, []).append((key, tag, f))
                routes[piece] = r
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    piece_of, key_of, tag_of, first_of = [], [], [], []
    for piece, members in groups.items():
        least = min(members)[0]
        for key, tag, first in members:
            if least < min(key, NULLS):
                runs.setdefault((key, tag), []).append((first, first + len(piece)))
            else:
                piece_of.append(piece)
                key_of.append(key)
                tag_of.append(tag)
                first_of.append(first)
    if piece_of:
        part = np.array([routes[p] for p in piece_of], np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cols = [np.array(key_of, "i8")[order], np.array(tag_of, "u4")[order], np.array(first_of, "u4")[order]]
        begins = _runs_of(part)
        for a, b in zip(begins, np.append(begins[1:], len(part))):
            own = [piece_of[k] for k in order[a:b]]
            sizes = np.array([len(p) for p in own], "u4")
            head = np.uint32(b - a).tobytes() + b"".join(c[a:b].tobytes() for c in cols) + sizes.tobytes()
            yield int(part[a]), TEXT, zstandard.ZstdCompressor(level=1).compress(head + b"".join(own))
    for (key, tag), own in runs.items():
        merged = merged_runs(own)
        yield (key * 40_503 >> 4) % (1 << bits), RUN, _pack([
            np.full(len(merged), key, "i8"), np.full(len(merged), tag, "u4"), np.array([a for a, _ in merged], "i8"), np.array([b for _, b in merged], "i8")])


def merged_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def common_intervals(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of equal ``length``-byte strings among those at ``starts``: (string numbers, where each interval begins).

    Suffixes are followed from the strings' ends backwards. At common prefix L the suffix of the string at p is p + length
    - L; all stand in the order of the transform, each with its interval's number.
    """
    start = min(START, length)
    place = starts + (length - start)
    first = np.zeros(len(place), np.uint64)
    for k in range(start):
        first = first << np.uint64(8) | text[place + k]
    string = np.argsort(first, kind="stable").astype(np.int32)
    first, place = first[string], place[string].astype(np.int32 if len(text) < 1 << 31 else np.int64)
    fresh = np.concatenate(([True], first[1:] != first[:-1])) if len(first) else np.empty(0, bool)
    for _ in range(start, length + 1):
        # intervals of one suffix hold nothing in common with another: they end here
        last = np.concatenate((fresh[1:], [True])) if len(fresh) else fresh
        several = ~(fresh & last)
        string, place, fresh = string[several], place[several], fresh[several]
        if not len(string) or _ == length:
            break
        interval = np.cumsum(fresh, dtype=np.int32)
        place = place - 1
        before = text[place]
        order = np.argsort(before, kind="stable")  # a counting sort for bytes: the LF step
        string, place, interval, before = string[order], place[order], interval[order], before[order]
        fresh = np.concatenate(([True], (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])))
    return string, np.flatnonzero(fresh)


def repeated_runs(blocks: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs (key, tag, from, to) of a shard's contexts that also start in a smaller document."""
    # of equal contexts those of the least document stay: all others are repeated as a whole
    least: dict[bytes, int] = {}
    members: list[tuple[bytes, int, int, int]] = []
    for block in blocks:
        raw = memoryview(zstandard.ZstdDecompressor().decompress(block))
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        key, tag, first, size = (np.frombuffer(raw, kind, n, 4 + at * n).tolist() for kind, at in (("i8", 0), ("u4", 8), ("u4", 12), ("u4", 16)))
        ends = np.cumsum(size, dtype=np.int64) + 4 + 20 * n
        for k, t, f, m, end in zip(key, tag, first, size, ends.tolist()):
            piece = bytes(raw[end - m:end])
            if k < least.setdefault(piece, k):
                least[piece] = k
            members.append((piece, k, t, f))
    kept = []
    for member in members:
        piece, k, t, f = member
        if least[piece] < min(k, NULLS):
            yield k, t, f, f + len(piece)
        else:
            kept.append(member)
    key, tag, first = (np.array([m[c] for m in kept], kind) for c, kind in ((1, "i8"), (2, "u4"), (3, "u4")))
    size = np.array([len(m[0]) for m in kept], np.int64)
    text = np.frombuffer(b"".join([m[0] for m in kept]), np.uint8)
    n_strings = size - length + 1
    context = np.repeat(np.arange(len(key)), n_strings)
    inside = np.arange(len(context)) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
    starts = (np.cumsum(size) - size)[context] + inside
    string, begins = common_intervals(text, starts, length)
    if not len(string):
        return
    owner = np.minimum(key, NULLS)[context[string]]
    least = np.minimum.reduceat(owner, begins)
    repeated = owner > np.repeat(least, np.diff(begins, append=len(string)))
    hit = np.sort(string[repeated])
    if not len(hit):
        return
    # neighbouring strings of one context make one run
    new = np.concatenate(([True], (np.diff(hit) != 1) | (context[hit[1:]] != context[hit[:-1]])))
    froms, tos = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    own = context[froms]
    a = first[own].astype(np.int64) + inside[froms]
    yield from zip(key[own].tolist(), tag[own].tolist(), a.tolist(), (a + tos - froms + length).tolist())


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of one part at a time, from rows in the order of ``part``."""
    part, held = None, []
    for batch in batches:
        for p, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != part and held:
                yield held
                held = []
            part = p
            held.append((kind, block.as_py()))
    if held:
        yield held


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and the removed ``spans``
    as pairs of byte offsets [from, to), in order.

    Null and empty texts have no bytes; texts shorter than ``length`` keep all; a null id comes after all others, so it never
    removes from a document with an id (ids of 2^63 - 2^40 and more count as null ones); rows with equal ids do not remove from each other; other columns are not read; an
    empty table gives an empty result.
    """
    return _results(docs, length, id_col, text_col, hot_rows)


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The input rows, all columns, with the repeated passages cut out of their texts (null stays null). A cut that parts a
    character takes what is left of it as well, so texts stay text."""
    return _results(docs, length, id_col, text_col, hot_rows, rewrite=True)


def _results(docs: DataFrame, length: int, id_col: str, text_col: str, hot_rows: int, rewrite: bool = False) -> DataFrame:
    if length < ANCHOR or length - ANCHOR + 1 >= 1 << _N_BITS:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + (1 << _N_BITS) - 2}")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, total / SHARD_BYTES)))))
    hot_rows = max(hot_rows, math.ceil(total / ANCHOR / MOST_HOT))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in (part for whole in batches for part in portions(whole, "text", PORTION_BYTES)):
                yield from anchor_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length, bits)

        yield from batched(rows(), BLOCKS, lambda r: len(r[2]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for held in _shards(batches) for row in shared_anchors(held, hot_rows)), SHARED)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS) + F.xxhash64(text).bitwiseAND(F.lit(LAST - NULLS)))
    slim = docs.select(key.alias("key"), text.alias("text"))
    shared = stored(slim.mapInArrow(ask, BLOCKS).repartition("part").sortWithinPartitions("part").mapInArrow(answer, SHARED), "anchors")
    hot = frozenset(r["hot"] for r in shared.where(F.col("hot").isNotNull()).select("hot").collect())

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in (part for whole in batches for part in portions(whole, "text", PORTION_BYTES)):
                cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "text", "places")]
                yield from context_blocks(*cols, hot, length, bits)

        yield from batched(rows(), BLOCKS, lambda r: len(r[2]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for held in _shards(batches):
                for kind, block in held:
                    if kind == RUN:
                        yield from zip(*[x.tolist() for x in _unpack(block, ("i8", "u4", "i8", "i8"))])
                own = [block for kind, block in held if kind == TEXT]
                if own:
                    yield from repeated_runs(own, length)

        yield from batched(rows(), RUNS)

    # the same columns go into both joins, so Spark shuffles the texts once and uses that exchange twice
    other = [c for c in docs.columns if c != text_col] if rewrite else [id_col]
    rest = F.struct(*[F.col(c) for c in other], F.col(text_col).isNull().alias(own_name(docs, "_null")))
    tag = lambda column: column.bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int")
    texts = docs.select(key.alias("key"), tag(F.crc32(text)).alias("tag"), text.alias("text"), rest.alias("rest"))
    # by id and text, as rows of one id may be many; as sets, since those of one text have the same places and runs
    places = shared.where(F.col("key").isNotNull()).groupBy("key", tag(F.col("at")).alias("tag")).agg(F.collect_set("at").alias("places"))
    runs = (
        texts.join(places, ["key", "tag"]).mapInArrow(contexts, BLOCKS)
        .repartition("part").sortWithinPartitions("part").mapInArrow(expand, RUNS)
    )
    by_doc = runs.groupBy("key", "tag").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    both = texts.join(by_doc, ["key", "tag"], "left")

    def spans_of(runs: list[dict] | None) -> list[tuple[int, int]]:
        return merged_runs([(r["a"], r["b"]) for r in runs or ()])

    if rewrite:
        @F.pandas_udf("string")
        def kept_text(texts_: pd.Series, runs_: pd.Series) -> pd.Series:
            out = []
            for text, own in zip(texts_, runs_):
                spans = spans_of(None if own is None else list(own))
                out.append(_cut(text, spans).decode("utf-8", "ignore") if spans else text.decode("utf-8"))
            return pd.Series(out)

        null = F.col("rest")[own_name(docs, "_null")]
        cut = both.withColumn("cut", F.when(~null, kept_text("text", "runs")))
        return cut.select(*[F.col("cut").alias(n) if n == text_col else F.col("rest")[n].alias(n) for n in docs.columns])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(n)) for n in ("rest", "text", "runs")]
                for doc, text, own in zip(cols[0].field(0).to_pylist(), *cols[1:]):
                    text = text.as_py()
                    spans = spans_of(own.as_py())
                    yield (doc, len(text), sum(b - a for a, b in spans), len(spans),
                           hashlib.sha256(_cut(text, spans)).hexdigest(), [list(s) for s in spans])

        yield from batched(rows(), KEPT, lambda r: 128 + 32 * r[3])

    return both.mapInArrow(digest, KEPT)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
