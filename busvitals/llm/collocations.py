"""Phrase collocations by set-oriented mining of sorted occurrence relations.

Relation ``R1`` holds every word's occurrence, sorted by piece and position, in blocks of a few megabytes of text of one
language. Leaving a gap in the positions between pieces makes "the next word of the same piece" the same as "position
plus one", so a relation is extended by a merge-join with itself shifted by one: neighbours in the sorted block. Each
level does what the method says, and stores what it makes:

1. merge-join: occurrences of k-word phrases at p and at p + 1 are an occurrence of k + 1 words at p; a sieve of hashed
   counts keeps most phrases that are rare over all blocks from being written at all;
2. group-count: blocks count their own phrases, shards of phrases add up what the blocks have, and number the frequent ones;
3. semi-join: each shard answers each block which of its phrases are frequent, and only their occurrences are extended.

Blocks and shards talk in packed columns, a row for each pair of them, so a phrase in every text costs a few bytes per
block, and no table of phrases is sent to every task, since none has a bound. A phrase of k + 1 words is known by the numbers
of the two phrases of k words in it, so nothing rests on hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.sources.scratch import stored

BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20  # texts of all languages that a task holds before it makes a block of the largest
SHARD_PHRASES = 1_000_000  # phrases of all blocks together in one shard
_BREAK, _SPACE = 10, 32
# A-Z to lower case, the marks that end a piece to line feeds, tabs to spaces; all are single bytes of UTF-8
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BLOCK_BITS = _CODE_BITS = 32


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_LONG, _BYTES, _TEXT = T.LongType(), T.BinaryType(), T.StringType()
# positions as steps, local numbers of phrases at them, the phrases (words parted by spaces, or pairs of numbers), their counts
RELATION = _fields(block=_LONG, lang=_TEXT, n=_LONG, n_keys=_LONG, steps=_BYTES, ids=_BYTES, keys=_BYTES, counts=_BYTES)
ASKED = _fields(shard=_LONG, lang=_TEXT, block=_LONG, keys=_BYTES, counts=_BYTES)
# answers to a block: a bit per phrase asked, and the numbers of those with a set bit; and the frequent phrases themselves
ANSWERED = _fields(block=_LONG, shard=_LONG, bits=_BYTES, codes=_BYTES, lang=_TEXT, code=_LONG, f=_LONG, word=_BYTES, left=_LONG, right=_LONG)
SLOTS = _fields(shard=_LONG, block=_LONG, slots=_BYTES, counts=_BYTES)
PASSED = _fields(block=_LONG, shard=_LONG, bits=_BYTES)


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _loose(held: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held), kind)


def _row(block: int, lang: str, at: np.ndarray, ids: np.ndarray, n_keys: int, keys: bytes, counts: np.ndarray) -> tuple:
    return (block, lang, len(at), n_keys, _squeezed(np.diff(at, prepend=0), "<u4"), _squeezed(ids, "<i4"), zlib.compress(keys, 1),
            _squeezed(counts, "<u4"))


def word_block(block: int, lang: str, text: bytes) -> tuple | None:
    """Relation ``R1`` of one block of plain text; nothing if it has no word."""
    a = np.frombuffer(text, np.uint8)
    word = (a != _BREAK) & (a != _SPACE)
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return None
    at = np.arange(1, len(begin) + 1) + np.searchsorted(np.flatnonzero(a == _BREAK), begin)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(a[word])])
    coded = words.dictionary_encode()
    ids, own = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    return _row(block, lang, at, ids, len(own), b" ".join(own), np.bincount(ids, minlength=len(own)))


def _mixed(pairs: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of numbers."""
    h = np.zeros(len(pairs), np.uint64)
    for column in pairs.T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _in_shards(high: np.ndarray, shards: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """The order in which 32-bit hashes lie by shard, and each shard's range in it."""
    shard = (high.astype(np.uint64) * np.uint64(shards)) >> np.uint64(32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return order, ((int(shard[a]), int(a), int(b)) for a, b in zip(cut, cut[1:]) if a < b)


def _keys_in_shards(row: dict, shards: int) -> tuple[list[bytes] | np.ndarray, np.ndarray, Iterator[tuple[int, int, int]]]:
    """A block's phrases, and their order and ranges by shard; blocks of the same phrase name the same shard."""
    raw = zlib.decompress(row["keys"])
    if row["word"]:
        words = raw.split(b" ")
        return words, *_in_shards(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), shards)
    pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return pairs, *_in_shards(_mixed(pairs) >> np.uint64(32), shards)


def asked(row: dict, shards: int) -> Iterator[tuple]:
    """What a block asks of each shard: its phrases there and their counts."""
    keys, order, parts = _keys_in_shards(row, shards)
    counts = _loose(row["counts"], "<u4")[order]
    for shard, a, b in parts:
        own = b" ".join([keys[i] for i in order[a:b]]) if row["word"] else keys[order[a:b]].tobytes()
        yield shard, row["lang"], row["block"], zlib.compress(own, 1), _squeezed(counts[a:b], "<u4")


def answered(shard: int, lang: str, held: list[dict], word: bool, least: int, first: int) -> tuple[int, list[tuple]]:
    """A shard's answers to its blocks, and its frequent phrases, numbered from ``first`` on; how many these are."""
    counts = [_loose(r["counts"], "<u4") for r in held]
    if word:
        coded = pa.array([w for r in held for w in zlib.decompress(r["keys"]).split(b" ")], pa.large_binary()).dictionary_encode()
        place, size = coded.indices.to_numpy(), len(coded.dictionary)
    else:
        pairs = np.concatenate([np.frombuffer(zlib.decompress(r["keys"]), "<i8") for r in held]).reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        new = np.concatenate([[True], (np.diff(pairs[order], axis=0) != 0).any(axis=1)])
        place = np.empty(len(pairs), np.int64)
        place[order] = np.cumsum(new) - 1
        size, distinct = int(new.sum()), pairs[order][new]
    total = np.bincount(place, np.concatenate(counts).astype(np.float64), size).astype(np.int64)  # below 2**53, so exact
    often = np.flatnonzero(total >= least)
    code = np.full(size, -1, np.int64)
    code[often] = (shard << _CODE_BITS) + first + np.arange(len(often))
    out = []
    for r, own in zip(held, np.split(code[place], np.cumsum([len(c) for c in counts])[:-1])):
        if (own >= 0).any():
            out.append((r["block"], shard, np.packbits(own >= 0).tobytes(), _squeezed(own[own >= 0], "<i8"), *[None] * 6))
    for i in often.tolist():
        what = (coded.dictionary[i].as_py(), None, None) if word else (None, *distinct[i].tolist())
        out.append((None, None, None, None, lang, int(code[i]), int(total[i]), *what))
    return len(often), out


def _codes(row: dict, shards: int) -> np.ndarray:
    """The number of each phrase of a block by what the shards have answered, -1 for rare ones."""
    keys, order, parts = _keys_in_shards(row, shards)
    said = {r["shard"]: r for r in row["kept"]}
    out = np.full(len(keys), -1, np.int64)
    for shard, a, b in parts:
        if shard in said:
            passed = np.unpackbits(np.frombuffer(said[shard]["bits"], np.uint8), count=b - a).astype(bool)
            out[order[a:b][passed]] = _loose(said[shard]["codes"], "<i8")
    return out


def _joined(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a block's relation with itself one position on, frequent phrases only: positions, the longer phrase at
    each, how often each occurs, and the pair of numbers that it is."""
    codes = _codes(row, shards)
    at, ids = np.cumsum(_loose(row["steps"], "<u4").astype(np.int64)), _loose(row["ids"], "<i4")
    stay = codes[ids] >= 0
    at, ids = at[stay], ids[stay].astype(np.int64)
    meet = np.flatnonzero(np.diff(at) == 1)
    pairs, back, counts = np.unique(ids[meet] * len(codes) + ids[meet + 1], return_inverse=True, return_counts=True)
    left, right = np.divmod(pairs, max(1, len(codes)))
    return at[meet], back.reshape(-1), counts, np.stack([codes[left], codes[right]], axis=1)


def slot_rows(row: dict, shards: int, sieves: int) -> Iterator[tuple]:
    """What a block asks of each shard of the sieve: its longer phrases' slots (32 bits of a hash) and counts."""
    _, _, counts, pairs = _joined(row, shards)
    h = _mixed(pairs)
    order, parts = _in_shards(h >> np.uint64(32), sieves)
    slots = h[order].astype(np.uint32)  # the low half
    for shard, a, b in parts:
        yield shard, row["block"], slots[a:b].tobytes(), _squeezed(counts[order[a:b]], "<u4")


def sieved(held: list[dict], least: int) -> Iterator[tuple[int, bytes]]:
    """A sieve's answer to its blocks: a bit per phrase, set where the phrases of its slot occur ``least`` times together."""
    slots = [np.frombuffer(r["slots"], np.uint32) for r in held]
    values, place = np.unique(np.concatenate(slots), return_inverse=True)
    total = np.bincount(place, np.concatenate([_loose(r["counts"], "<u4") for r in held]).astype(np.float64), len(values))
    for r, part in zip(held, np.split(total[place] >= least, np.cumsum([len(x) for x in slots])[:-1])):
        if part.any():
            yield r["block"], np.packbits(part).tobytes()


def extended_block(row: dict, shards: int, sieves: int) -> tuple | None:
    """The block's relation of phrases that are one word longer and pass the sieve; nothing if none does."""
    at, back, counts, pairs = _joined(row, shards)
    order, parts = _in_shards(_mixed(pairs) >> np.uint64(32), sieves)
    bits = {r["shard"]: r["bits"] for r in row["passed"]}
    passed = np.zeros(len(pairs), bool)
    for shard, a, b in parts:
        if shard in bits:
            passed[order[a:b]] = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=b - a).astype(bool)
    stay = passed[back]
    if not stay.any():
        return None
    return _row(row["block"], row["lang"], at[stay], (np.cumsum(passed) - 1)[back[stay]], int(passed.sum()), pairs[passed].tobytes(), counts[passed])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one at a time: a block has megabytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _weight(row: tuple) -> int:
    return 64 + sum(len(v) for v in row if isinstance(v, bytes))


def occurrences(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """Relation ``R1`` of all texts, stored. Blocks are numbered by the task that makes them, which holds because they are
    written once and read back. Longer texts are parted between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, bytearray] = {}
        total = 0

        def block(lang: str, text: bytes) -> Iterator[tuple]:
            nonlocal made
            row = word_block((part << _BLOCK_BITS) + made, lang, text)
            if row is not None:
                made += 1
                yield row

        def rows() -> Iterator[tuple]:
            nonlocal total
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    plain = text.as_py().translate(_PLAIN)
                    a = 0
                    while len(plain) - a > block_bytes:  # a text longer than a block
                        b = plain.rfind(b"\n", a, a + block_bytes) + 1 or plain.find(b"\n", a + block_bytes) + 1 or len(plain)
                        yield from block(lang, plain[a:b])
                        a = b
                    own = held.setdefault(lang, bytearray())
                    own += plain[a:] if a else plain
                    own += b"\n"
                    total += len(plain) - a + 1
                    while len(own) >= block_bytes or total >= HELD_BYTES:
                        full = lang if len(own) >= block_bytes else max(held, key=lambda k: len(held[k]))
                        done = held.pop(full)
                        total -= len(done)
                        yield from block(full, bytes(done))
                        own = held.get(lang, bytearray())
            for lang, text in held.items():
                yield from block(lang, bytes(text))

        yield from batched(rows(), RELATION, _weight)

    slim = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return stored(slim.mapInArrow(run, RELATION), "occurrences")


def _shards(relation: DataFrame, column: str) -> int:
    return max(1, -(-(relation.agg(F.sum(column)).first()[0] or 0) // SHARD_PHRASES))


def counted(relation: DataFrame, word: bool, least: int, shards: int) -> DataFrame:
    """Group-count: the stored answers of all shards to all blocks, and the frequent phrases with numbers of their own, which
    hold because they are written once and read back."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((r for row in _rows(batches) for r in asked(row | {"word": word}, shards)), ASKED, _weight)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, own in groupby(_rows(batches), lambda r: r["shard"]):
                first = 0
                for lang, held in groupby(own, lambda r: r["lang"]):
                    n, out = answered(shard, lang, list(held), word, least, first)
                    first += n
                    yield from out

        yield from batched(rows(), ANSWERED, _weight)

    slim = relation.select("block", "lang", "keys", "counts").mapInArrow(ask, ASKED)
    return stored(slim.repartition("shard").sortWithinPartitions("shard", "lang").mapInArrow(answer, ANSWERED), "phrases")


def longer(relation: DataFrame, answers: DataFrame, word: bool, least: int, shards: int) -> DataFrame:
    """Semi-join and merge-join: the stored relation of phrases one word longer, without most rare ones.

    Most phrases of a block are rare in all blocks. Before any is written, the blocks ask a sieve: phrases are hashed to
    slots, slots are dealt to shards of bounded size, and a shard adds up what the blocks have in its slots. A phrase whose slot
    has less than ``least`` is rare for certain; the few that pass wrongly, by a shared slot, are found out by the exact count.
    """
    sieves = _shards(relation, "n")
    # a bit and a number for each phrase of the block at most
    kept = answers.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("shard", "bits", "codes")).alias("kept"))
    slim = relation.select("block", "lang", "steps", "ids", "keys").join(kept, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((r for row in _rows(batches) for r in slot_rows(row | {"word": word}, shards, sieves)), SLOTS, _weight)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, held in groupby(_rows(batches), lambda r: r["shard"]):
                for block, bits in sieved(list(held), least):
                    yield block, shard, bits

        yield from batched(rows(), PASSED, _weight)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (extended_block(row | {"word": word}, shards, sieves) for row in _rows(batches))
        yield from batched((r for r in made if r is not None), RELATION, _weight)

    passed = slim.mapInArrow(ask, SLOTS).repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, PASSED)
    by_block = passed.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("passed"))
    return stored(slim.join(by_block, "block").mapInArrow(extend, RELATION), "occurrences")


def phrases(
    docs: DataFrame, most_words: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES
) -> tuple[list[DataFrame], DataFrame]:
    """All frequent phrases, a table for each length from 1 to ``most_words``, and every language's number of words (``lang``,
    ``n``). A phrase has its ``lang``, ``code``, ``f``, ``phrase``, the codes of its first and of its last words but one
    (``left``, ``right``), and the counts of its beginnings and ends by length (``begins``, ``ends``; the last is ``f``).

    Null texts have no words; a null language is ``und``; every row counts, repeated ones too; other columns are not read; an
    empty table has no phrases. A piece is never parted, whatever its length.
    """
    relation = occurrences(docs, text_col, lang_col, block_bytes)
    totals = stored(relation.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    found: list[DataFrame] = []
    for length in range(1, most_words + 1):
        word = length == 1
        shards = _shards(relation, "n_keys")
        answers = counted(relation, word, least, shards)
        own = answers.where("code IS NOT NULL").select("lang", "code", "f", "word", "left", "right")
        if word:
            text = F.decode("word", "UTF-8")
            own = own.select("lang", "code", "f", "left", "right", text.alias("phrase"), text.alias("last"), F.array("f").alias("begins"), F.array("f").alias("ends"))
        else:
            left = found[-1].select(F.col("code").alias("left"), F.col("phrase").alias("head"), "begins")
            right = found[-1].select(F.col("code").alias("right"), "last", "ends")
            own = stored(own.drop("word").join(left, "left").join(right, "right").select(
                "lang", "code", "f", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last",
                F.concat("begins", F.array("f")).alias("begins"), F.concat("ends", F.array("f")).alias("ends")), "spelled")
        found.append(own)
        if length < most_words:
            relation = longer(relation, answers, word, least, shards)
    return found, totals


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``1000 * a * n / (l * r)``, rounded down, in whole numbers of 38 digits."""
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (_exact(a) * _exact(n)), _exact(left) * _exact(right))


def collocations(
    docs: DataFrame, most_words: int = 5, least: int = 100, cover: int = 100, best: int | None = 2000, text_col: str = "text",
    lang_col: str = "lang", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``most_words`` words that occur ``least`` times: ``lang``, ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    The score is that of the cut where it is least (ties: the shortest first part). A phrase is left out if one that is longer
    by words at either end occurs ``cover`` hundredths as often. Odd input as in ``phrases``; ``best=None`` returns all.
    """
    found, totals = phrases(docs, most_words, least, text_col, lang_col, block_bytes)
    open_ = []
    for k, own in enumerate(found[1:], 1):
        if k + 1 < len(found):
            # what lies in a phrase that is longer by more lies in one longer by one, which occurs as often at least
            covers = found[k + 1].select(F.explode(F.array("left", "right")).alias("code"), F.col("f").alias("g"))
            most = covers.groupBy("code").agg(F.max("g").alias("most"))
            covered = F.col("most").isNotNull() & (100 * _exact(F.col("most")) >= cover * _exact(F.col("f")))
            own = own.join(most, "code", "left").where(~covered)
        open_.append(own.select("lang", "phrase", F.col("f").alias("a"), "begins", "ends"))
    if not open_:
        raise ValueError("most_words must be 2 or more")
    every = open_[0]
    for more in open_[1:]:
        every = every.unionByName(more)
    length = F.size("begins")
    cuts = F.transform(F.sequence(F.lit(1), length - 1), lambda k: F.struct(
        score(F.col("a"), F.col("n"), F.get("begins", k - 1), F.get("ends", length - k - 1)).alias("score"), k.alias("k"),
        F.get("begins", k - 1).alias("l"), F.get("ends", length - k - 1).alias("r")))
    low = F.array_min(cuts)
    named = every.join(totals, "lang").withColumn("low", low).select(
        "lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
