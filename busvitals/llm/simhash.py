"""Near-duplicates by SimHash fingerprints and BK-trees.

A BK-tree keeps each child under its Hamming distance to the parent; a search with radius r follows only the edges within
r of its own distance. One tree of all fingerprints would be neither buildable nor broadcastable at scale, so trees are
sharded: two fingerprints within r bits agree in at least one of r + 1 blocks of bits, so every fingerprint goes to the
r + 1 shards of its block values and looks for partners only there. A shard that is too large (a cluster of near copies
shares most blocks) is split the same way over its remaining bits, again exactly, until shards are small or so many bits
are fixed that they are bounded by construction.

A shard's tree tells which of its fingerprints hang together. Only one link per fingerprint leaves the shard, to the
smallest of its group, so a group of n copies costs n links and not n squared, and no connection is lost. Links are
contracted to components by alternating large and small stars; only distinct fingerprints take part, never documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.llm.text import byte_words, own_name
from busvitals.sources.scratch import stored

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD_ROWS = 2_000  # a larger shard is split by more bits
LEVELS = 4
PART = 1 << 16  # shingles hashed at a time, so that a long text needs little memory

#: Odd multipliers of the further lanes, the golden ratio's and another, as 64-bit numbers.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("print", T.LongType())])
SHARDS = T.StructType([T.StructField("shard", T.StringType()), T.StructField("print", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased (A-Z) words' shingles, ``PART`` at a time; fewer words are one shingle, none give nothing."""
    words = byte_words(text)
    if not words:
        return
    line = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    stops = ends[len(words) - n:]
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, PART):
        yield np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[k:k + PART].tolist(), stops[k:k + PART].tolist())), np.uint64)


def _majority(parts: Iterable[np.ndarray], lanes: int) -> int:
    """SimHash of 64 bits per lane of hashes; 0 of none."""
    ones, n = np.zeros((lanes, BITS), np.int64), 0
    for h in parts:
        n += len(h)
        for lane in range(lanes):
            if lane:
                h = (h ^ (h >> np.uint64(31))) * _MIX[0]
                h = (h ^ (h >> np.uint64(29))) * _MIX[1]
            ones[lane] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, lanes: int = 1) -> int:
    """Unsigned SimHash of 64 bits per lane of a text's shingles, repeated ones as often as they occur. The first lane is
    XXH64 itself, further ones are mixed from it."""
    return _majority(shingle_hashes(text, shingle, seed), lanes)


def signed(number: int) -> int:
    return number - (1 << BITS) if number >> BITS - 1 else number


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed number) of every row, by a narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, signed(fingerprint(t.as_py(), shingle, seed))) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        yield from batched(rows, PRINTS)

    return docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, PRINTS)


class BKTree:
    """Distinct numbers, each child under its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, number: int, radius: int) -> Iterator[int]:
        """Positions of the members within the radius, one by one."""
        todo = [0] if self.value else []
        value, children = self.value, self.children
        while todo:
            at = todo.pop()
            far = (value[at] ^ number).bit_count()
            if far <= radius:
                yield at
            own = children[at]
            if own:
                todo += [child for d, child in own.items() if far - radius <= d <= far + radius]

    def add(self, number: int) -> None:
        new, at = len(self.value), 0
        self.value.append(number)
        self.children.append({})
        while new:
            far = (self.value[at] ^ number).bit_count()
            if far not in self.children[at]:
                self.children[at][far] = new
                break
            at = self.children[at][far]


def shard_links(numbers: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(number, smallest of its group) for the groups that numbers within the radius of each other form.

    Numbers without a partner so far share one tree; every group has a tree of its own, of which one hit is enough. So a large
    cluster of near copies costs a few steps per member, not a comparison with every other.
    """
    loners, alive = BKTree(), []
    groups: list[BKTree] = []
    for number in sorted(numbers):
        single = [k for k in loners.within(number, radius) if alive[k]]
        joined = [g for g in groups if next(g.within(number, radius), None) is not None]
        if not single and not joined:
            loners.add(number)
            alive.append(True)
            continue
        joined.sort(key=lambda g: -len(g.value))
        home = joined[0] if joined else BKTree()
        if not joined:
            groups.append(home)
        for g in joined[1:]:
            for member in g.value:
                home.add(member)
            groups.remove(g)
        for k in single:
            alive[k] = False
            home.add(loners.value[k])
        home.add(number)
    for g in groups:
        least = min(g.value)
        yield from ((member, least) for member in g.value if member != least)


def _sharded(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Each fingerprint under each of its blocks at this level: shard names and the bits still free.

    ``rows``: ``print``, ``shard``, ``free`` (a mask's bit numbers, least first).
    """
    parts = radius + 1

    def block(k: int):
        size = F.size("free")
        start = F.floor(size * k / parts).cast("int")
        stop = F.floor(size * (k + 1) / parts).cast("int")
        own = F.slice("free", start + 1, stop - start)
        value = F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, bit: acc * 2 + F.getbit("print", bit).cast("bigint"))
        rest = F.concat(F.slice("free", F.lit(1), start), F.slice("free", stop + 1, size - stop))
        return F.struct(F.concat_ws("/", "shard", F.concat(F.lit(f"{k}:"), value.cast("string"))).alias("shard"), rest.alias("free"))

    return rows.select("print", F.explode(F.array(*[block(k) for k in range(parts)])).alias("s")).select("print", "s.shard", "s.free")


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """Links between distinct fingerprints (column ``print``), enough to connect all that are within ``radius`` in chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int]]:
            shard, members = None, []
            for batch in batches:
                for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if s != shard:
                        if len(members) > 1:
                            yield from ((signed(a), signed(b)) for a, b in shard_links(members, radius))
                        shard, members = s, []
                    members.append(p % (1 << BITS))
            if len(members) > 1:
                yield from ((signed(a), signed(b)) for a, b in shard_links(members, radius))

        yield from batched(rows(), LINKS)

    def trees(rows: DataFrame) -> DataFrame:
        return rows.select("shard", "print").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, LINKS)

    rows = prints.select("print", F.lit("").alias("shard"), F.sequence(F.lit(0), F.lit(BITS - 1)).alias("free"))
    found: DataFrame | None = None
    for level in range(levels):
        rows = _sharded(rows, radius, level)
        if level == levels - 1:  # so many bits are fixed by now that a shard is small whatever the data
            linked = trees(rows)
            found = linked if found is None else found.unionByName(linked)
            break
        # few shards are too large; Spark broadcasts their names if they are, else splits what is skewed
        large = stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select("shard"), "large-shards")
        linked = trees(rows.join(large, "shard", "left_anti"))
        found = linked if found is None else found.unionByName(linked)
        if large.isEmpty():
            break
        rows = stored(rows.join(large, "shard", "left_semi"), "split-shards")
    return found


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``a`` -> ``b``, the smallest number connected to it, for every number on a link; the smallest themselves have no row."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id
    connected to it by fingerprints at ``radius`` or fewer differing bits.

    Null, empty and white texts have fingerprint zero and are linked like any other; a null id keeps its row and names no
    component (null if no member has an id); repeated rows stay; other columns are not read; an empty table gives an empty
    result. Texts are read once and never shuffled: only fingerprints are.
    """
    own = stored(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = stored(own.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(links(distinct, radius, shard_rows))
    named = distinct.join(joined, F.col("print") == F.col("a"), "left").select("print", "least", F.coalesce("b", "print").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(smallest, "root").select("print", "component_id"), "named-fingerprints")
    # the side of the documents may be skewed (equal texts have equal fingerprints); Spark splits it at run time
    return own.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


LANES = 4
SIMILAR = 0.8  # least share of their union that two texts' distinct shingles have in common
#: Of 256 bits; only says which pairs are compared. Shingle sets that share 0.8 of their union differ in 39 on average with a
#: deviation of 5.7, so one pair in 250 is beyond it. Unrelated texts differ in 128.
SIMILAR_RADIUS = 54
KEY_BITS = 8  # per table, for up to 2 ** 16 sets; more for more
MISS = 0.02  # greatest chance that no table holds a pair at the radius
SIMILAR_SHINGLE = 5
NEAREST = 1  # pairs of two groups that are compared first; four times as many in each further round
SPREAD = 128  # parts of a set that are counted
_FULL = (1 << 16) - 1  # a part of so many may have more
BLOCK_ROWS = 2_000  # a larger shard is worked on in blocks
LEADERS = 32  # about so many members of a larger shard are in all its blocks
_AGREE = 1 - SIMILAR_RADIUS / (LANES * BITS)  # chance that a pair at the radius agrees in a bit
_CELLS = 1 << 19  # pairs of a shard's members whose bits are compared at a time
COPY, HOME, DEALT = 0, 1, 2

WIDE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("wide", T.BinaryType()), T.StructField("text_hash", T.LongType())])
TABLES = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BinaryType())])
GROUPED = T.StructType([*TABLES, T.StructField("root", T.LongType()), T.StructField("spread", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("far", T.LongType())])
ACROSS = T.StructType([*PAIRS, T.StructField("root_a", T.LongType()), T.StructField("root_b", T.LongType())])
SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("spread", T.BinaryType())])


def _table_bits(sets: int) -> tuple[int, int]:
    """Bits of a table's key and number of tables for so many sets: shards stay small, the chance to miss stays."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, sets))) - 8)
    return bits, math.ceil(math.log(1 / MISS) / _AGREE**bits)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's 5-word shingles, in order."""
    parts = list(shingle_hashes(text, SIMILAR_SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _node(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


class WideTree:
    """A BK-tree of fingerprints of several 64-bit lanes: each child under its Hamming distance to the parent. All members go
    down together, a level at a time, and so do all queries."""

    def __init__(self, wide: np.ndarray) -> None:
        self.lanes = np.ascontiguousarray(wide.T)
        self.span = BITS * len(self.lanes) + 1  # distances of one parent's children
        at, left = np.zeros(len(wide), np.int64), np.arange(1, len(wide))
        edges, child = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(left):  # the first member at a new distance is the child, the others go on below it
            edge, first, below = np.unique(at[left] * self.span + self._far(left, at[left]), return_index=True, return_inverse=True)
            edges.append(edge)
            child.append(left[first])
            at[left] = left[first][below]
            left = np.delete(left, first)
        order = np.argsort(np.concatenate(edges))
        self.edges, self.child = np.concatenate(edges)[order], np.concatenate(child)[order]

    def _far(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(lane[one] ^ lane[other]).astype(np.int64) for lane in self.lanes)

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, another one, differing bits) of all within the radius of the members asked for."""
        me, at, hits = asked, np.zeros(len(asked), np.int64), []
        while len(me):
            far = self._far(me, at)
            hit = (far <= radius) & (me != at)
            hits.append((me[hit], at[hit], far[hit]))
            start = np.searchsorted(self.edges, at * self.span + np.maximum(far - radius, 0))
            some = np.searchsorted(self.edges, at * self.span + np.minimum(far + radius, self.span - 1), "right") - start
            me = np.repeat(me, some)
            at = self.child[np.repeat(start - np.cumsum(some) + some, some) + np.arange(len(me))]
        return tuple(np.concatenate(x) for x in zip(*hits))


def spread(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of ``SPREAD`` parts; what two sets share is at most the sum of the lesser counts."""
    part = (hashes >> np.uint64(BITS - 7)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=SPREAD), _FULL).astype(np.uint16).tobytes()


def may_share(size: np.ndarray, spreads: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the counts of each pair's parts leave it possible that the sets share ``SIMILAR`` of their union."""
    may = np.empty(len(a), bool)
    for k in range(0, len(a), _CELLS // SPREAD):
        i, j = a[k:k + _CELLS // SPREAD], b[k:k + _CELLS // SPREAD]
        lesser = np.minimum(spreads[i], spreads[j])
        most = np.where((lesser == _FULL).any(1), np.minimum(size[i], size[j]), lesser.sum(1, dtype=np.int64))
        may[k:k + _CELLS // SPREAD] = most >= SIMILAR * (size[i] + size[j] - most) - 1e-9
    return may


def table_keys(wide: np.ndarray, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """The key of each fingerprint (a row of bytes) in each table, of which ``chosen`` has the bits."""
    set_bits = np.unpackbits(wide, axis=1)
    weights = 1 << np.arange(chosen.shape[1], dtype=np.int64)
    for own_bits in chosen:
        yield (set_bits[:, own_bits] * weights).sum(1)


def met_elsewhere(wide: np.ndarray, chosen: np.ndarray, place: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of a block's members are another block's work: of an earlier table (``chosen``: the bits of those) in which
    they meet too, or of this table, where both are in all blocks and the first is not at home (see ``across_groups``)."""
    keys = list(table_keys(np.ascontiguousarray(wide).view(np.uint8), chosen))

    def check(me: np.ndarray, at: np.ndarray) -> np.ndarray:
        away = (place[me] == COPY) & (place[at] != DEALT)
        for key in keys:
            away |= key[me] == key[at]
        return away

    return check


def near_pairs(
    node: np.ndarray, size: np.ndarray, wide: np.ndarray, nearest: int, group: np.ndarray | None = None, spreads: np.ndarray | None = None,
    elsewhere: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> Iterator[tuple[int, ...]]:
    """(greater node, lesser node, differing bits) of a shard's members that may be similar, found in a BK-tree: within the
    radius and of sizes that allow it. A member with more partners has the ``nearest`` ones and the least one, so that n copies
    have no n squared pairs; (member, member, -1) says so.

    With groups, only pairs of different ones whose ``spreads`` allow it and that are not met ``elsewhere``, of each two groups
    of the shard the ``nearest`` ones, and both groups behind them, the pair being in the order of its groups."""
    if len(node) < 2:
        return
    tree = WideTree(wide)
    step = max(1, _CELLS // len(node))
    more, held = np.zeros(len(node), bool), [np.empty(0, np.int64)] * 3

    def told() -> Iterator[tuple[int, ...]]:
        me, at, far = held
        yield from zip(node[me].tolist(), node[at].tolist(), far.tolist(), group[me].tolist(), group[at].tolist())

    for k in range(0, len(node), step):
        me, at, far = tree.within(np.arange(k, min(k + step, len(node))), SIMILAR_RADIUS)
        may = (np.minimum(size[me], size[at]) >= SIMILAR * np.maximum(size[me], size[at]) - 1e-9) & (node[me] != node[at])
        if group is not None:
            may &= group[me] > group[at]  # each pair is found from both its ends
        me, at, far = me[may], at[may], far[may]
        if elsewhere is not None:
            may = ~elsewhere(me, at)
            me, at, far = me[may], at[may], far[may]
        if spreads is not None:
            may = may_share(size, spreads, me, at)
            me, at, far = me[may], at[may], far[may]
        if not len(me):
            continue
        if group is not None:
            me, at, far = (np.concatenate(x) for x in zip(held, (me, at, far)))
            order = np.lexsort((node[at], node[me], far, group[at], group[me]))
            me, at, far = me[order], at[order], far[order]
            new = np.append(True, (group[me[1:]] != group[me[:-1]]) | (group[at[1:]] != group[at[:-1]]))
        else:
            order = np.lexsort((node[at], far, node[me], me))
            me, at, far = me[order], at[order], far[order]
            new = np.append(True, me[1:] != me[:-1])
        begins = np.flatnonzero(new)
        kept = np.arange(len(me)) - np.repeat(begins, np.diff(begins, append=len(me))) < nearest
        if group is not None:
            more[me[~kept]] = more[at[~kept]] = True
            held = [me[kept], at[kept], far[kept]]
            if len(held[0]) > _CELLS:
                yield from told()
                held = [x[:0] for x in held]
            continue
        kept[np.lexsort((node[at], np.cumsum(new)))[begins]] = True
        yield from ((x, x, -1) for x in node[np.unique(me[~kept])].tolist())
        me, at, far = me[kept], at[kept], far[kept]
        swap = node[me] < node[at]
        yield from zip(node[np.where(swap, at, me)].tolist(), node[np.where(swap, me, at)].tolist(), far.tolist())
    if group is not None:
        yield from ((x, x, -1, 0, 0) for x in node[more].tolist())
        yield from told()


def in_blocks(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of shards with those of over ``block_rows`` dealt by hash to blocks, ``shard`` then being the block's number.

    Near copies agree in nearly all bits, so further bits would not part them. Members in different blocks are connected by
    way of the shard's ``LEADERS`` least nodes, which are members of each block, and blocks differ from table to table;
    ``dealt`` tells them, so that they are looked at again.
    """
    large = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_rows)
    large = stored(large, "large-shards")
    blocks = F.ceil(F.col("m") / F.lit(block_rows)).cast("bigint")
    leads = F.col("node").cast("double") < F.lit(float(1 << BITS)) * (F.lit(LEADERS) / F.col("m") - F.lit(0.5))  # nodes are hashes
    own = (
        F.when(F.col("m").isNull(), F.array(F.lit(0).cast("bigint"))).when(leads, F.sequence(F.lit(0).cast("bigint"), blocks - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("shard", "node"), blocks)))
    )
    dealt = placed.join(large, "shard", "left").withColumn("_block", F.explode(own))
    return dealt.select(F.when(F.col("m").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", "_block")).alias("shard"), "node", "n", "wide", F.col("m").isNotNull().alias("dealt"))


def across_groups(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of the shards that hold several groups (``root``). The members of a shard's largest group are dealt to blocks of
    about ``block_rows``; those of the others are in all its blocks, so every pair of different groups meets. ``place`` tells
    the largest group's (``DEALT``) from others in the one block where they are at home (``HOME``) and in the rest (``COPY``)."""
    sizes = placed.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("shard").agg(F.max(F.struct("m", "root")).alias("g"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    blocks = F.ceil(F.col("g.m") / F.lit(block_rows)).cast("bigint")
    home, in_largest = F.pmod(F.xxhash64("shard", "node"), blocks), F.col("root") == F.col("g.root")
    own = F.when(in_largest, F.array(home)).otherwise(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = placed.join(largest, "shard").withColumn("block", F.explode(own))
    place = F.when(in_largest, DEALT).when(F.col("block") == home, HOME).otherwise(COPY)
    return dealt.select(F.xxhash64("shard", "block").alias("shard"), "node", "n", "wide", "root", "spread", "table", place.alias("place"))


def _similar(pairs: DataFrame, sets: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets share at least ``SIMILAR`` of their union."""
    both = pairs.select("a", "b", *also).join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared >= F.lit(SIMILAR) * (F.size("_a") + F.size("_b") - shared) - F.lit(1e-9)).select("a", "b", *also)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``node``, ``n``, ``wide``, ``text_hash``: a number and the size of the text's set of 5-word shingles, and
    its fingerprint of 256 bits), and ``node`` -> ``root`` for all.

    Fingerprints only find candidates: for similarity 0.8 the radius is far too wide for shards by agreeing blocks, so shards
    are tables of randomly chosen bits; a pair misses all of them with a chance below ``MISS``. A link is a pair of which the
    sets themselves are at least ``SIMILAR``. Candidates are found in a BK-tree of each shard. First each set is compared with
    its nearest and its least one. Sets that have others, or were dealt to blocks, are then sought again among those of *other*
    groups only, where what two sets can share is bounded by counts before they are compared; a pair that meets in several
    tables or blocks is the work of one of them. Of each two groups the nearest pair is compared at first; as long as sets have others, the rounds go on with more, so no candidate is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i, t, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    own = shingle_set(t.as_py())
                    yield i, _node(own), len(own), _majority([own], LANES).to_bytes(LANES * 8, "big"), x

        yield from batched(rows(), WIDE)

    text = F.col(text_col).cast("string")
    own = stored(docs.select(F.col(id_col).cast("bigint").alias("i"), text.alias("t"), F.xxhash64(text).alias("x")).mapInArrow(run, WIDE), "wide")
    distinct = stored(own.groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("wide")), "distinct-wide")
    filled = distinct.where("n > 0")
    bits, tables = _table_bits(filled.count())
    chosen = np.random.Generator(np.random.PCG64(SEED)).random((tables, LANES * BITS)).argsort(1)[:, :bits]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column(2).to_pylist()
            for k, key in enumerate(table_keys(np.frombuffer(b"".join(wide), np.uint8).reshape(len(wide), -1), chosen)):
                shard = key * tables + k
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, LANES)
            now = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4)), wide]
            if batch.num_columns > 5:
                now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, SPREAD))
                now += [batch.column(c).to_numpy(zero_copy_only=False) for c in (6, 7)]
            held = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            ends = np.flatnonzero(np.diff(held[0])) + 1
            for a, b in zip([0, *ends], ends):
                yield [c[a:b] for c in held]
            held = [c[ends[-1] if len(ends) else 0:] for c in held]
        if held is not None:
            yield held

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int]]:
            for _, node, size, dealt, wide in shards(batches):
                yield from ((x, x, -1) for x in node[dealt].tolist())
                yield from near_pairs(node, size, wide, 1)

        yield from batched(rows(), PAIRS)

    def candidates_across(nearest: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = (
                near_pairs(node, size, wide, nearest, root, spreads, met_elsewhere(wide, chosen[: table[0]], place))
                for _, node, size, root, wide, spreads, table, place in shards(batches) if len(node) > 1
            )
            yield from batched((pair for pairs in found for pair in pairs), ACROSS)

        return run

    def sought(placed: DataFrame, by, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
        """Pairs to compare, and the members that have more."""
        found = stored(placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(by, schema).distinct(), "pairs")
        return found.where("a <> b"), found.where("a = b").select(F.col("a").alias("node"))

    pairs, crowded = sought(in_blocks(filled.select("node", "n", "wide").mapInArrow(keys, TABLES), block_rows), candidates, PAIRS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (shingle_set(t.as_py()) for b in batches for t in b.column(0))
        yield from batched(((_node(h), h.view(np.int64), spread(h)) for h in sets), SETS, lambda r: 8 * len(r[1]) + 2 * SPREAD + 64)

    # the sets of what is compared, made anew from the texts; one row of each
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "far").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "far"))
    firsts = stored(ends.groupBy("node").agg(
        F.min("other").alias("least"), F.min(F.struct("far", "other")).alias("near"), F.count(F.lit(1)).alias("m")), "first-pairs")
    others = firsts.where(F.col("m") > F.when(F.col("least") == F.col("near.other"), 1).otherwise(2)).select("node")
    crowded = stored(crowded.unionByName(others).distinct(), "crowded")
    texts = own.join(firsts.select("node").unionByName(crowded), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("_h")).select("_h").distinct()
    used = docs.select(text.alias("t")).withColumn("_h", F.xxhash64("t")).join(texts, "_h", "left_semi")
    sets = stored(used.select("t").mapInArrow(whole, SETS).dropDuplicates(["node"]), "sets")
    pair = lambda other: firsts.select(F.greatest("node", other).alias("a"), F.least("node", other).alias("b"))
    joined = components(_similar(pair(F.col("least")).unionByName(pair(F.col("near.other"))).distinct(), sets))

    root = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stored(distinct.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    nearest = NEAREST
    while not crowded.isEmpty():
        again = filled.join(crowded, "node").join(sets.select("node", "spread"), "node").join(roots, "node")
        placed = again.select("node", "n", "wide", "root", "spread").mapInArrow(keys, GROUPED)
        placed = across_groups(placed.withColumn("table", F.pmod("shard", F.lit(tables))), block_rows)
        pairs, crowded = sought(placed, candidates_across(nearest), ACROSS)
        # a link joins two groups, so few pairs of two are compared, of all tables together
        place = F.row_number().over(Window.partitionBy("root_a", "root_b").orderBy("far", "a", "b"))
        pairs = stored(pairs.withColumn("place", place), "pairs")
        later = pairs.where(F.col("place") > nearest)
        crowded = stored(crowded.unionByName(later.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "crowded")
        similar = _similar(pairs.where(F.col("place") <= nearest), sets, ["root_a", "root_b"])
        new = stored(similar.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "new-links")
        if not new.isEmpty():
            more = components(new).select(F.col("a").alias("root"), F.col("b").alias("less"))
            roots = stored(roots.join(more, "root", "left").select("node", F.coalesce("less", "root").alias("root")), "roots")
        nearest *= 4
    return own, roots


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The input rows, all columns, one of each group of near-duplicates: that of the smallest id (null last), of the smallest
    text hash where ids are equal. Texts without words are one group. A table without copies stays as it is."""
    own, roots = similar_groups(docs, id_col, text_col, block_rows)
    last = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    kept_id, kept_hash, own_id, own_hash, place = (own_name(docs, n) for n in ("kept_id", "kept_hash", "own_id", "own_hash", "place"))
    best = own.join(roots, "node").groupBy("root").agg(F.min(last).alias("m")).select(
        F.col("m.doc_id").alias(kept_id), F.col("m.text_hash").alias(kept_hash))
    best = stored(best, "kept")
    joined = docs.withColumn(own_id, F.col(id_col).cast("bigint")).withColumn(own_hash, F.xxhash64(F.col(text_col).cast("string"))).join(
        best, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)))
    # equal rows: one of them; the join has dealt and sorted the rows by these columns already
    first = F.row_number().over(Window.partitionBy(own_id, own_hash).orderBy(own_id))
    return joined.withColumn(place, first).where(F.col(place) == 1).select(*[F.col(c) for c in docs.columns])
