"""Operators on documents against brute force, on tables that hold the odd cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard

from busvitals.llm import quality_rules as quality_rules_module
from busvitals.llm import simhash, suffix_dedup
from busvitals.llm.mixing import mix, mixed_documents
from busvitals.llm.packing import pack, sequences
from busvitals.llm.quality_rules import kept_documents, quality_rules
from busvitals.llm.tokens import ids, packed
from tests.llm.tables import ROWS, SCHEMA, by_row, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


# quality rules


def base_counts(text):
    w, text = words(text), text or ""
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {p for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


REPEATS = [(20, "a b c a b c x", "en", "a"), (21, ("l1 x\n\nl2\nl1 x\n \n \n") * 9, "en", "a"), (22, "z " * 400, "en", "a"), (23, "# * <>" * 9, "en", "a")]


def test_quality_counts(spark):
    rows = ROWS + REPEATS
    got = quality_rules(documents(spark, rows))
    want = sorted(((i, *base_counts(t)) for i, t, _, _ in rows), key=repr)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in got.collect() if r.base_failed and r.kept]


def test_quality_bands(spark):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 60)) for _ in range(400))
    lines = "\n".join(f"item {k}: the same sentence about nothing follows here, number {k}" for k in range(400))
    rows = [(1, noise, "en", "a"), (2, lines, "en", "a")]
    assert not any(r.kept for r in quality_rules(documents(spark, rows)).collect())


def test_quality_finds_junk_in_a_part_of_a_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = sorted((r.text for r in quality_rules(docs).where("kept").join(docs, "doc_id").select("text").collect()), key=lambda t: (len(t), t))[-20:]
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    noise = " ".join("".join(rng.choice(letters, 60)) for _ in range(400))
    whole = max(clean, key=lambda t: len(t.encode())).encode()
    cut = lambda n: whole[:n].decode(errors="ignore")
    assert len(whole) >= 20_000
    rows = [(1, cut(20_000) + " " + noise[:20_000], "en", "a"), (2, cut(8_192) + " " + noise[:4_095], "en", "a"), (3, cut(1_500) + " " + noise[:700], "en", "a")]
    rows += [(10, cut(20_000), "en", "a"), (11, cut(8_192), "en", "a"), (12, cut(1_500), "en", "a")]
    assert {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()} == {1: False, 2: False, 3: False, 10: True, 11: True, 12: True}


def test_quality_keeps_columns_and_empty(spark):
    docs = documents(spark)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality_rules(docs).where("kept").collect())
    assert quality_rules(documents(spark, [])).count() == kept_documents(documents(spark, [])).count() == 0


# packing


def test_packing_round_trip(spark):
    pieces = pack(documents(spark), length=64).collect()
    whole = defaultdict(list)
    for p in pieces:
        assert 0 < p.length == len(p.ids) // 4 and p.offset + p.length <= 64
        whole[p.sequence_id].append(p)
    last = max(whole)
    assert sorted(whole) == list(range(last + 1))
    for s, own in whole.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert s == last or sum(p.length for p in own) == 64
    encoder = ids()
    want = Counter((i, packed(encoder.exactly(t or "") + [0])) for i, t, _, _ in ROWS)
    # pieces of one document follow each other in the stream; its start is where a new one begins
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    got, held = Counter(), b""
    for p in stream:
        assert p.start == len(held) // 4
        held += p.ids
        if len(held) // 4 == p.doc_tokens:
            got[p.doc_id, held] += 1
            held = b""
    assert got == want and not held


def test_packing_sequences_and_empty(spark):
    pieces = pack(documents(spark), length=128)
    rows = sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert sorted(r.n_tokens for r in rows)[1:] == [128] * (len(rows) - 1)
    assert pack(documents(spark, [])).count() == 0


# mixing


def test_mix_targets_and_copies(spark):
    docs = documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    left, open_ = total, set(order)
    while True:  # reshare what is above the limit until none is
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= full
        if not open_:
            break
    for r in rows:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.copies <= 3
        if sizes[r.source]:
            ratio = target[r.source] / sizes[r.source]
            assert int(ratio + 1e-9) <= r.copies <= int(ratio) + 1
    assert by_row(mix(docs), "doc_id", "copies") == by_row(mix(docs.repartition(5)), "doc_id", "copies")


def test_mix_blocks_and_columns(spark):
    rows = [(k, "w " * (k % 90 + 1), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(3_000)]
    got = mix(documents(spark, rows), block_rows=100).groupBy("source").agg({"target": "max", "source": "count"}).collect()
    taken = Counter()
    for r in mix(documents(spark, rows), block_rows=100).collect():
        taken[r.source] += r["size"] * r.copies
    for r in got:
        assert abs(taken[r.source] / r["max(target)"] - 1) < 0.03
    docs = documents(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == mix(docs).groupBy().sum("copies").first()[0]
    assert mixed_documents(documents(spark, [])).count() == mix(documents(spark, [])).count() == 0
    assert mix(documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])).where("target = 0").count() == 2


# SimHash


def slow_fingerprint(text, k=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(numbers, radius):
    root = {x: x for x in numbers}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in numbers:
        for b in numbers:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {x: top(x) for x in numbers}


def test_simhash_documents(spark):
    rows = ROWS + [(k, "Abc " + " ".join(f"q{k * j % 17}" for j in range(k % 9)), "en", "a") for k in range(30, 70)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [(i, slow_fingerprint(t)) for i, t, _, _ in rows]
    group = slow_groups({p for _, p in prints}, 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in prints), key=repr)
    assert by_row(simhash.near_duplicates(documents(spark, rows)), "doc_id", "fingerprint", "component_id") == want and len(got) == len(rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows", [5, 2_000])
def test_links_of_clusters(spark, shard_rows):
    rng = np.random.default_rng(3)
    numbers = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            numbers.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
    want = {a: b for a, b in slow_groups(numbers, 3).items()}
    df = spark.createDataFrame([(simhash.signed(x),) for x in numbers], "print bigint")
    got = simhash.components(simhash.links(df, 3, shard_rows)).collect()
    least = {r.a: r.b for r in got}
    groups = defaultdict(set)
    for x in numbers:
        groups[least.get(simhash.signed(x), simhash.signed(x))].add(x)
    other = defaultdict(set)
    for a, b in want.items():
        other[b].add(a)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_shard_links_match_brute_force():
    rng = np.random.default_rng(5)
    for radius in (0, 1, 3, 6):
        numbers = [int(x) for x in np.unique(rng.integers(0, 1 << 10, 200))]
        links = dict(simhash.shard_links(numbers, radius))
        assert {x: links.get(x, x) for x in numbers} == slow_groups(numbers, radius)


def test_one_of_each(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{k}" for k in range(4_000)]
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(30)]
    rows, family = [], {}
    for k, t in enumerate(texts):
        for c in range(4):  # three near copies of each: a word changed here and there
            w = t.split()
            for _ in range(c):
                w[int(rng.integers(0, len(w)))] = "changed"
            rows.append((10 * k + c, " ".join(w), "en", "a"))
            family[10 * k + c] = k
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (0, rows[0][1], "en", "a")]
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(30)] + [900]
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_one_of_each_keeps_what_is_not_similar(spark):
    """Pairs that fingerprints within the radius cannot tell apart are decided by their sets, and repeats do not count."""
    rng = np.random.default_rng(11)
    rows, similar = [], {}
    for k in range(120):
        w = [f"v{x}" for x in rng.integers(0, 100_000, 304)]
        changed = list(w)
        for at in range(10, 10 + 5 * (8, 12)[k % 2], 5):  # 40 or 60 of 300 shingles: similarity 0.76 and 0.67
            changed[at] = "changed"
        close = list(w)
        for at in range(10, 35, 5):  # 25 of 300 shingles: similarity 0.85
            close[at] = "other"
        rows += [(10 * k, " ".join(w), "en", "a"), (10 * k + 1, " ".join(changed), "en", "a"), (10 * k + 2, " ".join(close), "en", "a")]
    line = "one line that is found again and again "
    rows += [(5_000 + k, line * 300 + " ".join(f"u{x}" for x in rng.integers(0, 100_000, 100)), "en", "a") for k in range(5)]
    shingles = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t, _, _ in rows}
    for k in range(120):
        a, b, c = (shingles[10 * k + j] for j in range(3))
        similar[k] = [len(x & y) / len(x | y) for x, y in ((a, b), (a, c), (b, c))]
    assert all(s[0] < 0.8 <= s[1] and s[2] < 0.8 for s in similar.values())
    left = {r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()}
    assert {i for i, *_ in rows if i % 10 != 2 or i >= 5_000} <= left
    assert sum(10 * k + 2 in left for k in range(120)) <= 2


def test_large_shards_are_worked_on_in_blocks(spark):
    rng = np.random.default_rng(12)
    nodes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 5_000)]
    placed = spark.createDataFrame([(7, x, 100, b"x") for x in nodes] + [(8, x, 100, b"y") for x in nodes[:90]], simhash.TABLES)
    members = defaultdict(list)
    for r in simhash.in_blocks(placed, 100).collect():
        members[r.shard].append(r.node)
    assert sorted(members.pop(8)) == sorted(nodes[:90]) and len(members) == 50
    assert set().union(*members.values()) == set(nodes) and max(map(len, members.values())) < 250
    leaders = set.intersection(*map(set, members.values()))
    assert leaders == set(sorted(nodes)[:len(leaders)]) and 10 < len(leaders) < 60

    base = [f"v{x}" for x in rng.integers(0, 100_000, 200)]
    rows = []
    for k in range(400):  # copies of one text with a word changed
        w = list(base)
        w[int(rng.integers(0, 200))] = f"changed{k}"
        rows.append((k, " ".join(w), "en", "a"))
    rows.append((900, " ".join(f"v{x}" for x in rng.integers(0, 100_000, 200)), "en", "a"))
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows), block_rows=50).collect()) == [0, 900]


def test_groups_joined_by_one_pair_are_one(spark):
    """Two groups of 13 whose members have all their nearest partners in their own group, and one link between them."""
    rng = np.random.default_rng(21)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    rows, between = [], []
    for k in range(12):
        base = [f"v{x}" for x in rng.integers(0, 1_000_000, 304)]

        def changed(words, places, mark):
            out = list(words)
            for at in places:
                out[at] = f"{mark}{at}"
            return out

        bridge = changed(base, range(10, 60, 10), "b")
        one = [base] + [changed(base, (70 + 18 * j, 79 + 18 * j), "x") for j in range(12)]
        two = [bridge] + [changed(bridge, (70 + 18 * j, 79 + 18 * j), "y") for j in range(12)]
        rows += [(100 * k + j, " ".join(w), "en", "a") for j, w in enumerate(one + two)]
        sets = [{tuple(w[j:j + 5]) for j in range(300)} for w in one + two]
        between.append([(a, b) for a in range(13) for b in range(13, 26) if jaccard(sets[a], sets[b]) >= 0.8])
    assert all(b == [(0, 13)] for b in between)
    for block_rows in (2_000, 10):
        left = sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows), block_rows=block_rows).collect())
        assert left == [100 * k for k in range(12)]


def test_tree_of_wide_fingerprints_finds_all_within_the_radius():
    rng = np.random.default_rng(31)
    wide = rng.integers(0, 1 << 63, (300, simhash.LANES)).astype(np.uint64)
    for k in range(100, 280):  # a cluster, and equal ones
        wide[k] = wide[k % 2]
        for bit in rng.integers(0, 256, k % 40):
            wide[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    me, at, far = simhash.WideTree(wide).within(np.arange(300), simhash.SIMILAR_RADIUS)
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(2, dtype=int)
    want = {(i, j, apart[i, j]) for i, j in zip(*np.where(apart <= simhash.SIMILAR_RADIUS)) if i != j}
    assert set(zip(me, at, far)) == want and len(me) == len(want)


def test_counts_of_parts_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(32)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(pool[rng.random(400) < share]) for share in (0.9, 0.95, 0.99, 0.5, 0.1) for _ in range(20)]
    spreads = np.array([np.frombuffer(simhash.spread(x), np.uint16) for x in sets])
    size = np.array([len(x) for x in sets])
    a, b = (x.ravel() for x in np.indices((100, 100)))
    may = simhash.may_share(size, spreads, a, b)
    shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    similar = shared >= 0.8 * (size[a] + size[b] - shared)
    assert may[similar].all() and not may.all() and similar.any()


def test_more_partners_than_are_compared_at_first_are_compared_later(spark, monkeypatch):
    """One link joins two groups; other candidates lie between them, and one only is compared at first."""
    rng = np.random.default_rng(33)
    monkeypatch.setattr(simhash, "NEAREST", 1)
    node, size = np.arange(40), np.full(40, 100)
    wide, group = np.zeros((40, simhash.LANES), np.uint64), np.arange(40) % 2
    wide[:, 0] = (1 << np.arange(40)).astype(np.uint64)
    few, all_ = (list(simhash.near_pairs(node, size, wide, n, group)) for n in (1, 400))
    assert {p[0] for p in few if p[2] < 0} == set(range(40)) and len(set(all_)) == 400
    assert all(p[2] >= 0 and p[3:] == (1, 0) for p in all_)
    rows = []
    for k in range(6):
        base = [f"v{x}" for x in rng.integers(0, 1_000_000, 304)]
        swap = lambda words, places, mark: [f"{mark}{i}" if i in places else x for i, x in enumerate(words)]
        bridge = swap(base, range(10, 60, 10), "b")
        one = [base] + [swap(base, (70 + 18 * j, 79 + 18 * j), "x") for j in range(12)]
        two = [bridge] + [swap(bridge, (70 + 18 * j, 79 + 18 * j), "y") for j in range(12)]
        rows += [(100 * k + j, " ".join(w), "en", "a") for j, w in enumerate(one + two)]
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()) == [100 * k for k in range(6)]


def test_a_pair_of_groups_is_the_work_of_one_table_and_block():
    """Members that meet in many tables and, but for the largest group's, in several blocks: each pair is given out once."""
    rng = np.random.default_rng(34)
    n, bits, tables = 60, 6, 12
    wide = np.zeros((n, simhash.LANES), np.uint64)
    for k in range(n):
        for bit in rng.integers(0, 256, 20):
            wide[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    node, size, group = np.arange(n), np.full(n, 100), np.maximum(np.arange(n) - 9, 0)  # the first ten are one group
    chosen = rng.random((tables, 256)).argsort(1)[:, :bits]
    keys = np.array(list(simhash.table_keys(wide.view(np.uint8), chosen)))
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(2, dtype=int)
    meet = (keys[:, :, None] == keys[:, None, :]).any(0) & (apart <= simhash.SIMILAR_RADIUS) & (group[:, None] > group[None])
    given, blocks = [], 3
    for table, key in enumerate(keys):
        for value in np.unique(key):
            for block in range(blocks):
                inside = np.flatnonzero((key == value) & ((group > 0) | (node % blocks == block)))
                place = np.where(group[inside] == 0, simhash.DEALT, np.where(inside % blocks == block, simhash.HOME, simhash.COPY))
                check = simhash.met_elsewhere(wide[inside], chosen[:table], place)
                given += simhash.near_pairs(node[inside], size[inside], wide[inside], 1_000, group[inside], elsewhere=check)
    assert all(p[2] >= 0 for p in given)
    assert sorted(p[:2] for p in given) == sorted(zip(*np.where(meet)))


def test_groups_of_a_whole_table_match_brute_force(spark):
    """All pairs of a table whose shingle sets share 0.8 of their union: groups are their chains, and no two others are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[r.doc_id] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, own in sets.items():
        shared = Counter(j for x in own for j in holders[x] if j < i)
        pairs |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)}
    empty = sorted(i for i, own in sets.items() if not own)
    for i, j in [*pairs, *((i, empty[0]) for i in empty[1:])]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    own, roots = simhash.similar_groups(docs)
    got = {r.doc_id: r.root for r in own.join(roots, "node").select("doc_id", "root").collect()}
    assert len(pairs) > 50 and sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    least = {}
    for i in sorted(got):
        assert find(least.setdefault(got[i], i)) == find(i)


def test_quality_verdict_matches_brute_force(spark):
    """The whole verdict, by plain loops over the stated rules, on a table."""
    squeeze = lambda raw: len(zstandard.ZstdCompressor(level=3).compress(raw))

    def limit(bands, size, which):
        at = [math.log(b[0]) for b in bands]
        x = math.log(size)
        if x >= at[-1]:
            return bands[-1][which]
        k = next(k for k in range(len(at) - 1) if at[k] <= x <= at[k + 1])
        return bands[k][which] + (bands[k + 1][which] - bands[k][which]) * (x - at[k]) / (at[k + 1] - at[k])

    def verdict(text):
        raw, words = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
        times = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if times[tuple(words[k:k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(inside) > 50 * len(words):
            return False
        whole, pieces = quality_rules_module.WHOLE_BANDS, quality_rules_module.CHUNK_BANDS
        if len(raw) >= whole[0][0]:
            ratio = len(raw) / squeeze(raw)
            if not limit(whole, len(raw), 1) <= ratio <= limit(whole, len(raw), 2):
                return False
        fit = [b for b in pieces if 2 * b[0] <= len(raw)] or [pieces[0]]
        size, low, high = fit[-1]
        starts = list(range(0, len(raw) - size + 1, size))
        if starts and len(raw) % size:
            starts.append(len(raw) - size)
        bad = sum(not low <= size / squeeze(raw[k:k + size]) <= high for k in starts)
        return bad <= 0.05 * len(starts)

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert got == {i: verdict(t) for i, t in texts.items()} and len(set(got.values())) == 2


# repeated passages


def slow_passages(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - length + 1):
            key = suffix_dedup.LAST if i is None else i
            s = b[k:k + length]
            first[s] = min(key, first.get(s, key))
    out = []
    for i, b in texts:
        key, mark = suffix_dedup.LAST if i is None else i, bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key:
                mark[k:k + length] = b"\1" * length
        spans = sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot_rows", [2, 5_000])
def test_passages_match_brute_force(spark, hot_rows):
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdé \n"), 160))
    rows = [r for r in ROWS if r[0] != 6] + [(k, "".join(rng.choice(list("ab "), 90)) + passage[k % 7:] * (k % 3) + "a" * (k % 140), "en", "a") for k in range(40, 90)]
    got = suffix_dedup.repeated_passages(documents(spark, rows), hot_rows=hot_rows)
    assert by_row(got, *FIELDS) == slow_passages([(r[0], r[1]) for r in rows])


def test_passages_rewritten(spark):
    docs = documents(spark)
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.repeated_passages(docs).collect() if r.doc_id not in (2, None)}
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(len((texts[i] or "").encode()) == n for i, n in want.items())
    assert texts[3] is None and texts[4] == ""
    for f in (suffix_dedup.deduplicated, suffix_dedup.repeated_passages):
        assert f(documents(spark, [])).count() == 0


def test_passages_of_many_rows_without_or_with_one_id(spark):
    rng = np.random.default_rng(11)
    shared = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(40)]
    own = lambda k: f"{k} ".join(shared[int(j)] for j in rng.integers(0, 40, 10))
    texts = [own(k) for k in range(1_000)]
    rows = [(k, shared[k] + shared[k + 20], "en", "a") for k in range(20)]
    rows += [(None if k % 2 else 5_000, texts[k], "en", "a") for k in range(1_000)]
    rows += [(None, texts[1], "en", "a")] * 500 + [(5_000, texts[2], "en", "a")] * 500
    got = suffix_dedup.repeated_passages(documents(spark, rows))
    assert by_row(got, *FIELDS) == slow_passages([(r[0], r[1]) for r in rows])


def test_intervals_by_themselves():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 3_000).astype(np.uint8)
    starts = np.arange(0, 2_980)
    for length in (5, 9, 14):
        string, begins = suffix_dedup.common_intervals(text, starts, length)
        got = sorted(sorted(x.tolist()) for x in np.split(string, begins[1:])) if len(string) else []
        same = defaultdict(list)
        for k, s in enumerate(starts):
            same[bytes(text[s:s + length])].append(k)
        assert got == sorted(v for v in same.values() if len(v) > 1)


def test_ids_agree_with_the_library(spark):
    encoder = ids()
    for text in ["", " a", "a  b", "it's 's \xa0x y\x1c z \x85q", "日本語 é", "a<|endoftext|> b", *[t for _, t, _, _ in ROWS if t]]:
        assert encoder.encode(text) == encoder.exactly(text)
    for text in (r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()):
        assert encoder.encode(text or "") == encoder.exactly(text or "")
    assert zlib.crc32(packed([1, 2])) == zlib.crc32(b"\1\0\0\0\2\0\0\0") and SCHEMA
