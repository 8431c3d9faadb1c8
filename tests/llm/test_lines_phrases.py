"""Line deduplication and phrase mining against brute force, on tables that hold the odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from busvitals.llm import collocations as phrases_
from busvitals.llm import line_dedup
from tests.llm.tables import ROWS, SCHEMA, by_row, documents

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


# lines


def key_of(line):
    return line.strip(WHITE).translate(LOWER)


def lines_left(rows, min_docs, min_chars=1, keep_first=False):
    found, first = Counter(), {}
    for i, t, *_ in rows:
        keys = [key_of(x) for x in (t or "").split("\n")]
        found.update({k for k in keys if len(k) >= min_chars})
    gone = {k for k, n in found.items() if n >= min_docs}
    if keep_first:
        for i, t, *_ in rows:
            for at, x in enumerate((t or "").split("\n")):
                place = (i is None, i or 0, line_dedup_tag(t), at)
                k = key_of(x)
                if k in gone and (k not in first or place < first[k]):
                    first[k] = place
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for at, x in enumerate(lines) if key_of(x) not in gone or first.get(key_of(x)) == (i is None, i or 0, line_dedup_tag(t), at)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


TAGS: dict = {}


def line_dedup_tag(text):
    return TAGS[text or ""]


def line_rows():
    rng = random.Random(4)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["ÄB ß", "x", "", " \t", "日本"]
    rows = [(k, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else " " * rng.randrange(3) + rng.choice(pool) + "\r" * rng.randrange(2)
                          for _ in range(rng.randrange(1, 9))), "en", "a") for k in range(100, 160)]
    hot = [(k, "the hot line\n" + ("the hot line\n" if k % 3 else "") + f"own {k}", "en", "a") for k in range(200, 300)]
    return ROWS + rows + hot + [(None, "the hot line\nno id", None, None), (None, None, None, None), (400, "\n\n\n", "en", "a"), (5000, "one\n" * 20_000 + "end", "en", "a")]


@pytest.mark.parametrize("min_docs,min_chars,keep_first", [(10, 1, False), (2, 1, False), (2, 1, True), (5, 6, True), (1, 3, True)])
def test_lines(spark, min_docs, min_chars, keep_first):
    rows = line_rows()
    docs = documents(spark, rows)
    TAGS.update({r.t: r.h for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()})
    maps = line_dedup.keep_bitmaps(docs, min_docs, min_chars, keep_first)
    got = line_dedup.kept_texts(docs, maps)
    assert by_row(got, "doc_id", "n_lines", "n_dropped", "text") == lines_left(rows, min_docs, min_chars, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_over_many_partitions(spark, keep_first):
    """A line of a third of all rows covers several partitions, and so do rare ones at their edges."""
    rows = line_rows()
    docs = documents(spark, rows)
    TAGS.update({r.t: r.h for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, 3, keep_first=keep_first))
        assert by_row(got, "doc_id", "n_lines", "n_dropped", "text") == lines_left(rows, 3, keep_first=keep_first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keep_first", [False, True])
def test_judged_in_any_batches(keep_first):
    """Sorted rows cut into partitions and batches at every place give the same decisions."""
    rng = random.Random(8)
    rows = sorted((rng.randrange(6), rng.randrange(2), rng.randrange(9), 0, rng.randrange(3)) for _ in range(70))
    seen, full = set(), []
    for k, row in enumerate(rows):
        full.append((*row, row[:3] not in seen, k))
        seen.add(row[:3])
    n = Counter(r[:2] for r in full if r[5])
    least = {}
    for r in full:
        least.setdefault(r[:2], r[2:5])
    want = {r[:5] for r in full if n[r[:2]] >= 4 and not (keep_first and least[r[:2]] == r[2:5])}
    from pyspark.sql.pandas.types import to_arrow_schema
    shape = to_arrow_schema(line_dedup.LINES)
    for parts in range(1, 12):
        for size in (1, 3, 7, 100):
            rows_out = []
            for p in range(parts):
                own = full[p * len(full) // parts:(p + 1) * len(full) // parts]
                batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[a:a + size]), shape.types)], schema=shape)
                           for a in range(0, len(own), size)]
                for b in line_dedup.judged(iter(batches), 4, keep_first):
                    rows_out += [tuple(r.values()) for r in b.to_pylist()]
            got = {(r[1], r[2], r[3], r[4], r[5]) for r in rows_out if r[0] == line_dedup.DECIDED}
            edge, total = defaultdict(list), Counter()
            for r in rows_out:
                if r[0] == line_dedup.OPEN:
                    edge[r[1:3]].append(r[3:6])
                    total[r[1:3]] += r[6]
            for k, places in edge.items():
                if total[k] >= 4:
                    got |= {(*k, *x) for x in places if not (keep_first and x == min(places))}
            assert got == want, (parts, size)


def test_lines_keep_columns_and_empty(spark):
    docs = documents(spark, line_rows()).selectExpr("*", "1 AS kept_text", "2 AS bitmap", "3 AS tag", "4 AS n_lines", "5 AS keep", "6 AS doc")
    out = line_dedup.deduplicated_lines(docs, min_docs=10)
    assert out.columns == docs.columns
    clash = ["kept_text", "bitmap", "tag", "n_lines", "keep", "doc", "size"]
    assert {tuple(r[c] for c in clash) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, "x")}
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert out.count() == docs.count()
    assert line_dedup.deduplicated_lines(docs.limit(0)).count() == 0


# phrases


def mined(rows, most_words, least, cover, best):
    out = []
    pieces = defaultdict(list)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            pieces[lang if lang is not None else "und"].append(re.findall(r"[^\x20\x09]+", piece))
    for lang, own in pieces.items():
        n = sum(map(len, own))
        f = Counter(tuple(w[a:a + k]) for w in own for k in range(1, most_words + 1) for a in range(len(w) - k + 1))
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * c >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, c in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "old", "Mill", "river", "naïve", "日本", "a", "of"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None]), "a") for k in range(100, 160)]
    return ROWS + rows + [(1, "red tape rolls on " * 40, "en", "a"), (2, "\x1c sep \x85 kept x " * 12, "und", None), (3, ".,;:!?", "fr", None)]


@pytest.mark.parametrize("most_words,least,cover,best,block", [(5, 8, 100, 2000, 1 << 20), (4, 5, 60, 7, 300), (2, 3, 100, 50, 40), (5, 2, 100, 3000, 5000)])
def test_phrases(spark, most_words, least, cover, best, block):
    rows = [r for r in phrase_rows() if r[1] is None or len(r[1]) < 50_000]
    got = phrases_.collocations(documents(spark, rows), most_words, least, cover, best, block_bytes=block)
    assert by_row(got, *COLUMNS) == mined(rows, most_words, least, cover, best)


def test_phrase_counts_pass_64_bits(spark):
    """1000 * a * n of these counts does not fit 64 bits."""
    big = 4_000_000_000_000
    row = spark.createDataFrame([(big, big * 5, 3, big)], "a bigint, n bigint, l bigint, r bigint")
    value = row.select(phrases_.score(*[row[c] for c in row.columns])).first()[0]
    assert value == 1000 * big * big * 5 // (3 * big)


def test_phrases_of_nothing(spark):
    assert phrases_.collocations(documents(spark).limit(0)).count() == 0
    assert phrases_.collocations(documents(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "a.b", "en", "a")]), least=1).count() == 0


def test_long_text_is_parted_between_pieces(spark):
    text = ". ".join("w%d the cat sat" % (k % 3) for k in range(2000))
    rows = [(1, text, "en", "a"), (2, "no mark at all " * 3000, "en", "a")]
    got = phrases_.collocations(spark.createDataFrame(rows, SCHEMA), 5, 50, 100, 100, block_bytes=999)
    assert by_row(got, *COLUMNS) == mined(rows, 5, 50, 100, 100)


def test_word_block_positions():
    _, _, n, n_keys, steps, ids, keys, counts = phrases_.word_block(7, "en", b"a b\nc  a\n\nb")
    names = zlib.decompress(keys).split(b" ")
    at = np.cumsum(phrases_._loose(steps, "<u4"))
    assert [names[i] for i in phrases_._loose(ids, "<i4")] == [b"a", b"b", b"c", b"a", b"b"] and list(np.diff(at)) == [1, 2, 1, 3]
    assert (n, n_keys) == (5, 3) and dict(zip(names, phrases_._loose(counts, "<u4"))) == {b"a": 2, b"b": 2, b"c": 1}
    assert phrases_.word_block(7, "en", b" \n ") is None


def test_phrases_over_many_shards(spark, monkeypatch):
    rows = [r for r in phrase_rows() if r[1] is None or len(r[1]) < 50_000]
    monkeypatch.setattr(phrases_, "SHARD_PHRASES", 50)
    got = phrases_.collocations(documents(spark, rows), 4, 3, 100, 500, block_bytes=700)
    assert by_row(got, *COLUMNS) == mined(rows, 4, 3, 100, 500)
