"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from busvitals.llm import turn_repair as tr

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def space(v):
    return " " if v is None else str(v)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Bellman-Ford over strings of output initials: no agenda, no states but what has been written."""
    best = {"": (0, "", ())}

    def join(n, r):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[n].get(r)

    def insert_all(table):
        for _ in range(4):
            for n, (c, a, t) in list(table.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    m = join(n, r)
                    new = (c + 2, a + "I", (*t, (name, "")))
                    if m is not None and (m not in table or new[:2] < table[m][:2]):
                        table[m] = new

    for (role, text), fault in zip(rows, faults):
        insert_all(best)
        fresh = {}

        def offer(m, new):
            if m is not None and (m not in fresh or new[:2] < fresh[m][:2]):
                fresh[m] = new

        for n, (c, a, t) in best.items():
            offer(n, (c + 3, a + "D", t))
            if fault not in ("b", "d"):
                more = fault == "t"
                offer(join(n, role[:1]) if role else None, (c + more, a + "K", (*t, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    offer(join(n, r), (c + 2 + more, a + "R", (*t, (name, text))))
        best = fresh
    insert_all(best)
    return min((best[n] for n in ("", "a") if n in best), key=lambda w: w[:2])


def expected(rows, damage=True):
    convs = defaultdict(list)
    for conv, *_ in rows:
        convs[conv]
    for conv, turn, role, text in after_damage(rows) if damage else rows:
        convs[conv].append((turn is not None, turn or 0, space(role), space(text)))
    out = []
    for conv, own in convs.items():
        own.sort()
        turns = {t for given, t, _, _ in own if given}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [(role, text) for _, _, role, text in own]
        faults = faults_of(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, turns_left = cheapest(pairs, faults) if own else (0, "", ())
        assert SHAPE.match("".join(role[0] for role, _ in turns_left))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_left).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def turn_rows():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        turns = rng.sample(range(-3, 30), rng.randrange(1, 12))
        for turn in sorted(turns):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice(["Yes.", "No!", "no end", "", " \t\x0b", None, "Why? \n", "naïve 日本.", "x.\x1c"])))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(300)]  # a long one
    rows += [(None, t, "user", "same.") for t in (1, 2, None, None)] + [(901, None, "system", "a."), (901, None, "user", "b.")]
    rows += [(902, 5, "assistant", "tie."), (902, 5, "user", "tie."), (902, 5, "user", "tie."), (902, 2**62, "user", "far."), (902, -2**62, "user", "off")]
    rows += [(903, 1, "user", "long " * 50_000 + "."), (903, 2, "assistant", "   " * 100_000 + "x")]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("stretch_rows,chunk", [(1024, 1 << 20), (7, 5), (1, 1)])
def test_repair(spark, stretch_rows, chunk):
    rows = turn_rows()
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS at", "'y' AS stretch", "'z' AS fault").repartition(5)
    assert results(tr.repaired_digests(tr.damaged(turns), turns, stretch_rows, chunk)) == expected(rows)
    assert results(tr.repaired_digests(turns, turns, stretch_rows, chunk)) == expected(rows, damage=False)


def test_whole_table(spark):
    """The registered query on a whole table."""
    from busvitals.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op11_lightest_derivation"](spark, "/root/testdata/sf0.01")) == expected(rows)


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert tr.repaired_digests(turns, turns).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(lost, 0, "user", "gone.")], SCHEMA)
    assert results(tr.repaired_digests(tr.damaged(turns), turns)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_pieces_give_the_repaired_text(spark):
    rows = [(1, 0, "user", "q."), (1, 1, "user", "q2."), (1, 2, "assistant", "a"), (2, 0, "tool", "t.")]
    verdict, pieces = tr.repair(spark.createDataFrame(rows, SCHEMA))
    text = {r.conv_id: r.text for r in pieces.collect()}
    assert {r.conv_id: (r.cost, r.audit) for r in verdict.collect()} == {1: (3, "KIKK"), 2: (3, "D")}
    assert text == {1: "user:q.\nassistant:\nuser:q2.\nassistant:a"}


def every_audit(rows, most):
    """Audits of at most ``most`` insertions at each place, by enumeration."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        for holes in product(range(most + 1), repeat=len(rows) + 1):
            cost, audit, fit = 0, "", True
            reach = {""}
            for k in range(len(rows) + 1):
                for _ in range(holes[k]):
                    cost, audit = cost + 2, audit + "I"
                    reach = {x + r for x in reach for r in "ua"}
                if k == len(rows):
                    break
                initial, fault = rows[k]
                audit += edits[k]
                if edits[k] == "D":
                    cost += 3
                    continue
                if fault in (tr.BLANK, tr.DUPLICATE):
                    fit = False
                    break
                cost += (fault == tr.TRUNCATED) + (2 if edits[k] == "R" else 0)
                reach = {x + r for x in reach for r in ("ua" if edits[k] == "R" else initial)}
            if fit and any(SHAPE.match(x) for x in reach) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_lightest_derivation_by_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("uasx"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(4))]
        want = every_audit(rows, 2)
        final = tr.derive(rows, [tr.START], True)
        assert min(w for (_, e), w in final.items() if e in tr.GOALS) == want
        for cut in range(len(rows) + 1):
            parts = [tr.derive(part, tr.STATES, False) for part in (rows[:cut], rows[cut:])]
            assert tr.combine(parts) == want


def test_agenda_is_general():
    """Shortest paths, weights being numbers with their path."""
    edges = {"a": [("b", 4), ("c", 1)], "c": [("b", 2), ("d", 7)], "b": [("d", 1)], "d": []}
    final = tr.lightest([((0, "a"), "a")], lambda x, w: [((w[0] + c, w[1] + y), y) for y, c in edges[x]])
    assert final == {"a": (0, "a"), "c": (1, "ac"), "b": (3, "acb"), "d": (4, "acbd")}
