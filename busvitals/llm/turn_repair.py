"""Repair of a conversation's structure by lightest derivations.

A conversation is put right if its turns read ``s?(ua)+`` (an optional system turn, then user and assistant in turn), or
nothing is left. The edits of one row (keep, rerole, delete) and insertions are deductions between items "the rows up to i
are dealt with, and the grammar is in state q". A weight is the pair (cost, audit), the audit being the edits' initials; a
deduction adds its cost and appends its initial. Both are monotone, since equal costs of one item never have one audit
begin the other, so Knuth's agenda applies: the least open item is final when popped, until the goal is.

A conversation may be far longer than a task should hold, so the derivation is cut at fixed numbers of rows. A stretch
inside a conversation derives the items "from state p at its start to q at its end" for every p, and a second agenda
combines pairs of such items, weights added and appended as before. Whatever is stored or shuffled per stretch has the
size of the stretch's audit; texts are read again only to write the repaired ones.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.llm.text import WHITE
from busvitals.sources.scratch import stored

STRETCH = 1024  # rows of which a stretch has at most as many
CHUNK_BYTES = 1 << 20
KEEP, REROLE, DELETE, INSERT = (0, "K"), (2, "R"), (3, "D"), (2, "I")
CUT_OFF = 1  # what a truncated row costs more, unless it is deleted
USER, ASSISTANT = "user", "assistant"
# states: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
GOALS = (START, ANSWERED)
FOLLOWS = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
WRITES = {"u": USER, "a": ASSISTANT}  # roles that edits may give
LEGAL = {"su", "ua", "au"}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
MOST = 2**63 - 1

Weight = tuple[int, str]
Item = tuple


def lightest(axioms: Iterable[tuple[Weight, Item]], deduce: Callable[[Item, Weight], Iterable[tuple[Weight, Item]]],
             goal: Callable[[Item], bool] = lambda item: False) -> dict[Item, Weight]:
    """Knuth's agenda: final weights of the items derived up to the first goal, or of all.

    ``deduce`` names what follows from an item just made final; its weights must not be less than those they come from.
    """
    agenda, final = [(w, item) for w, item in axioms], {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goal(item):
            break
        for next_weight, next_item in deduce(item, weight):
            if next_item not in final:
                heapq.heappush(agenda, (next_weight, next_item))
    return final


def row_edits(initial: str, fault: int, state: int) -> Iterator[tuple[int, str, int]]:
    """Edits of a row in a state of the grammar: cost, initial, state after it."""
    yield (*DELETE, state)
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT_OFF if fault == TRUNCATED else 0
    for role, after in FOLLOWS[state].items():
        if role == initial:
            yield KEEP[0] + more, KEEP[1], after
        elif role in WRITES:
            yield REROLE[0] + more, REROLE[1], after


def derive(rows: list[tuple[str, int]], begins: Iterable[int], ends: bool) -> dict[tuple[int, int], Weight]:
    """Lightest derivations over a stretch of rows (initial of the role, fault), from each state of ``begins``: (from, to) -> weight.
    If the conversation ``ends`` with the stretch, the agenda stops at the first goal."""
    out = {}
    for begin in begins:

        def deduce(item: Item, weight: Weight) -> Iterator[tuple[Weight, Item]]:
            at, state = item
            for role, after in FOLLOWS[state].items():
                if role in WRITES:
                    yield (weight[0] + INSERT[0], weight[1] + INSERT[1]), (at, after)
            if at < len(rows):
                for cost, initial, after in row_edits(*rows[at], state):
                    yield (weight[0] + cost, weight[1] + initial), (at + 1, after)

        goal = (lambda item: item[0] == len(rows) and item[1] in GOALS) if ends else (lambda item: False)
        final = lightest([((0, ""), (0, begin))], deduce, goal)
        out |= {(begin, state): weight for (at, state), weight in final.items() if at == len(rows)}
    return out


def combine(stretches: list[dict[tuple[int, int], Weight]]) -> Weight:
    """The lightest derivation of a conversation from those of its stretches: a prefix item and an item of the next stretch
    together derive a longer prefix."""

    def deduce(item: Item, weight: Weight) -> Iterator[tuple[Weight, Item]]:
        k, state = item
        if k < len(stretches):
            for (begin, end), (cost, audit) in stretches[k].items():
                if begin == state:
                    yield (weight[0] + cost, weight[1] + audit), (k + 1, end)

    final = lightest([((0, ""), (0, START))], deduce, lambda item: item[0] == len(stretches) and item[1] in GOALS)
    return min(w for (k, state), w in final.items() if k == len(stretches) and state in GOALS)


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """An audit in parts that deal with so many rows each; insertions go with the row after them, the last with the last part."""
    out, at = [], 0
    for k, size in enumerate(sizes):
        begin, rows = at, 0
        while rows < size:
            rows += audit[at] != INSERT[1]
            at += 1
        out.append(audit[begin:] if k == len(sizes) - 1 else audit[begin:at])
    return out


def applied(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str] | None]:
    """Turns (role, text) of part of an audit, one state after the other; rows are taken as they come."""
    rows = iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == INSERT[1] else next(rows)
        if edit == DELETE[1]:
            continue
        if edit == KEEP[1]:
            state = FOLLOWS[state][role[:1]]
        else:
            initial = next(r for r in FOLLOWS[state] if r in WRITES)
            state, role = FOLLOWS[state][initial], WRITES[initial]
        yield role, text


def state_after(audit: str, initials: Iterable[str], state: int) -> int:
    """The grammar's state after part of an audit."""
    for role, _ in applied(audit, state, ((i, "") for i in initials)):
        state = FOLLOWS[state][role[:1]]
    return state


# rows


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns with planted faults, by ``crc32("conv:turn") % 20``: 0 drops a row, 1 empties its text, 2 takes out its
    ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls count as one space, ids and turns only inside that hash."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.when(kind == 4, USER).otherwise(space(role_col)).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("kind", "copy")


def ordered(turns: DataFrame) -> DataFrame:
    """Stored rows with ``at``, a number that grows with (conversation, turn, role, text); nulls first. Rows are dealt by ranges
    of that order, so a conversation of any size is many tasks' work; rows alike in all parts are dealt by where they come from."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")] + [F.col("from")]
    dealt = turns.withColumn("from", F.spark_partition_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(dealt.drop("from").withColumn("at", F.monotonically_increasing_id()), "turns")


def _hash(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Ordered rows and the first ``fault`` of each: blank; alike in role and text to an earlier row of the conversation; cut
    off before a full stop. The rest of the columns is narrow: the texts stay where they are."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    narrow = turns.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), _hash("role").alias("role_hash"),
                          _hash("text").alias("text_hash"), last.alias("last"))
    firsts = narrow.groupBy("conv_id", "role_hash", "text_hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role_hash").alias("r"), F.col("text_hash").alias("t"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role_hash") == F.col("r")) & (F.col("text_hash") == F.col("t"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("first") < F.col("at"), DUPLICATE).when(
        ~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return narrow.join(firsts, same, "left").select("conv_id", "turn", "at", "initial", fault.alias("fault"))


def stretch(rows: int) -> Column:
    """The stretch of a row: so many places."""
    return F.expr(f"at div {int(rows)}")


STRETCHES = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("conv_id", "stretch", "n", "blank", "duplicate", "truncated", "illegal")],
    *[T.StructField(n, T.StringType()) for n in ("first_role", "last_role")],
    T.StructField("initials", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.LongType()) for n in ("least_turn", "most_turn", "turns")],
    *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("begins", "ends", "costs")],
    T.StructField("audits", T.ArrayType(T.StringType())),
])
VERDICTS = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("conv_id", "stretch", "state", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("part", T.StringType()), T.StructField("audit", T.StringType()), T.StructField("closes", T.BooleanType()),
])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of sorted batches by equal keys."""
    for value, rows in groupby((row for batch in batches for row in batch.to_pylist()), lambda row: row[key]):
        yield value, list(rows)


def _stretch_row(conv: int | None, number: int, rows: list[dict], opens: bool, closes: bool) -> tuple:
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    roles = [r["initial"] for r in rows]
    faults = [r["fault"] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
    found = derive(list(zip(roles, faults)), STATES if opens else (START,), not closes and not opens)
    ways = sorted(found.items())
    return (conv, number, len(rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, roles[0], roles[-1],
            roles if opens or closes else None,
            *((turns[0], turns[-1], len(turns)) if turns else (None, None, 0)),
            [b for (b, _), _ in ways], [e for (_, e), _ in ways], [c for _, (c, _) in ways], [a for _, (_, a) in ways])


def stretches(facts: DataFrame, stretch_rows: int = STRETCH) -> DataFrame:
    """One row per conversation and stretch: its faults, its roles at both ends, its turns, and its lightest derivations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for number, held in _runs(batches, "stretch"):
                by_conv = [list(own) for _, own in groupby(held, lambda row: row["conv_id"])]
                for k, own in enumerate(by_conv):  # the first and the last one of a stretch may go on outside
                    yield _stretch_row(own[0]["conv_id"], number, own, k == 0, k == len(by_conv) - 1)

        yield from batched(rows(), STRETCHES, lambda r: 200 + 20 * r[2])

    slim = facts.select("conv_id", "turn", "at", "initial", "fault", stretch(stretch_rows).alias("stretch"))
    return slim.repartition("stretch").sortWithinPartitions("stretch", "at").mapInArrow(run, STRETCHES)


def _verdicts(parts: list[dict]) -> Iterator[tuple]:
    """A conversation's stretches, in order, to one verdict, given out stretch by stretch."""
    cost, audit = combine([{(b, e): (c, a) for b, e, c, a in zip(p["begins"], p["ends"], p["costs"], p["audits"])} for p in parts])
    illegal = sum(p["illegal"] for p in parts) + sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(parts, parts[1:]))
    seen = [p for p in parts if p["turns"]]
    gaps = 0
    if seen:  # rows are in the order of turns, so only the turn at a seam can be counted twice
        distinct = sum(p["turns"] for p in seen) - sum(a["most_turn"] == b["least_turn"] for a, b in zip(seen, seen[1:]))
        gaps = min(MOST, seen[-1]["most_turn"] - seen[0]["least_turn"] + 1 - distinct)
    whole = [gaps, *[sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated")], illegal, cost]
    state = START
    for k, (p, own) in enumerate(zip(parts, cut_audit(audit, [p["n"] for p in parts]))):
        closes = k == len(parts) - 1
        yield (p["conv_id"], p["stretch"], state, *whole, own, audit if closes else None, closes)
        if not closes:
            state = state_after(own, p["initials"], state)


def verdicts(spans: DataFrame) -> DataFrame:
    """One row per conversation and stretch with the ``part`` of the audit that is about it and the ``state`` before; the row
    that ``closes`` a conversation has the whole audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (v for _, parts in _runs(batches, "conv_id") for v in _verdicts(parts))
        yield from batched(rows, VERDICTS, lambda r: 200 + len(r[9]) + len(r[10] or ""))

    return spans.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(run, VERDICTS)


REPAIRED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("stretch", T.LongType()),
                         T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType())])
HASHES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])


def repaired_text(turns: DataFrame, judged: DataFrame, stretch_rows: int = STRETCH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The repaired conversations as text, ``role:text`` joined by line feeds: pieces ``text`` of about ``chunk_bytes`` in
    the order of ``stretch`` and ``chunk``, to be joined by line feeds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            turn_rows = (row for batch in batches for row in batch.to_pylist())
            for (number, conv), own in groupby(turn_rows, lambda row: (row["stretch"], row["conv_id"])):
                verdict = next(own)  # comes before the turns it is about
                held, size, chunk = [], 0, 0
                for role, text in applied(verdict["part"], verdict["state"], ((row["role"], row["text"]) for row in own)):
                    held.append(f"{role}:{text}")
                    size += len(text)
                    if size >= chunk_bytes:
                        yield conv, number, chunk, "\n".join(held)
                        held, size, chunk = [], 0, chunk + 1
                if held:
                    yield conv, number, chunk, "\n".join(held)

        yield from batched(rows(), REPAIRED, lambda r: len(r[3]))

    # one shuffle of texts, and no join: verdicts are rows among the turns
    rows = turns.select("conv_id", stretch(stretch_rows).alias("stretch"), "at", "role", "text").unionByName(
        judged.select("conv_id", "stretch", "state", "part"), allowMissingColumns=True)
    order = ["stretch", "conv_id", F.col("at").asc_nulls_first()]
    return rows.repartition("stretch").sortWithinPartitions(*order).mapInArrow(run, REPAIRED)


def digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's pieces. A hash reads its text from front to back, so a conversation is one task's
    stream, of pieces and in the memory of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own, state = (), None
            for batch in batches:
                for conv, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if own != (conv,):
                        if state is not None:
                            yield own[0], state.hexdigest()
                        own, state = (conv,), hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(text.as_buffer())
            if state is not None:
                yield own[0], state.hexdigest()

        yield from batched(rows(), HASHES)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "chunk").select("conv_id", "text").mapInArrow(run, HASHES)


EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, stretch_rows: int = STRETCH, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The verdicts of all conversations, one row each (``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``), and their repaired texts in pieces.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. Null roles and texts count as one
    space; a null id is a conversation of its own; null turns come first and have no gaps; rows of one turn are ordered by role
    and text; repeated rows are duplicates; an empty table has no conversations. Texts may have any length.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed = ordered(turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role"), space("text")))
    judged = stored(verdicts(stretches(with_faults(placed), stretch_rows)), "verdicts")
    return judged.where("closes").select("conv_id", *COUNTS, "audit"), repaired_text(placed, judged, stretch_rows, chunk_bytes)


def repaired_digests(turns: DataFrame, every: DataFrame, stretch_rows: int = STRETCH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The verdict and the hash of the repaired text of every conversation in ``every`` (``conv_id``), with or without turns."""
    verdict, pieces = repair(turns, stretch_rows, chunk_bytes)
    hashes = digests(pieces)
    verdict = verdict.select(F.struct("*").alias("v"))
    hashes = hashes.select(F.struct("*").alias("h"))
    name = F.col("conv_id")
    both = every.select(name.cast("bigint").alias("conv_id")).distinct().join(verdict, name.eqNullSafe(F.col("v.conv_id")), "left").join(
        hashes, name.eqNullSafe(F.col("h.conv_id")), "left")
    return both.select(
        "conv_id", *[F.coalesce(F.col(f"v.{n}"), F.lit(0).cast("bigint")).alias(n) for n in COUNTS],
        F.coalesce("v.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
