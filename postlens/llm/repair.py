"""Conversation structure repair: the cheapest edits, by Knuth's lightest-derivation agenda.

A repaired conversation is empty, or an optional system turn and then pairs of
a user and an assistant turn.  Repairing is a weighted deduction:
- an item [i, q] says that the first i rows have been edited into turns that
  leave the grammar in state q; its value is (cost, audit), the audit holding one
  initial per edit: Keep, Rerole, Delete, Insert;
- a rule derives an item from an item and an edit, with value
  (cost + c, audit + initial).  It is superior: never below its antecedent, and
  monotone in it.  (Two audits of one item and equal cost are never one the
  prefix of the other, as the rest would be inserts at a price, so their order
  holds whatever is appended.)
- the agenda pops items by least value; a popped item is final (Knuth 1977).

A conversation may hold any number of rows, so no task gathers one:
1. Rows, without their texts, are range-partitioned and sorted by
   (conversation, turn): a long conversation is cut by the ranges.  In each
   partition it is cut again, into segments of ``SEGMENT`` rows.
2. A segment's agenda gives the lightest derivation [entry state -> exit state]
   for all entries (only for the start, if the conversation begins there).
3. Per conversation the segments' values are combined in order by the binary
   rule [start -> p] [p -> q] => [start -> q], superior as well, until the goal.
   That holds one row per segment, and the audit, which is one value of the result.
4. Segments replay their part of the audit into turns; kept rows fetch role and
   text by row id.

Defined results: null roles and texts are one space (so blank, and of no
initial); a null turn comes first; rows of one turn are taken in the order of a
digest of role and text, so equal ones are adjacent; a null conversation id is a
conversation of its own.  An empty table gives empty ones.  Extra columns, of any
name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from postlens.llm.common import stored

SEGMENT = 1024
SPACES = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5  # more for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPOKEN = [[NEXT[q, r] for r in "ua" if (q, r) in NEXT] for q in range(4)]  # states after a user or assistant turn
GOALS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")


class Repaired(NamedTuple):
    conversations: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv_id, part, seq, place (their order), edit, role, text


def lightest(rows: list[tuple[str, str]], entry: int) -> dict[int, tuple[int, str]]:
    """Exit state -> (cost, audit) of the lightest derivation from ``entry`` over rows (initial, fault)."""
    agenda, final, out = [(0, "", 0, entry)], set(), {}
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        for to in SPOKEN[q]:
            if (i, to) not in final:
                heappush(agenda, (cost + INSERT, audit + "I", i, to))
        if i == len(rows):
            out[q] = (cost, audit)
            continue
        initial, fault = rows[i]
        heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if fault in ("blank", "duplicate"):
            continue
        price = cost + (TRUNCATED if fault == "truncated" else 0)
        if (q, initial) in NEXT:
            heappush(agenda, (price + KEEP, audit + "K", i + 1, NEXT[q, initial]))
        for to in SPOKEN[q]:
            heappush(agenda, (price + REROLE, audit + "R", i + 1, to))
    return out


# ---------------------------------------------------------------- segments

SEGMENTS = ("conv_id long, part int, seq int, rids array<long>, initials array<string>, blank long, duplicate long, truncated long, "
            "illegal long, turns long, first_turn long, last_turn long, entries array<int>, exits array<int>, costs array<long>, audits array<string>")


def _segment(conv, part: int, seq: int, rows: list[dict], begins: bool) -> dict:
    initials, faults = [r["initial"] for r in rows], [r["fault"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    ways = [(p, q, *v) for p in ([START] if begins else range(4)) for q, v in lightest(list(zip(initials, faults)), p).items()]
    return {"conv_id": conv, "part": part, "seq": seq, "rids": [r["rid"] for r in rows], "initials": initials,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns),
            "first_turn": turns[0] if turns else 0, "last_turn": turns[-1] if turns else 0,
            **dict(zip(("entries", "exits", "costs", "audits"), map(list, zip(*ways))))}


def _segments(size: int):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("rids", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())),
                        *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")],
                        ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of a partition to segments."""
        part, seq, own = TaskContext.get().partitionId(), 0, []
        begins = False  # the range before may hold the conversation's first rows
        for b in batches:
            done = []
            for row in b.to_pylist():
                change = bool(own) and row["conv_id"] != own[0]["conv_id"]
                if change or len(own) == size:
                    done.append(_segment(own[0]["conv_id"], part, seq, own, begins))
                    seq, own, begins = seq + 1, [], change
                own.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if own:
            yield pa.RecordBatch.from_pylist([_segment(own[0]["conv_id"], part, seq, own, begins)], schema=schema)

    return run


FOLDED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()), ("own", pa.string()), ("head", pa.bool_()),
                    *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _fold(rows: list[dict]) -> list[dict]:
    """A conversation's segments in order: the state that each begins in, and the whole conversation on the first one's row."""
    values, chosen = {START: (0, "")}, []
    for r in rows:
        ways = [(values[p][0] + c, values[p][1] + a, q, p, a) for p, q, c, a in zip(r["entries"], r["exits"], r["costs"], r["audits"]) if p in values]
        best = {}
        for cost, audit, q, p, own in sorted(ways, reverse=True):
            best[q] = (cost, audit, p, own)  # the least is set last
        values = {q: v[:2] for q, v in best.items()}
        chosen.append(best)
    goal = min((q for q in GOALS if q in values), key=lambda q: values[q])
    cost, audit = values[goal]
    out, q = [], goal
    for r, best in zip(reversed(rows), reversed(chosen)):
        _, _, p, own = best[q]
        out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "entry": p, "own": own, "head": r is rows[0]})
        q = p
    known = [(r["turns"], r["first_turn"], r["last_turn"]) for r in rows if r["turns"]]
    turns = sum(k[0] for k in known) - sum(a[2] == b[1] for a, b in zip(known, known[1:]))
    joints = sum(a["initials"][-1] + b["initials"][0] not in LEGAL for a, b in zip(rows, rows[1:]))
    out[-1] |= {"gaps": known[-1][2] - known[0][1] + 1 - turns if known else 0, "illegal": sum(r["illegal"] for r in rows) + joints, "cost": cost, "audit": audit,
                **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}}
    return out


def _folds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and place, folded conversation by conversation."""
    own: list[dict] = []
    for b in batches:
        done = []
        for row in b.to_pylist():
            if own and row["conv_id"] != own[0]["conv_id"]:
                done += _fold(own)
                own = []
            own.append(row)
        yield pa.RecordBatch.from_pylist(done, schema=FOLDED)
    if own:
        yield pa.RecordBatch.from_pylist(_fold(own), schema=FOLDED)


EDITS = "conv_id long, part int, seq int, place int, edit string, rid long, new_role string"


def _replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's part of the audit to its turns; a kept or rerolled row is named by its id."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int32()), ("edit", pa.string()), ("rid", pa.int64()), ("new_role", pa.string())])
    for b in batches:
        out = []
        for r in b.to_pylist():
            q, i = r["entry"], 0
            for place, edit in enumerate(r["own"]):
                row = {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "place": place, "edit": edit}
                if edit == "K":
                    q = NEXT[q, r["initials"][i]]
                elif edit in "RI":
                    q = SPOKEN[q][0]  # one at most: user and assistant turns alternate
                    row["new_role"] = ROLES[q]
                if edit != "I":
                    row["rid"] = r["rids"][i]
                    i += 1
                if edit != "D":
                    out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# ---------------------------------------------------------------- the operator

def with_faults(rows: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, initial, same, fault) of a table with row ids; fault is each row's first one, or ''."""
    seen = rows.select("rid", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"),
                       F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
                       F.rtrim("text", F.lit(SPACES)).alias("body"))
    seen = seen.select("rid", "conv_id", "turn", "initial", "same", (F.col("body") == "").alias("blank"),
                       (~F.right("body", F.lit(1)).isin(".", "!", "?")).alias("open"))
    first = seen.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn", "rid")).alias("f"))
    first = first.select(F.col("f.rid").alias("rid"), F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    return seen.join(first, "rid", "left").select("rid", "conv_id", "turn", "initial", "same", fault.alias("fault"))


def repair(conversations: DataFrame, segment: int = SEGMENT) -> Repaired:
    """Repair all rows (conv_id, turn, role, text); see the module text.

    conversations: one row per conversation that has rows.  gaps: turn numbers
    missing between the least and the largest.  blank, duplicate, truncated: rows
    by their first fault.  illegal: adjacent pairs of rows that cannot follow
    each other.  cost and audit: the cheapest edits, ties by the least audit.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "repair-rows")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("same"), F.col("rid")]
    ranged = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("same")
    segments = stored(ranged.mapInArrow(_segments(segment), SEGMENTS), "repair-segments")
    together = segments.drop("rids").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    folded = stored(together.mapInArrow(_folds, from_arrow_schema(FOLDED)), "repair-folded")
    whole = folded.filter("head").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = segments.select("part", "seq", "rids", "initials").join(folded.select("conv_id", "part", "seq", "entry", "own"), ["part", "seq"])
    edits = stored(parts.mapInArrow(_replay, EDITS), "repair-edits")
    place = ["conv_id", "part", "seq", "place", "edit"]
    stay = edits.filter("rid is not null").join(rows.select("rid", "role", "text"), "rid")
    stay = stay.select(*place, F.coalesce("new_role", "role").alias("role"), "text")
    new = edits.filter("rid is null").select(*place, F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repaired(whole, stay.union(new))


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, state, out = None, None, []

    def row():
        return {"conv_id": own[0], "repaired_sha256": state.hexdigest()}

    for b in batches:
        for r in b.to_pylist():
            if own != (r["conv_id"],):
                if own:
                    out.append(row())
                own, state = (r["conv_id"],), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{r['role']}:{r['text']}".encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
            out = []
    if own:
        out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's ``role:text`` lines, newline-joined.

    One hash is one sequence: its turns meet in a task in order, which reads them as a stream and holds none.
    """
    order = ["conv_id", "part", "seq", "place"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
