"""Conversation repair against an exhaustive search and a plain dynamic programme."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postlens.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, turns) by relaxing all grammar states row by row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserts(now):
        for _ in range(4):
            for (q, c), to in step.items():
                if c in "ua" and q in now:
                    cost, audit, turns = now[q]
                    new = (cost + 5, audit + "I", turns + [({"u": "user", "a": "assistant"}[c], "")])
                    if to not in now or new[:2] < now[to][:2]:
                        now[to] = new
        return now

    now = inserts({0: (0, "", [])})
    for (role, text), kind in zip(rows, kinds):
        nxt = {}

        def offer(q, v):
            if q not in nxt or v[:2] < nxt[q][:2]:
                nxt[q] = v

        for q, (cost, audit, turns) in now.items():
            offer(q, (cost + 2, audit + "D", turns))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            for (p, c), to in step.items():
                if p == q and role[:1] == c:
                    offer(to, (cost + more, audit + "K", turns + [(role, text)]))
                if p == q and c in "ua":
                    offer(to, (cost + 1 + more, audit + "R", turns + [({"u": "user", "a": "assistant"}[c], text)]))
        now = inserts(nxt)
    return min((now[q] for q in (0, 3) if q in now), key=lambda v: v[:2])


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def brute(table):
    """The rows (conv_id, turn, role, text) of damaged conversations to the operator's conversations."""
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))

    def key(r):
        return (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())

    out = {}
    for conv, rows in convs.items():
        rows.sort(key=key)
        spoken = [(r, t) for _, r, t in rows]
        kinds = faults(spoken)
        cost, audit, turns = cheapest(spoken, kinds)
        known = [t for t, _, _ in rows if t is not None]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(spoken, spoken[1:])), cost, audit, digest(turns))
    return out


def run(df, segment=repair.SEGMENT):
    done = repair.repair(df, segment)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(done.turns).collect()}
    rows = done.conversations.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, digest([]))) for r in rows}


def conversation(rnd, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Hi.", "Yes!", "No?", "so", "", " \n", None, "Hi.", "é。", "x." + " " * 50, "cut,"]
    turns = sorted(rnd.sample(range(-3, 3 * n + 3), n))
    rows = [(t if rnd.random() > 0.1 else None, rnd.choice(roles), rnd.choice(texts + [f"t{rnd.randint(0, 999)}."] * 12)) for t in turns]
    return rows + [rows[-1]] * rnd.choice([0, 0, 2])


def test_agenda_equals_exhaustive_search():
    """All edits of short conversations, with up to three inserts at each place."""
    grammar = re.compile(r"(s?(ua)+)?")
    rnd = random.Random(3)
    for _ in range(120):
        rows = [(rnd.choice("uas "), rnd.choice(["", "", "truncated", "blank"])) for _ in range(rnd.randint(0, 3))]
        ways = []
        for edits in itertools.product(*[["D", "K", "Ru", "Ra"] for _ in rows]):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                text, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
                for (initial, fault), e, g in zip(rows, edits, gaps[1:]):
                    if e != "D" and fault == "blank":
                        break
                    text += "" if e == "D" else initial if e == "K" else e[1]
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and fault == "truncated" else 0) + 5 * len(g)
                    audit, text = audit + e[0] + "I" * len(g), text + g
                else:
                    if grammar.fullmatch(text):
                        ways.append((cost, audit))
        got = repair.lightest(rows, repair.START)
        assert min(got[q] for q in repair.GOALS if q in got) == min(ways)


def test_equals_a_dynamic_programme(spark):
    rnd = random.Random(1)
    table = [(c, *r) for c in range(150) for r in conversation(rnd, rnd.randint(1, 14))] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    rnd.shuffle(table)
    df = spark.createDataFrame(table, SCHEMA).withColumns({"part": F.lit("x"), "rid": F.lit(None), "cost": F.lit(1)})
    assert run(df.repartition(5)) == brute(table)


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_long_conversations_are_cut(spark, segment):
    """One conversation holds most rows; any cut gives the same answer."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rnd = random.Random(segment)
    table = [(7, *r) for r in conversation(rnd, 400)] + [(c, *r) for c in range(20) for r in conversation(rnd, 3)]
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    try:
        assert run(df, segment) == brute(table)
        parts = repair.repair(df, segment).turns.filter("conv_id = 7").select("part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1  # no task holds the whole conversation


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 5, "user", "x" * 200_000)], SCHEMA)
    assert run(df.limit(0)) == {}
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_the_query_damages_and_repairs(spark):
    """The query against the damage rule and the dynamic programme, over the whole table."""
    sf_dir = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = []
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", digest([])) for c in {r[0] for r in table}} | brute(rows)
    got = queries.QUERIES["op12_structure_repair"](spark, sf_dir)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:9] for r in got.collect()} == want
