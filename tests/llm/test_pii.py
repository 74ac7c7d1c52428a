"""Contextual extraction of personal data: seeds against the plain expressions, the graph against a loop."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postlens.llm import pii
from postlens.llm.queries import QUERIES
from corpus_fixtures import documents  # noqa: F401

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def suits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in re.split("[^0-9]+", value) if p), "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def seeds(text):
    """(start, kind number, end) in order."""
    return sorted((m.start(), k, m.end()) for k, (kind, e) in enumerate(PLAIN.items()) for m in e.finditer(text or "") if suits(kind, m[0]))


def listed(spans):
    return ",".join(f"{list(PLAIN)[k]}:{a}:{z}" for a, k, z in spans)


def rows_of(df):
    return sorted(tuple(r) for r in pii.summary(pii.find(df)).collect())


def want(rows):
    out = []
    for i, t in rows:
        s = seeds(t)
        out.append((i, *[sum(x[1] == k for x in s) for k in range(4)], listed(s), listed(s), 0))
    return sorted(out)


EDGES = [
    "a@b.c", "a@b", "@b.c", "x.y%z+1-@h-1.co.uk. Next", "a@b.c@d.e.f", "a@b.c_d@e.f", "a@@b.c", "é@b.c é", "日本 a@b.c 日本",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "001.002.003.0004", "1.2.3", "1..2.3.4", "99999999999999999999.1.1.1", "0.0.0.0256",
    "4111 1111-1111 1111", "4111111111111111", "4111111111111112", "4111  1111 1111 1111", "1 4111111111111111", "4111111111111111-", "0" * 14, "0" * 20,
    "+1 (743) 555-3824", "+1.2.3.4.5.6.7.8.9.0", "+1 (743) 555-38", "+12 345678901234567", "++1 (743) 555-3824)", "+1 () 5", "+1+2 345 678 9012 ..", "", " ", "+",
]


def test_edges_of_the_expressions(spark, documents):
    rows = list(enumerate(EDGES)) + [(100, None), (100, None), (101, " ".join(EDGES)), (101, " ".join(EDGES))]
    assert rows_of(documents(rows, rid=1, kind="k", hits=2, start=3, node="n").repartition(3)) == want(rows)


def test_random_texts(spark, documents):
    rnd = random.Random(4)
    parts = ["4111", "1111", "@", "a", ".b", ".", "-", " ", "+1", "(", ")", "25", "255", "256", "é", "0", "%", "x@y.z", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(3000)]
    got = {(r[0], r[5]) for r in rows_of(documents(rows).repartition(4))}
    assert got == {(r[0], r[5]) for r in want(rows)}


def test_long_texts_need_no_stack(spark, documents):
    rows = [(1, "1" * 300_000), (2, "1." * 200_000), (3, "a." * 200_000 + "@b" + ".c" * 100_000), (4, "+1" + "-" * 300_000), (5, "a" * 300_000), (6, "1 " * 200_000),
            (7, "a@b.c 1.2.3.4 " * 20_000)]
    got = rows_of(documents(rows))
    assert [r[1:5] for r in got] == [(0, 0, 0, 0), (0, 100_000 // 2, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (20_000, 20_000, 0, 0)]
    assert got[6][6] == listed(seeds(rows[6][1]))


def test_empty_table(spark, documents):
    assert rows_of(documents([(1, "a")]).limit(0)) == []


@pytest.fixture(scope="module")
def taught():
    """Phones and cards in their own surroundings, then unseen forms in the same ones, and others."""
    rnd = random.Random(8)
    number = lambda: f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    card = "4111 1111 1111 1111"
    rows = [(i, f"You may call him at +1 {number()} before noon or so.") for i in range(30)]
    rows += [(i, f"Shipped under order number {rnd.randint(10**9, 10**10 - 1)} last week.") for i in range(30, 60)]
    rows += [(60, "You may call him at (212) 555-0100 before noon or so."), (61, "The box weighs (212) 555-0100 grams."), (62, "Shipped under order number (212) 555-0999 last week."),
             (63, f"My card {card} is old."), (64, "Write to: joe(at)mail.example.com now")]
    rows += [(70 + i, f"Please write to: u{i}@mail.example.com now and wait.") for i in range(12)]
    rows += [(82, "Please write to: ann [at] mail [dot] example [dot] com now and wait.")]
    return rows


def test_contexts_find_unseen_forms(spark, documents, taught):
    got = {r[0]: r for r in rows_of(documents(taught).repartition(3))}
    base = {r[0]: r for r in want(taught)}
    for i, t in taught:
        assert got[i][:6] == base[i][:6]  # seeds stay
    added = {i: r[6] for i, r in got.items() if r[7]}
    # the unseen number, wherever it stands; the address behind the same words; no order number
    assert added == {60: "phone:20:34", 61: "phone:15:29", 64: "email:10:33", 82: "email:17:54"}


def test_two_rounds_reach_further(spark, documents):
    """An accepted value teaches the words around it: what only it stands among is found a round later."""
    rnd = random.Random(2)
    seen = [f"(212) 555-{rnd.randint(1000, 9999)}" for _ in range(14)]
    rows = [(i, f"You may call him at +1 (743) 555-{1000 + i} before noon or so.") for i in range(30)]
    rows += [(100 + i, f"You may call him at {v} before noon or so.") for i, v in enumerate(seen)]
    rows += [(200 + i, f"Ring up our desk {v} any day.") for i, v in enumerate(seen)]
    rows += [(300, "Ring up our desk (999) 555-0000 any day.")]
    df = documents(rows)
    once = {r.rid for r in pii.find(df, rounds=1).spans.filter("not base").collect()}
    twice = pii.summary(pii.find(df, rounds=2)).filter("doc_id = 300").first()
    assert twice.spans == "phone:17:31" and len(once) == 28
    assert pii.summary(pii.find(df, rounds=1)).filter("doc_id = 300").first().spans == ""
    assert pii.summary(pii.find(df, rounds=0)).agg(F.sum("n_added")).first()[0] == 0


def test_copies_prove_nothing(spark, documents):
    """Two values in many copies are below the support of three."""
    rows = [(i, f"You may call him at +1 (743) 555-100{i % 2} before noon or so.") for i in range(200)]
    rows += [(500, "You may call him at (212) 555-0100 before noon or so.")]
    assert [r for r in rows_of(documents(rows)) if r[7]] == []


def test_scores_equal_a_loop(spark):
    """Two rounds of pattern and candidate scores on a random graph."""
    rnd = random.Random(6)
    nodes = [(n, rnd.choice([0, 1, 2, 3, 3, 5, 5, 4])) for n in range(160)]
    nodes = [(n, c, [c == k if c < 4 else rnd.random() < 0.7 if c == 5 and k else c == 4 and k == 0 for k in range(4)]) for n, c in nodes]
    edges = [(f"p{rnd.randint(0, 12) if c in (3, 5) else rnd.randint(0, 40)}", n, c, can) for n, c, can in nodes for _ in range(3)]
    edges = list({(p, n): (p, n, c, can) for p, n, c, can in edges}.values())

    def patterns(known):
        out = {}
        for p in {e[0] for e in edges}:
            trust = []
            for k in range(4):
                pos = count = neg = 0
                for _, n, c, can in (e for e in edges if e[0] == p):
                    kind, score = (c, 1000) if c < 4 else known.get(n, (None, 0))
                    if kind == k:
                        pos, count = pos + score, count + 1
                    elif kind is not None or not can[k]:
                        neg += 1
                trust.append(1000 * pos // (pos + 1000 * neg + 1000) if count >= pii.SUPPORT else 0)
            out[p] = trust
        return out

    def accepted(trust, known):
        out = dict(known)
        for n, c, can in nodes:
            if c < 4 or n in known:
                continue
            best = (0, 0)
            for k in range(4):
                doubt = sum(math.floor(-1e6 * math.log1p(-trust[p][k] / 1000)) for p, m, *_ in edges if m == n and can[k] and trust[p][k] >= pii.CONFIDENT)
                best = max(best, (1000 - math.ceil(1000 * math.exp(-doubt / 1e6)), -k))
            if best[0] >= pii.ACCEPTED:
                out[n] = (-best[1], best[0])
        return out

    df = spark.createDataFrame(edges, "pattern string, node long, class int, can array<boolean>")
    first = accepted(patterns({}), {})
    got = pii._accepted(df, pii._patterns(df, None))
    assert first and {r.node: (r.kind, r.score) for r in got.collect()} == first
    second = accepted(patterns(first), first)
    known = spark.createDataFrame([(n, k, s) for n, (k, s) in first.items()], "node long, kind int, score long")
    new = pii._accepted(df, pii._patterns(df, known)).join(known, "node", "left_anti")
    assert {r.node: (r.kind, r.score) for r in new.collect()} | first == second


def test_the_query_equals_the_plain_expressions(spark):
    """Seeds of the whole table; what is added overlaps none of them."""
    sf_dir = "/root/testdata/sf0.01"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_contextual_pii"](spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == [r[:5] + (hashlib.sha256(r[5].encode()).hexdigest(),) for r in want(table)]


def test_no_python_in_the_plan(spark, documents):
    plan = pii.summary(pii.find(documents([(1, "a@b.c")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
