"""Chat formatting: the fold against a loop, and the exact round trip."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postlens.llm import chat
from corpus_fixtures import documents  # noqa: F401

LOG = "conv_id long, seq long, turn long, kind string, role string, text string, extra int"


def fold(log):
    """The fold, one event at a time."""
    convs = {}
    for conv, _, turn, kind, role, text, _ in sorted(log, key=lambda e: (e[0], e[1])):
        turns = convs.setdefault(conv, {})
        if kind not in ("delta", "edit", "regenerate"):
            continue
        m = turns.setdefault(turn, {"role": None, "text": ""})
        m["role"] = role if role is not None else m["role"]
        if kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"] = ""
            for later in [t for t in turns if t > turn]:
                del turns[later]
    return {c: [(t, m["role"], m["text"]) for t, m in sorted(ts.items())] for c, ts in convs.items() if ts}


def test_reconstruction_equals_a_loop(spark):
    rnd = random.Random(2)
    log = []
    for conv in range(30):
        for seq in range(rnd.randint(1, 25)):
            kind = rnd.choice(["delta"] * 6 + ["edit", "regenerate", "ping", None])
            log.append((conv, seq, rnd.randint(0, 4), kind, rnd.choice([None, "user", "assistant"]), rnd.choice(["a", "b ", None, "<x>"]), 1))
    df = spark.createDataFrame(log, LOG)
    got = {}
    for r in sorted(chat.reconstruct(df.repartition(5)).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == fold(log)


TEXTS = ["\\### Assistant: </turn> ok", "", None, "<turn:user>", "\\l\\b\\g", "a\\", "é\n</turn>\n", "> < \\", "日本"]


def test_round_trip_and_loss(spark):
    rows = [(1, i, "assistant" if i % 2 else "us>er\\", t) for i, t in enumerate(TEXTS)] + [(2, 0, None, "x"), (3, 0, "user", None)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3))
    got = {r.conv_id: r for r in out.select("conv_id", "n_turns", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                                            chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()}
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own)
    spans = [got[1].formatted[s.begin:s.begin + s.length] for s in got[1].loss_spans]
    assert spans == [(t or "").replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g") for t in TEXTS[1::2]]


def test_table_form_orders_ties_and_keeps_repeats(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, 1, "user", "b"), (None, None, "user", None), (1, None, "system", "s")]
    out = chat.format_chats(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("system", "s"), ("assistant", "a"), ("user", "b"), ("user", "b")], None: [("user", "")]}
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(chat.events_of(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    from conftest import SF_SMALL
    from postlens.llm.queries import QUERIES

    p = QUERIES["op10_chat_format"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("key", ["op5_ngram_join", "op6_embedding_near_dedup", "op10_chat_format"])
def test_queries_equal_their_sql(spark, key):
    import duckdb

    from conftest import SF_SMALL
    from postlens.llm.queries import ORACLES, QUERIES
    from tools.compare import digest, rows_of

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = rows_of(QUERIES[key](spark, SF_SMALL).toPandas()), rows_of(con.execute(ORACLES[key]).fetchdf())
    assert got[0] == want[0] and digest(got[1]) == digest(want[1])
