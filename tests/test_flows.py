"""Answers in sequence and kept answers, compacted live tables, numbers without texts."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlens.operators import numbering, topics
from postlens.sources import fixtures
from postlens.streaming import live

from conftest import SF_SMALL

TREND_KEYS = ["postTimeRaw", "tag"]


def batches(spark, n, size=3):
    rows = [(b, b * size + i, b * size + i + 1, f"t{(b * 7 + i * 5) % 23} u{b % 4}") for b in range(n) for i in range(size)]
    return spark.createDataFrame(rows, "batch_id long, rn long, index long, tweetText string")


def answer(texts):
    """What the model of these tests says to a prompt: every word a topic, every second one a subtopic too."""
    words = sorted({w for t in texts for w in t.split()})
    return words, words[::2]


def model(log=None):
    def fn(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                if log:
                    with open(os.path.join(log, f"{r.batch_id}-{os.getpid()}-{len(os.listdir(log))}"), "w"):
                        pass
                topic = sorted({w for t in r.texts for w in t.split()})  # as ``answer``; workers do not know this module
                sub = topic[::2]
                q = lambda ws: "[" + ", ".join(f'"{w}"' for w in ws) + "]"
                out.append((r.batch_id, f'So: {{"issue": [], "faq": [{{"index": 1, "text": "x", "topic": {q(topic)}, "subtopic": {q(sub)}}}]}}'))
            yield pd.DataFrame(out, columns=["batch_id", "response"])

    return fn


def sequential(rows, wave, before=()):
    """The vocabulary shown to each batch by a plain loop."""
    known, out = set(before), {}
    texts = {}
    for b, _, _, t in rows:
        texts.setdefault(b, []).append(t)
    for w in range(max(texts) // wave + 1):
        own = [b for b in sorted(texts) if b // wave == w]
        lines = {}
        for kind, level, term in known:
            lines.setdefault(f"{kind} {level}", []).append(term)
        text = "\n".join(sorted(f"{k}: {', '.join(sorted(v))}" for k, v in lines.items()))
        for b in own:
            out[b] = text
        for b in own:
            topic, sub = answer(texts[b])
            known |= {("faq", "topic", t) for t in topic} | {("faq", "subtopic", t) for t in sub}
    return out


@pytest.mark.parametrize("wave", [1, 4])
def test_vocabulary_in_sequence_equals_a_loop(spark, tmp_dir, wave):
    df = batches(spark, 6)
    got = topics.answers_in_waves(df, model(), f"{tmp_dir}/w", wave)
    assert {r.batch_id: r.vocabulary for r in got.collect()} == sequential([tuple(r) for r in df.collect()], wave)


def test_waves_go_on_where_they_stopped(spark, tmp_dir):
    """A failing wave stores nothing; the next run asks only what has no answer, with terms known beforehand."""
    os.mkdir(f"{tmp_dir}/log")
    df = batches(spark, 5)
    vocab = spark.createDataFrame([("faq", "topic", "old")], topics.VOCABULARY)

    present = model(f"{tmp_dir}/log")

    def failing(it):
        for pdf in it:
            if (pdf["batch_id"] >= 3).any():
                raise RuntimeError("the model is away")
            yield from present(iter([pdf]))

    with pytest.raises(Exception, match="the model is away"):
        topics.answers_in_waves(df, failing, f"{tmp_dir}/w", 1, vocab)
    asked = lambda: sorted(int(f.split("-")[0]) for f in os.listdir(f"{tmp_dir}/log"))
    assert asked() == [0, 1, 2]
    got = topics.answers_in_waves(df, model(f"{tmp_dir}/log"), f"{tmp_dir}/w", 1, vocab)
    assert {r.batch_id: r.vocabulary for r in got.collect()} == sequential([tuple(r) for r in df.collect()], 1, [("faq", "topic", "old")])
    assert asked() == [0, 1, 2, 3, 4]
    empty = topics.answers_in_waves(df.limit(0), model(), f"{tmp_dir}/e")
    assert empty.count() == 0 and empty.columns == got.columns


def test_nothing_is_asked_twice(spark, tmp_dir):
    """The same prompts again, a few more, and a replay: only new prompts reach the model."""
    os.mkdir(f"{tmp_dir}/log")
    df = batches(spark, 6)
    prompts = topics.prompt_batches(df)
    asked = lambda: len(os.listdir(f"{tmp_dir}/log"))
    first = sorted(topics.ask(prompts.filter("batch_id < 4"), model(f"{tmp_dir}/log"), f"{tmp_dir}/a").collect())
    assert asked() == 4
    every = sorted(topics.ask(prompts, model(f"{tmp_dir}/log"), f"{tmp_dir}/a").collect())
    assert asked() == 6 and every[:4] == first and len(every) == 6

    def refuse(it):
        raise RuntimeError("asked")

    assert sorted(topics.ask(prompts, refuse, f"{tmp_dir}/a").collect()) == every
    with pytest.raises(Exception, match="asked"):  # the same prompt with another vocabulary is another question
        topics.ask(prompts.withColumn("vocabulary", F.lit("faq topic: x")), refuse, f"{tmp_dir}/a").collect()
    topics.record_answers(prompts.withColumn("vocabulary", F.lit("v")), spark.createDataFrame(every, "batch_id long, response string"), f"{tmp_dir}/a")
    assert sorted(topics.ask(prompts.withColumn("vocabulary", F.lit("v")), refuse, f"{tmp_dir}/a").collect()) == every


# ---------------------------------------------------------------- live tables

def increments(spark, path, n):
    """``n`` batches as a stream leaves them, compacted every tenth; returns the posts of all."""
    p = fixtures.posts(spark, SF_SMALL).select("post_id", "postTimeRaw", "tag")
    rows = p.collect()
    schema = p.schema
    for b in range(n):
        own = spark.createDataFrame([r for r in rows if r.post_id % n == b], schema)
        live.trend_increments(own).coalesce(1).write.mode("overwrite").parquet(f"{path}/_batch={b}")
        if b % 10 == 0:
            live.compact(spark, path, live.TREND, TREND_KEYS, b - 1)
    return p


def test_readers_see_few_files_after_fifty_batches(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    p = increments(spark, path, 50)
    got = live.totals(spark, path, live.TREND, TREND_KEYS)
    want = sorted(live._added(live.trend_increments(p), live.TREND, TREND_KEYS).collect())
    assert sorted(got.collect()) == want
    assert len(got.inputFiles()) <= 12
    assert live.snapshot(spark, path)[1] == 39
    assert len(os.listdir(f"{path}/_snapshots")) <= 3


def test_replays_around_a_snapshot(spark, tmp_dir):
    """A batch that the snapshot holds is not counted again; one after it replaces its own increments; a broken snapshot does not count."""
    path = f"{tmp_dir}/t"
    p = increments(spark, path, 25)
    want = sorted(live.totals(spark, path, live.TREND, TREND_KEYS).collect())
    one = p.filter("post_id % 25 = 22")
    live.trend_increments(one).write.mode("overwrite").parquet(f"{path}/_batch=22")
    old = p.filter("post_id % 25 = 3")
    assert live.snapshot(spark, path)[1] == 19
    live.trend_increments(old).write.mode("overwrite").parquet(f"{path}/_batch=3")  # a stray replay: already in the snapshot
    assert sorted(live.totals(spark, path, live.TREND, TREND_KEYS).collect()) == want
    os.makedirs(f"{path}/_snapshots/upto=24")  # broken off before its end
    assert live.snapshot(spark, path)[1] == 19
    assert sorted(live.totals(spark, path, live.TREND, TREND_KEYS).collect()) == want
    live.compact(spark, path, live.TREND, TREND_KEYS, 24)
    assert live.snapshot(spark, path)[1] == 24
    assert sorted(live.totals(spark, path, live.TREND, TREND_KEYS).collect()) == want


def test_totals_of_nothing(spark, tmp_dir):
    assert live.totals(spark, f"{tmp_dir}/none", live.TREND, TREND_KEYS).count() == 0


# ---------------------------------------------------------------- numbers

def test_numbers_are_given_without_texts(spark):
    """Neither the exchange nor the written index holds a text; ties and nulls get numbers of their own."""
    rows = [(i % 7 if i % 5 else None, i % 3, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    index = numbering.order_index(df, ["a", "b"], 4)
    assert index.columns == ["a", "b", "_rn"]
    got = numbering.global_row_number(df, ["a", "b"], partitions=4).collect()
    assert sorted(r.rn for r in got) == list(range(1, 201)) and sorted((r.a is None, r.a, r.b, r.t) for r in got if r.a is not None) == sorted(
        (a is None, a, b, t) for a, b, t in rows if a is not None)
    by_number = [(r.a is None, r.a or 0, r.b) for r in sorted(got, key=lambda r: r.rn)]
    assert by_number == sorted(by_number)


def test_batch_assign_moves_no_text(spark):
    import __spark_entry__ as E

    df = E.queries()["batch_assign"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in p.splitlines() if "Exchange" in line]
    assert not any("tweetText" in line for line in exchanges)


# ---------------------------------------------------------------- files and times

def test_csv_tells_marks_from_texts(spark, tmp_dir):
    from postlens.sources import files

    texts = [None, "", "\\N", "\\\\N", "\\", "\\\\", "\\a", " \\N", '"\\N"', "a\\N\n\\N", "N", "\\N\\N"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    files.write_csv(df, f"{tmp_dir}/c")
    assert [r.t for r in sorted(files.read_csv(spark, f"{tmp_dir}/c", df.schema).collect())] == texts


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_lenient_times_do_not_depend_on_the_session(spark, zone):
    import datetime as dt

    from postlens.functions.time import parse_any_time

    want = {"2024-03-31T02:30:15.250Z": dt.datetime(2024, 3, 31, 2, 30, 15, 250000), "2024-03-31 02:30": dt.datetime(2024, 3, 31, 2, 30),
            " 2024-03-10 ": dt.datetime(2024, 3, 10), "2024-03-31T04:30:15+02:00": dt.datetime(2024, 3, 31, 2, 30, 15),
            "1969-12-31T23:00:00-00:30": dt.datetime(1969, 12, 31, 23, 30), "2024-13-01": None, "soon": None, "": None, None: None,
            "2024-03-10 02:30:00": dt.datetime(2024, 3, 10, 2, 30), "12:30": None}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", parse_any_time("t").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r.t: r.p for r in rows} == want


# ---------------------------------------------------------------- nested articles

def nested(html):
    """Contents of all articles by a stack-free scan over their tags."""
    import re

    tags = list(re.finditer(r"(?i)<article(?=[\s>/])[^>]*>|</article\s*>", html))
    out = []
    for i, t in enumerate(tags):
        if t[0].startswith("</"):
            continue
        depth, end = 1, len(html)
        for u in tags[i + 1:]:
            depth += -1 if u[0].startswith("</") else 1
            if depth == 0:
                end = u.start()
                break
        out.append(html[t.end():end])
    return out


def test_articles_nest_as_their_tags_do(spark):
    import random

    from postlens.operators import extract

    rnd = random.Random(5)
    parts = ["<article>", "<ARTICLE class='a>b'>", "</article>", "</Article >", "text", "<p>é</p>", "\n", "<articles>", "<article\n id=1>", "</articles>"]
    pages = [(i, "u", "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(400)]
    pages += [(1000, "u", None), (1001, "u", ""), (1002, "u", "<article>" * 300 + "x" + "</article>" * 150)]
    got = {}
    for r in sorted(extract.articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect(), key=lambda r: (r.page_id, r.article_no)):
        got.setdefault(r.page_id, []).append(r.article)
    want = {i: nested(h) for i, _, h in pages if h and nested(h)}
    assert got == want


# ---------------------------------------------------------------- the model inside the stream

def test_a_failing_micro_batch_asks_nothing_twice_when_it_runs_again(spark, tmp_dir):
    """The model is away, comes back, and the batch is replayed: topics once, rejects set aside once, each prompt asked once."""
    from postlens.plans.cleaning import AS_OF
    from postlens.schemas import TOPICS
    from postlens.sources import store
    from postlens.streaming import ingest as sing

    os.mkdir(f"{tmp_dir}/log")
    posts = fixtures.posts(spark, SF_SMALL)
    log = f"{tmp_dir}/log"

    def fn(it):
        for pdf in it:
            if not os.path.exists(f"{log}/back"):
                raise RuntimeError("the model is away")
            out = []
            for r in pdf.itertuples():
                with open(f"{log}/asked-{r.batch_id}", "a") as f:
                    f.write("x")
                item = f'{{"index": {r.indexes[0]}, "text": "t", "topic": ["a"], "subtopic": ["b"]}}'
                out.append((r.batch_id, "no JSON here" if r.batch_id % 4 == 3 else f'{{"issue": [], "faq": [{item}]}}'))
            yield pd.DataFrame(out, columns=["batch_id", "response"])

    def config(state):
        return sing.IngestConfig(posts_path=f"{tmp_dir}/p", topics_path=f"{tmp_dir}/t", state_path=f"{tmp_dir}/{state}", rules=fixtures.topic_rules(spark),
                                 as_of=AS_OF, model=fn, answers_path=f"{tmp_dir}/a", quarantine_path=f"{tmp_dir}/q")

    with pytest.raises(Exception, match="the model is away"):
        sing.ingest_batch(spark, posts, 0, config("s"))
    assert not store.store_exists(spark, f"{tmp_dir}/s")  # nothing committed: the batch will come again
    open(f"{log}/back", "w").close()
    first = sing.ingest_batch(spark, posts, 0, config("s"))
    n = store.read_store(spark, f"{tmp_dir}/p").count()
    batches = -(-n // 20)
    assert first["posts_added"] == 0 and first["rejected"] == batches // 4 and first["topics_added"] == batches - batches // 4
    again = sing.ingest_batch(spark, posts, 0, config("other"))  # as after a lost commit
    assert again["posts_added"] == again["topics_added"] == 0 and again["rejected"] == first["rejected"]
    asked = [open(f"{log}/{f}").read() for f in os.listdir(log) if f.startswith("asked")]
    assert len(asked) == batches and set(asked) == {"x"}
    assert spark.read.parquet(f"{tmp_dir}/q").count() == first["rejected"]
    assert store.read_store(spark, f"{tmp_dir}/t", TOPICS).count() == first["topics_added"]
