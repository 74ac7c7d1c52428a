"""What is moved when there is much of it: texts stay where they are until the rows are few."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from postlens.operators import clean, firsts, topics
from postlens.plans import labelling, storage
from postlens.session import settings, work_dir
from postlens.sources import fixtures, store, work

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["clean_posts", "dedup_first_seen"])
def test_many_winners_are_picked_below_the_join_that_brings_texts(spark, monkeypatch, key):
    few = E.queries()[key](spark, SF_SMALL)
    monkeypatch.setattr(firsts, "BROADCAST_ROWS", 0)
    many = E.queries()[key](spark, SF_SMALL)
    p = plan(many)
    assert p.index("Inner") < p.index("LeftSemi")  # the first semi-join lies inside the join with the documents
    assert sorted(many.collect()) == sorted(few.collect())


def stages(spark, name: str, action) -> int:
    """How many stages the jobs of ``action`` had."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker = sc.statusTracker()
    return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))


def test_a_load_is_written_without_a_shuffle(spark, tmp_dir):
    """Days mixed in every task, more of them than files may be open: all rows come back, each day under its folder."""
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf)
    text = F.concat(F.lit("t"), F.col("id"))
    df = spark.range(0, 6000, 1, 3).select(F.col("id").alias("post_id"), text.alias("tweetText"), F.lit(2024).alias("year"),
                                           (F.col("id") % 4 + 1).cast("int").alias("month"), F.when(F.col("id") % 31 > 0, F.col("id") % 31).cast("int").alias("day"))
    assert stages(spark, "load", lambda: store.write_partitioned(df, f"{tmp_dir}/s")) == 1
    assert spark.conf.get(conf) == before
    back = spark.read.schema(df.schema).parquet(f"{tmp_dir}/s")
    assert sorted(back.collect(), key=lambda r: r.post_id) == sorted(df.collect(), key=lambda r: r.post_id)


def test_a_small_append_leaves_one_file_a_day(spark, tmp_dir):
    df = spark.range(0, 400, 1, 4).select(F.col("id").alias("post_id"), F.lit(2024).alias("year"), F.lit(1).alias("month"), (F.col("id") % 2 + 1).cast("int").alias("day"))
    assert store.write_audited(df, f"{tmp_dir}/s", gather=True) == 400
    assert len(spark.read.parquet(f"{tmp_dir}/s").inputFiles()) == 2


def test_repeated_rows_are_made_in_one_pass(spark):
    """posts_dirty and posts_new hold their repeats without a second read of the texts."""
    for view, every in ((fixtures.posts_dirty, 50), (fixtures.posts_new, 40)):
        df = view(spark, SF_SMALL)
        assert "Union" not in plan(df)
        n = {r.post_id: r["count"] for r in df.groupBy("post_id").count().collect()}
        assert n and all(c == (2 if i % every == 0 else 1) for i, c in n.items())


def test_kept_answers_need_no_wave_after_wave(spark, tmp_dir):
    """The same vocabularies as from a model asked wave by wave, in jobs that do not grow with the waves."""
    from postlens.operators import topics
    from test_flows import batches, model

    vocab = spark.createDataFrame([("faq", "topic", "old"), ("issue", "subtopic", "x")], topics.VOCABULARY)
    jobs = []
    for n, wave, known in ((6, 1, None), (6, 4, vocab), (24, 1, vocab)):
        df = batches(spark, n)
        want = sorted(topics.answers_in_waves(df, model(), f"{tmp_dir}/m{n}-{wave}", wave, known).collect())
        kept = spark.createDataFrame([(r.batch_id, r.response) for r in want] + [(10**6, want[0].response.replace('"x"', '"y"'))], "batch_id long, response string")
        got = []
        jobs.append(stages(spark, f"kept{n}-{wave}", lambda: got.extend(topics.answers_in_waves(df, kept, f"{tmp_dir}/k{n}-{wave}", wave, known).collect())))
        assert sorted(got) == want
    assert jobs[2] <= jobs[0] + 8  # 6 waves and 24 of them
    none = topics.answers_in_waves(batches(spark, 2).limit(0), kept, f"{tmp_dir}/none")
    assert none.count() == 0 and none.columns == ["batch_id", "vocabulary", "response"]


def test_a_page_is_cut_once(spark):
    """Neither a filter nor the generator's own check computes the page's tags a second time; tags are the same as by the plain expression."""
    import random

    from postlens.operators import extract

    rnd = random.Random(3)
    bits = ["<article", "<ARTICLE", "</article", "</Article", ">", " ", "\n", "/", "<", "x", " class='a'", "<articles>", "</articlex>"]
    rows = [(i, "u", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(2000)] + [(2000, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cut = extract.articles(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))
    assert plan(cut).count("regexp_extract_all") == 1
    plain = r"(?i)<article(?=[\s>/])[^>]*>|</article\s*>"
    found = pages.select(F.regexp_extract_all("html", F.lit(plain), 0).alias("a"), F.regexp_extract_all("html", F.lit(extract.ARTICLE_TAG), 0).alias("b"))
    assert found.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    opened = sum(1 for r in found.collect() for t in r.a or [] if not t.startswith("</"))
    assert extract.articles(pages).count() == opened > 0


def test_topics_write_the_texts_once(spark, monkeypatch):
    kept = []

    def counted(df, name):
        if "tweetText" in df.columns:
            kept.append(name)
        return written(df, name)

    written = work.work_table
    monkeypatch.setattr(work, "work_table", counted)
    monkeypatch.setattr(topics, "work_table", counted)
    for key in ("classify_posts", "drill_down"):
        kept.clear()
        monkeypatch.setattr(storage, "content_dir", lambda spark, name, inputs: work_dir(spark, name))
        E.queries()[key](spark, SF_SMALL).collect()
        assert kept == ["to-label"]


def test_drill_down_cleans_once(spark, monkeypatch):
    """The topics store is made from the cleaned posts that the links come from."""
    calls = []

    def counted(posts, dedup=True):
        calls.append(dedup)
        return cleaned(posts, dedup)

    cleaned = clean.clean_posts
    monkeypatch.setattr(clean, "clean_posts", counted)
    monkeypatch.setattr(topics, "clean_posts", counted)
    monkeypatch.setattr(storage, "content_dir", lambda spark, name, inputs: work_dir(spark, name))
    assert E.queries()["drill_down"](spark, SF_SMALL).count()
    assert calls == [True]


def test_answers_gather_texts_by_batch_once(spark, monkeypatch):
    """Written answers: no text is moved to meet its labels, only to its batch."""
    plans = []

    def seen(df, name):
        if name == "recorded":
            plans.append(plan(df))
        return work.work_table(df, name)

    monkeypatch.setattr(labelling, "work_table", seen)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        E.queries()["running_vocab"](spark, SF_SMALL)
    assert "tweetText" in plans[0] and "hashpartitioning(rn" not in plans[0]


@pytest.mark.parametrize("key", ["extract_posts", "extract_quoted"])
def test_pages_are_put_together_where_their_texts_are(spark, key):
    """Nothing is shuffled once a page holds its posts' texts."""
    p = plan(E.queries()[key](spark, SF_SMALL))
    assert "Exchange" not in p[:p.index("Join")]


def test_pages_hold_the_posts_of_any_documents(spark, tmp_dir):
    """Document ids that are missing, repeated, null or beyond their number, repeated and odd events, a null text."""
    from postlens.schemas import TABLE_SCHEMAS

    docs = [(0, "zero & <one>"), (1, "first"), (2, "a"), (2, "b"), (7, "beyond"), (None, "none"), (5, None)]
    events = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 13, 21, 30, 37, 100]
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    d.selectExpr(*[f"cast({f.name if f.name in d.columns else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in TABLE_SCHEMAS["documents"].fields]).write.parquet(f"{tmp_dir}/documents.parquet")
    e = spark.createDataFrame([(i, "view", 7) for i in events], "event_id long, event_type string, user_id long").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    e.selectExpr(*[f"cast({f.name if f.name in e.columns else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in TABLE_SCHEMAS["events"].fields]).write.parquet(f"{tmp_dir}/events.parquet")
    posts = fixtures.posts(spark, tmp_dir).filter("tweetText is not null").collect()
    assert len({r.post_id for r in posts}) < len(posts)
    want = sorted((r.post_id // 2, r.tweetText.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for r in posts)
    for pages, head, tail in ((fixtures.post_pages, "<p>", "</p>"), (fixtures.quoting_pages, '"tweetText">', "</div>")):
        got = [(r.page_id, x.split(tail)[0]) for r in pages(spark, tmp_dir).collect() for x in r.html.split(head)[1:]]
        assert sorted(got) == want


def test_json_records_are_compressed_in_files_of_bounded_rows(spark, tmp_dir, monkeypatch):
    from postlens.sources import files

    monkeypatch.setattr(files, "_JSON_FILE_ROWS", 40)
    df = spark.range(0, 100, 1, 1).select(F.concat(F.lit("line\n\"{"), F.col("id")).alias("tweetText"), F.col("id").alias("post_id"))
    files.write_json_records(df, f"{tmp_dir}/j")
    back = spark.read.schema(df.schema).json(f"{tmp_dir}/j")
    assert len(back.inputFiles()) == 3 and all(f.endswith(".json.gz") for f in back.inputFiles())
    assert sorted(files.read_json_records(spark, f"{tmp_dir}/j", df.schema).collect()) == sorted(df.collect())


def test_a_micro_batch_is_written_not_cached(spark, tmp_dir, monkeypatch):
    """What the checks of a batch read is a work table, of which they take the columns they need."""
    from postlens.streaming import ingest as sing

    seen, real = [], sing.quality.quality_report

    def report(batch, *args):
        seen.append(batch._jdf.queryExecution().optimizedPlan().toString())
        return real(batch, *args)

    monkeypatch.setattr(sing.quality, "quality_report", report)
    cfg = sing.IngestConfig(posts_path=f"{tmp_dir}/posts", topics_path=f"{tmp_dir}/topics", state_path=f"{tmp_dir}/state", rules=fixtures.topic_rules(spark))
    assert sing.ingest_batch(spark, fixtures.posts(spark, SF_SMALL), 0, cfg)["posts_added"] > 0
    assert len(seen) == 1 and "InMemoryRelation" not in seen[0] and "Join" not in seen[0]


def test_a_repeated_append_moves_no_text(spark, tmp_dir, monkeypatch):
    from postlens.operators import ingest

    old, new = fixtures.stored(fixtures.posts_store(spark, SF_SMALL)), fixtures.stored(fixtures.posts_new(spark, SF_SMALL))
    assert ingest.append_new(spark, old, f"{tmp_dir}/s") == old.count()
    want = ingest.new_rows(new, old).count()
    plans, real = [], store.write_audited

    def written(df, *args, **kw):
        plans.append(plan(df))
        return real(df, *args, **kw)

    monkeypatch.setattr(store, "write_audited", written)
    assert ingest.append_new(spark, new, f"{tmp_dir}/s") == want
    assert len(plans) == 1 and "postlens_digests" not in plans[0]  # rows are picked by their ids, known before
    assert ingest.append_new(spark, new, f"{tmp_dir}/s") == 0
    assert len(plans) == 1
