"""First rows without sorting, the digest index of a store, and repeat removal over many micro-batches."""

from __future__ import annotations

import datetime as dt
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from postlens.functions import text as tx
from postlens.operators import clean, firsts, ingest
from postlens.schemas import STORED_POSTS
from postlens.sources import fixtures, store
from postlens.streaming import ingest as sing

from conftest import SF_SMALL

T0 = dt.datetime(2024, 3, 31, 2, 30)  # inside a spring-forward gap of several zones


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["clean_posts", "dedup_first_seen"])
def test_no_rows_are_sorted_to_be_aggregated(spark, key):
    assert "SortAggregate" not in plan(E.queries()[key](spark, SF_SMALL))


@pytest.mark.parametrize("few", [0, 1000])
def test_first_rows_equal_a_loop(spark, monkeypatch, few):
    """Null texts and times, ties, identical rows; winners broadcast or shuffled."""
    monkeypatch.setattr(firsts, "BROADCAST_ROWS", few)
    rnd = random.Random(few)
    rows = [(rnd.choice([None, "", "a", "b", "c d"]), rnd.choice([None, *[T0 + dt.timedelta(minutes=m, microseconds=m) for m in range(-60, 90, 7)]]),
             rnd.choice([None, -5, 3, 2**62]), rnd.choice("xyz")) for _ in range(150)]
    df = spark.createDataFrame(rows + rows[:40], "k string, t timestamp_ntz, n long, v string")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = firsts.first_rows(df, ["k"], firsts.packed_order(F.col("t"), F.col("n"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def order(r):
        return (r[1] is None, r[1] or T0, r[2] is None, r[2] or 0)

    assert sorted(str(r.k) for r in got) == sorted({str(r[0]) for r in rows})
    for r in got:
        assert tuple(r) in rows and order(r) == min(order(x) for x in rows if x[0] == r.k)


def test_hashtags_go_as_by_the_expression(spark):
    rnd = random.Random(1)
    parts = ["#", "#", "a", "b", " ", "\n", "é", "　", "😀", "\x85", "a" * 300, "x#y", "​"]
    rows = [("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select(tx.remove_hashtags("t").alias("a"), F.regexp_replace("t", tx.HASHTAG, "").alias("b"))
    assert df.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


# ---------------------------------------------------------------- the digest index

def test_new_posts_reads_digests_only_and_does_not_move_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(E.queries()["new_posts"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [line for line in p.splitlines() if "postlens_digests" in line]
    assert len(scan) == 1 and "ReadSchema: struct<digest:binary,day:int>" in scan[0] and "Bucketed: true" in scan[0]
    assert "GreaterThanOrEqual(day" in scan[0]  # other days' files are skipped by their statistics
    store_side = p[p.rindex("Sort [digest"):]
    assert "Exchange" not in store_side
    assert "tweetText" not in scan[0]


def test_index_catches_up_after_a_failed_append(spark, tmp_dir):
    """Files that were stored but not indexed are indexed before the next look; nothing is added twice."""
    old, new = fixtures.stored(fixtures.posts_store(spark, SF_SMALL)), fixtures.stored(fixtures.posts_new(spark, SF_SMALL))
    path = f"{tmp_dir}/s"
    assert ingest.append_new(spark, old, path) == old.count()
    want = ingest.new_rows(new, old).count()
    fresh = ingest.new_rows_of(spark, new, path).select(*[f.name for f in STORED_POSTS.fields])
    store.write_partitioned(fresh, path, "append")  # as an append that broke off before its index
    assert ingest.append_new(spark, new, path) == 0
    assert store.read_store(spark, path).count() == old.count() + want
    index = ingest.digest_index(spark, path)
    assert index.catch_up() == 0
    assert index.table().count() == old.count() + want


def test_index_of_a_store_written_without_one(spark, tmp_dir):
    old, new = fixtures.stored(fixtures.posts_store(spark, SF_SMALL)), fixtures.stored(fixtures.posts_new(spark, SF_SMALL))
    store.write_partitioned(old, f"{tmp_dir}/s", "append")
    got = ingest.new_rows_of(spark, new, f"{tmp_dir}/s").select("post_id")
    assert sorted(got.collect()) == sorted(ingest.new_rows(new, old).select("post_id").collect())


def test_null_days_and_null_keys_in_the_index(spark, tmp_dir):
    p = fixtures.stored(fixtures.posts(spark, SF_SMALL)).limit(20)
    blank = p.withColumns({c: F.lit(None).cast(p.schema[c].dataType) for c in ("postTimeRaw", "username", "year", "month", "day")})
    assert ingest.append_new(spark, blank, f"{tmp_dir}/s") == 20
    assert ingest.append_new(spark, blank, f"{tmp_dir}/s") == 0
    assert ingest.append_new(spark, p, f"{tmp_dir}/s") == 20


def test_changed_input_gets_a_store_of_its_own(spark, tmp_dir):
    """Stores of derived rows are found by the state of their input, not by a name kept in memory."""
    from postlens.session import content_dir

    spark.range(3).write.parquet(f"{tmp_dir}/in")
    one = content_dir(spark, "x", [f"{tmp_dir}/in"])
    assert one == content_dir(spark, "x", [f"{tmp_dir}/in"])
    spark.range(1).write.mode("append").parquet(f"{tmp_dir}/in")
    assert one != content_dir(spark, "x", [f"{tmp_dir}/in"])


# ---------------------------------------------------------------- repeats over many micro-batches

def test_a_micro_batch_does_not_read_what_came_before(spark, tmp_dir):
    """Fifty micro-batches, each with repeats of all earlier ones: no scan of the output, exact, and replays add nothing."""
    schema = "post_id long, username string, tweetText string"
    for i in range(50):
        rows = [(i, "new", "t" * 50)] + [(j, "new", "t" * 50) for j in range(max(0, i - 3), i)] + [(0, None, "")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        def run():
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
            q = sing.start_dedup(spark, stream, f"{tmp_dir}/out", ["post_id", "username", "tweetText"], f"{tmp_dir}/ck", {"availableNow": True})
            q.awaitTermination()
            return q

        q = run()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider  # the session's own setting is back
        batches = [p for p in q.recentProgress if p["numInputRows"]]
        assert len(batches) == 50
        assert all(p["numInputRows"] <= 5 for p in batches)  # the batch's own rows, nothing else is read
        scans = [line for line in q._jsq.explainInternal(False).splitlines() if "FileScan" in line or "Location" in line]
        assert not any(f"{tmp_dir}/out" in line for line in scans)
        got = spark.read.parquet(f"{tmp_dir}/out")
        assert got.count() == got.distinct().count() == 51
        # the last batch's commit is lost: it runs again
        import os

        last = max(int(f) for f in os.listdir(f"{tmp_dir}/ck/commits") if re.fullmatch(r"\d+", f))
        for f in (str(last), f".{last}.crc"):
            if os.path.exists(f"{tmp_dir}/ck/commits/{f}"):
                shutil.move(f"{tmp_dir}/ck/commits/{f}", f"{tmp_dir}/{f.strip('.')}-lost")
        run()
        assert spark.read.parquet(f"{tmp_dir}/out").count() == 51
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_clean_posts_without_dedup_keeps_every_row(spark):
    p = fixtures.posts_dirty(spark, SF_SMALL)
    assert clean.clean_posts(p, dedup=False).count() == p.count()
