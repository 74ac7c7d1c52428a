"""Stream = batch on the same data, split into several files (several micro-batches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import trends
from postlens.plans.cleaning import AS_OF
from postlens.sources import fixtures, store
from postlens.sources.tables import read_table
from postlens.streaming import ingest as sing
from postlens.streaming import live
from postlens.streaming.sources import post_stream

from conftest import SF_SMALL


def _split_events(spark, tmp_dir):
    """The events table written as three files, by thirds of the month."""
    ev = read_table(spark, SF_SMALL, "events")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for k in range(3):
        ev.filter(third == k).coalesce(1).write.mode("overwrite").parquet(f"{tmp_dir}/in/part{k}")
    return f"{tmp_dir}/in/*"


def test_stream_trend_equals_batch(spark, tmp_dir):
    src = _split_events(spark, tmp_dir)
    s = post_stream(spark, SF_SMALL, events_path=src, glob=None, max_files_per_trigger=1)
    q = live.start_increments(s, live.trend_increments, f"{tmp_dir}/out", f"{tmp_dir}/ck", {"availableNow": True})
    q.awaitTermination()
    got = live.totals(spark, f"{tmp_dir}/out", live.TREND, ["postTimeRaw", "tag"])
    want = trends.tag_trend(fixtures.posts(spark, SF_SMALL), "12H")
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.read.parquet(f"{tmp_dir}/out").select("_batch").distinct().count() == 3


def test_stream_ingest_is_idempotent_across_replays(spark, tmp_dir):
    src = _split_events(spark, tmp_dir)
    cfg = sing.IngestConfig(posts_path=f"{tmp_dir}/posts", topics_path=f"{tmp_dir}/topics",
                            state_path=f"{tmp_dir}/state", rules=fixtures.topic_rules(spark), as_of=AS_OF)
    for run in range(2):
        s = post_stream(spark, SF_SMALL, events_path=src, glob=None, max_files_per_trigger=1)
        sing.start_ingest(spark, s, cfg, f"{tmp_dir}/ck{run}", {"availableNow": True}).awaitTermination()
        n = store.read_store(spark, cfg.posts_path).count()
        if run == 0:
            first = n
    assert n == first
    reports = cfg.log
    assert len(reports) == 6
    assert sum(r.get("posts_added", 0) for r in reports[3:]) == 0
    # Within a batch, texts are unique; across batches a text may come back at a new time.
    per_batch = sum(r.get("posts_added", 0) for r in reports[:3])
    assert per_batch == first
    assert reports[5]["changed"] is False or reports[5].get("posts_added", 0) == 0


def test_scratch_folder_is_removed(spark):
    import os

    from postlens.session import scratch
    from postlens.sources.work import with_row_ids

    with scratch(spark, "test") as root:
        assert with_row_ids(spark.range(5).toDF("x"), "t").count() == 5
        here = root.removeprefix("file:")
        assert os.path.isdir(here) and os.listdir(here)
    assert not os.path.exists(here)


def test_stream_trend_3d_with_origin_equals_batch(spark, tmp_dir):
    import datetime as dt

    src = _split_events(spark, tmp_dir)
    first_day = read_table(spark, SF_SMALL, "events").agg(F.min(F.to_date("ts"))).first()[0]
    origin = dt.datetime.combine(first_day, dt.time(0))
    s = post_stream(spark, SF_SMALL, events_path=src, glob=None, max_files_per_trigger=1)
    q = live.start_increments(s, lambda df: live.trend_increments(df, "3D", origin), f"{tmp_dir}/out3d", f"{tmp_dir}/ck3d", {"availableNow": True})
    q.awaitTermination()
    got = live.totals(spark, f"{tmp_dir}/out3d", live.TREND, ["postTimeRaw", "tag"])
    want = trends.tag_trend(fixtures.posts(spark, SF_SMALL), "3D")
    assert sorted(got.collect()) == sorted(want.collect())


def test_ingest_batch_stop_mode_commits_nothing(spark, tmp_dir):
    import pytest

    dirty = fixtures.posts_dirty(spark, SF_SMALL)
    cfg = sing.IngestConfig(posts_path=f"{tmp_dir}/p", topics_path=f"{tmp_dir}/t", state_path=f"{tmp_dir}/s",
                            rules=fixtures.topic_rules(spark), as_of=AS_OF, on_fail="stop")
    with pytest.raises(sing.BatchRejected):
        sing.ingest_batch(spark, dirty, 0, cfg)
    # nothing stored and no fingerprint: a retry is not skipped as "unchanged"
    assert not store.store_exists(spark, cfg.posts_path) and not store.store_exists(spark, cfg.state_path)
    cfg.on_fail = "report"
    rep = sing.ingest_batch(spark, dirty, 1, cfg)
    assert rep["changed"] is True and rep["valid"] is False and rep["posts_added"] > 0
    again = sing.ingest_batch(spark, dirty, 2, cfg)
    assert again["changed"] is False


def test_late_files_count_and_replays_do_not(spark, tmp_dir):
    """Newest first, then old files, then a replay of a batch: counts are those of all posts."""
    p = fixtures.posts(spark, SF_SMALL)
    for epoch, cond in ((0, "day > 20"), (1, "day <= 10"), (2, "day between 11 and 20"), (1, "day <= 10")):
        live.trend_increments(p.filter(cond)).write.mode("overwrite").parquet(f"{tmp_dir}/t/_batch={epoch}")
    got = live.totals(spark, f"{tmp_dir}/t", live.TREND, ["postTimeRaw", "tag"])
    assert sorted(got.collect()) == sorted(trends.tag_trend(p, "12H").collect())


def test_dedup_over_batches_is_exact_and_replayable(spark, tmp_dir):
    keys = ["post_id", "postTimeRaw", "username", "tweetText"]
    p = fixtures.posts_dirty(spark, SF_SMALL)  # old times, null users, repeats
    parts = [p.filter("post_id % 3 = 2"), p.filter("post_id % 3 = 0 or post_id % 50 = 0"), p.filter("post_id % 3 = 1")]
    for epoch in (0, 1, 2, 1):
        sing.dedup_batch(spark, parts[epoch], epoch, f"{tmp_dir}/d", keys)
    got = spark.read.parquet(f"{tmp_dir}/d")
    want = p.dropDuplicates(keys)
    assert got.count() == want.count() == got.select(*keys).distinct().count()
