"""Plan tests: pruning, pushdown, partition filters, top-k, no Python where not needed."""

from __future__ import annotations

import datetime as dt

import __spark_entry__ as E
from postlens.operators import terms, topics
from postlens.plans import labelling
from postlens.sources import fixtures, store

from conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruned_scan_reads_two_columns(spark):
    df = E.queries()["scan_pruned"](spark, SF_SMALL)
    p = plan(df)
    assert "ReadSchema: struct<tag:string,postTimeRaw:timestamp_ntz>" in p


def test_day_slice_prunes_partitions(spark):
    path = E.queries()["scan_posts"](spark, SF_SMALL).inputFiles()[0].split("/year=")[0]
    df = store.read_store_days(spark, path, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4), keep_null_days=False)
    p = plan(df)
    assert "PartitionFilters: [" in p and "PartitionFilters: []" not in p
    assert {r.day for r in df.select("day").distinct().collect()} == {3, 4}


def test_dashboard_slice_pushes_time_bounds_to_scan(spark):
    p = plan(E.queries()["slice_posts"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00), LessThanOrEqual(ts,2024-01-30T23:59)]" in p


def test_store_slice_pushes_tag_and_time_and_prunes_days(spark):
    from postlens.operators import trends
    from postlens.plans import dashboard

    path = E.queries()["scan_posts"](spark, SF_SMALL).inputFiles()[0].split("/year=")[0]
    sliced = trends.slice_posts(store.read_store(spark, path), ["#click"], dt.datetime(2024, 1, 3),
                                dt.datetime(2024, 1, 4, 23, 59), prune_days=True)
    p = plan(sliced)
    assert "In(tag, [#click])" in p or "EqualTo(tag,#click)" in p
    assert "GreaterThanOrEqual(postTimeRaw" in p
    assert "PartitionFilters: []" not in p
    assert dashboard.DASH_TAGS  # the registered slice uses the same function


def test_top_subtopics_is_take_ordered(spark):
    df = terms.top_terms(labelling.sliced_topics(spark, SF_SMALL), "subtopic")
    assert "TakeOrderedAndProject" in plan(df)


def test_rule_labeller_shuffles_hits_only(spark):
    """The rules' side is broadcast by its own size; one exchange groups the hits; no text moves, no Python."""
    posts = fixtures.posts(spark, SF_SMALL).select("post_id", "tweetText")
    lab = topics.label_posts(posts, fixtures.topic_rules(spark))
    p = plan(lab)
    assert not any(n in p for n in PY_NODES)
    assert p.count("Exchange hashpartitioning") == plan(posts).count("Exchange hashpartitioning") + 1
    last = [x for x in p.splitlines() if "Exchange hashpartitioning" in x][0]
    assert "tweetText" not in last


def test_dashboard_reads_the_topics_store_and_prunes_days(spark):
    for key in ("slice_topics", "top_subtopics", "term_counts", "drill_down"):
        p = plan(E.queries()[key](spark, SF_SMALL))
        filters = [x for x in p.split("PartitionFilters: ")[1:]]
        assert filters and not any(x.startswith("[]") for x in filters), key


def test_no_python_in_queries_except_model_hook(spark):
    allowed = {"classify_hook"}
    for key in ("tag_trend_12h", "trend_series", "clean_posts", "post_topics", "term_counts", "drill_down",
                "new_posts", "quality_report", "extract_articles", "tag_targets", "batch_fingerprint"):
        assert key not in allowed
        p = plan(E.queries()[key](spark, SF_SMALL))
        assert not any(n in p for n in PY_NODES), key


def test_clean_posts_aggregates_map_side(spark):
    """Rows are picked by a semi-join; their keys are aggregated by hashing, inside each task first, and hold no text."""
    from pyspark.sql import functions as F

    from postlens.functions.text import clean_text
    from postlens.operators import firsts

    p = plan(E.queries()["clean_posts"](spark, SF_SMALL))
    assert "LeftSemi" in p
    assert "Window" not in p and "Aggregate" not in p[:p.index("LeftSemi")] and "SortAggregate" not in p
    posts = fixtures.posts(spark, SF_SMALL)
    marked = posts.withColumns({"_order": firsts.packed_order(F.col("postTimeRaw"), F.col("post_id")), "_tie": F.xxhash64(*posts.columns)})
    p = plan(firsts.narrow_keys(marked, firsts.text_digest(clean_text("tweetText"))))
    assert "partial_count" in p and "SortAggregate" not in p
    moved = [x for x in p.splitlines() if "Exchange hashpartitioning(_key" in x]
    assert len(moved) == 1 and "tweetText" not in moved[0]


def test_new_posts_join_no_texts_on_the_store_side(spark):
    p = plan(E.queries()["new_posts"](spark, SF_SMALL))
    join = [x for x in p.splitlines() if "LeftAnti" in x]
    assert len(join) == 1 and "_digest" in join[0] and "tweetText" not in join[0]


def test_partitioned_write_one_file_for_a_small_day(spark, tmp_dir):
    import glob

    df = fixtures.stored(fixtures.posts(spark, SF_SMALL))
    store.write_partitioned(df, f"{tmp_dir}/store", "append")
    days = glob.glob(f"{tmp_dir}/store/year=*/month=*/day=*")
    assert len(days) == df.select("year", "month", "day").distinct().count()
    assert all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in days)
    assert store.read_store(spark, f"{tmp_dir}/store").count() == df.count()
