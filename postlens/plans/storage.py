"""Store, file and ingest queries: each writes under the shared work folder and reads back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators import clean, ingest, quality
from postlens.plans.oracle import with_views
from postlens.plans.registry import query
from postlens.schemas import EXPORT, POSTS, RAW
from postlens.session import content_dir, path_exists, work_dir
from postlens.sources import files, fixtures, store

_POST_COLS = [f.name for f in POSTS.fields]


def written_store(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame],
                  write: Callable[[DataFrame, str], None] = lambda df, path: store.write_partitioned(df, path, "overwrite")) -> str:
    """A store of ``build``'s rows, written once for the data as it is now; later queries scan it."""
    path = content_dir(spark, name, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "documents")])
    if not path_exists(spark, f"{path}/_SUCCESS"):  # written to its end
        write(build(spark, sf_dir), path)
    return path


_INDEXED = 'SELECT *, post_id + 1 AS "index" FROM '


def _stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.stored(fixtures.posts(spark, sf_dir))


@query("load_partitioned", with_views(_INDEXED + "posts", "posts"))
def load_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "posts-store")
    store.write_partitioned(_stored_posts(spark, sf_dir), path, "append")
    return store.read_store(spark, path)


@query("load_audit", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS written, CAST(count(*) AS BIGINT) AS read_back, true AS matched "
    "FROM posts", "posts"))
def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "posts-audit")
    n = store.write_audited(_stored_posts(spark, sf_dir), path, "append")
    back = store.read_store(spark, path).agg(F.count(F.lit(1)).cast("long").alias("read_back"))
    return back.select(F.lit(n).cast("long").alias("written"), "read_back",
                       (F.col("read_back") == F.lit(n)).alias("matched"))


@query("scan_posts", with_views(_INDEXED + "posts", "posts"))
def scan_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_store(spark, written_store(spark, sf_dir, "posts", _stored_posts))


@query("scan_pruned", with_views("SELECT tag, postTimeRaw FROM posts", "posts"))
def scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_store(spark, sf_dir, "posts", _stored_posts)
    return store.read_store(spark, path, columns=["tag", "postTimeRaw"])


@query("csv_roundtrip", with_views(r"""
SELECT * REPLACE (CASE post_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  " outer "" blanks"  '
                  WHEN 3 THEN '\N' WHEN 4 THEN '\\N \' ELSE tweetText END AS tweetText) FROM posts_dirty""", "posts_dirty"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts with empty, null, quoted, blank-edged and backslash texts among them, out and back."""
    k = F.col("post_id") % 7
    text = (F.when(k == 0, "").when(k == 1, F.lit(None).cast("string")).when(k == 2, '  " outer "" blanks"  ')
            .when(k == 3, "\\N").when(k == 4, "\\\\N \\").otherwise(F.col("tweetText")))
    path = work_dir(spark, "posts-csv")
    files.write_csv(fixtures.posts_dirty(spark, sf_dir).withColumn("tweetText", text), path)
    return files.read_csv(spark, path, POSTS)


_RAW_WITH_ID = T.StructType(RAW.fields + [T.StructField("post_id", T.LongType())])


@query("json_roundtrip", with_views("""
SELECT category, tag, username, tweetText, postTimeRaw,
       date_trunc('second', scrapeTime) AS scrapeTime, tweet_link, post_id,
       CAST(year(postTimeRaw) AS INT) AS year, CAST(month(postTimeRaw) AS INT) AS month,
       CAST(day(postTimeRaw) AS INT) AS day
FROM posts""", "posts"))
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "raw-json")
    files.write_json_records(fixtures.posts_raw(spark, sf_dir), path)
    return clean.type_posts(files.read_json_records(spark, path, _RAW_WITH_ID))


@query("json_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.sources.tables import read_table

    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    return files.parse_json_column(ev, "props", "k bigint").select("event_id", F.col("j.k").alias("k"))


def _export(spark: SparkSession, sf_dir: str) -> str:
    """The flat snapshot of the posts, written once for the data as it is now."""
    return written_store(spark, sf_dir, "export", lambda sp, d: clean.export_form(_stored_posts(sp, d)).select(*[f.name for f in EXPORT.fields]), files.write_flat)


@query("export_snapshot", with_views("""
SELECT post_id, category, tag, username, tweetText, postTimeRaw AS "timestamp",
       scrapeTime, tweet_link, post_id + 1 AS "index", year, month, day FROM posts""", "posts"))
def export_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle gives the UTC wall time, the column holds the same instant."""
    return spark.read.parquet(_export(spark, sf_dir))


@query("schema_check", "SELECT * FROM (VALUES " + ", ".join(
    f"('{f.name}', '{f.dataType.simpleString()}', '{f.dataType.simpleString()}', true)" for f in EXPORT.fields)
    + ') t("column", declared, found, same)')
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the types of the exported files against the declared export, one row per column."""
    rows = quality.schema_check(EXPORT, spark.read.parquet(_export(spark, sf_dir)).schema)
    return spark.createDataFrame(rows, "column string, declared string, found string, same boolean")


_KEYS_EQ = ("s.postTimeRaw IS NOT DISTINCT FROM n.postTimeRaw AND s.username IS NOT DISTINCT FROM n.username "
            "AND s.tweetText IS NOT DISTINCT FROM n.tweetText")


@query("new_posts", with_views(f"""
SELECT * FROM posts_new n WHERE NOT EXISTS (SELECT 1 FROM posts_store s WHERE {_KEYS_EQ})""",
    "posts_new", "posts_store"))
def new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against the posts store; of the store, its digest index is read."""
    path = written_store(spark, sf_dir, "posts-before", lambda sp, d: fixtures.stored(fixtures.posts_store(sp, d)))
    return ingest.new_rows_of(spark, fixtures.posts_new(spark, sf_dir), path)


@query("incremental_load", with_views(f"""
SELECT *, post_id + 1 AS "index" FROM posts_store
UNION ALL
SELECT *, post_id + 1 AS "index" FROM posts_new n WHERE NOT EXISTS (SELECT 1 FROM posts_store s WHERE {_KEYS_EQ})""",
    "posts_new", "posts_store"))
def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "posts-incremental")
    store.write_partitioned(fixtures.stored(fixtures.posts_store(spark, sf_dir)), path, "append")
    ingest.append_new(spark, fixtures.stored(fixtures.posts_new(spark, sf_dir)), path)
    # A second run of the same batch must add nothing.
    ingest.append_new(spark, fixtures.stored(fixtures.posts_new(spark, sf_dir)), path)
    return store.read_store(spark, path)


_DIGEST_SQL = " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in (
    "strftime(postTimeRaw, '%Y-%m-%d %H:%M:%S.%f')", "username", "tweetText"))


def _fp_sql(view: str, batch_id: int) -> str:
    return f"""SELECT 'posts' AS source, CAST({batch_id} AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n,
  CAST(coalesce(bit_xor(v), 0) AS BIGINT) AS x, CAST(coalesce(sum(v), 0) AS VARCHAR) AS s
FROM (SELECT CAST('0x' || substr(md5({_DIGEST_SQL}), 1, 15) AS BIGINT) AS v FROM {view})"""


@query("batch_fingerprint", with_views(_fp_sql("posts_new", 2), "posts_new"))
def batch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = ingest.fingerprint(fixtures.posts_new(spark, sf_dir))
    return fp.select(F.lit("posts").alias("source"), F.lit(2).cast("long").alias("batch_id"), "n", "x", "s")


@query("change_gate", with_views(f"""
SELECT *, NOT coalesce((n, x, s) IS NOT DISTINCT FROM lag((n, x, s)) OVER (PARTITION BY source ORDER BY batch_id),
                       false) AS changed
FROM ({_fp_sql('posts_store', 1)}
      UNION ALL {_fp_sql('posts_new', 2)}
      UNION ALL {_fp_sql('posts_new', 3)})""", "posts_new", "posts_store"))
def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches: the store load, a new batch, then the same batch sent again."""
    batches = None
    for bid, b in ((1, fixtures.posts_store), (2, fixtures.posts_new), (3, fixtures.posts_new)):
        b = b(spark, sf_dir).select(F.lit("posts").alias("source"), F.lit(bid).cast("long").alias("batch_id"), *ingest.POST_KEYS)
        batches = b if batches is None else batches.unionByName(b)
    # One pass over all batches: the fingerprint groups by batch.
    return ingest.change_flags(ingest.fingerprint(batches, ["source", "batch_id"]))


@query("gate_states", with_views(f"""
SELECT batch_id, n, x, s, changed FROM (
  SELECT *, NOT coalesce((n, x, s) IS NOT DISTINCT FROM lag((n, x, s)) OVER (PARTITION BY source ORDER BY batch_id),
                         false) AS changed
  FROM ({_fp_sql('posts_store', 1)}
        UNION ALL {_fp_sql('posts_new', 2)}
        UNION ALL {_fp_sql('posts_new', 3)}))""", "posts_new", "posts_store"))
def gate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: three batches through the state table: looked up, compared, committed if changed."""
    state, out = work_dir(spark, "gate-state"), []
    for bid, b in ((1, fixtures.posts_store), (2, fixtures.posts_new), (3, fixtures.posts_new)):
        changed, fp = ingest.batch_changed(spark, b(spark, sf_dir), state, "posts")
        if changed:
            ingest.commit_fingerprint(spark, state, "posts", bid, fp)
        out.append((bid, fp["n"], fp["x"], fp["s"], changed))
    return spark.createDataFrame(out, "batch_id long, n long, x long, s string, changed boolean")
