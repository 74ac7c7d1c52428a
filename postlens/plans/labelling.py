"""Topic labelling queries and the topic side of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import clean, ingest, terms, topics, trends
from postlens.plans import dashboard
from postlens.plans.oracle import topic_views, with_views
from postlens.plans.registry import query
from postlens.plans.storage import written_store
from postlens.schemas import TOPICS
from postlens.session import work_dir
from postlens.sources import fixtures, store
from postlens.sources.work import work_table

# Fixed parameter: the term clicked in the word cloud for the drill-down.
DRILL_TERM = "documents"
_SLICE = dashboard._SLICE_SQL


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_posts(fixtures.posts(spark, sf_dir))


def topics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics (FAQ) table of all posts, from the rule labeller."""
    return topics.topics_direct(fixtures.posts(spark, sf_dir), fixtures.topic_rules(spark))


@query("stop_words", with_views("SELECT word FROM stop", "stop"))
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.stop_words(_clean(spark, sf_dir))


@query("post_topics", with_views("SELECT * FROM post_topics", "post_topics"))
def post_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.label_posts(_clean(spark, sf_dir), fixtures.topic_rules(spark))


@query("batch_assign", with_views("SELECT post_id, \"index\", rn, batch_id FROM batches", "batches"))
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.batch_posts(_clean(spark, sf_dir)).select("post_id", "index", "rn", "batch_id")


@query("prompt_batches", with_views("""
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows,
       string_agg(CAST("index" AS VARCHAR) || ': ' || tweetText, chr(10) ORDER BY rn) AS prompt,
       list("index" ORDER BY rn) AS indexes, list(tweetText ORDER BY rn) AS texts
FROM batches GROUP BY batch_id""", "batches"))
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.prompt_batches(topics.batch_posts(_clean(spark, sf_dir)))


def _recorded(spark: SparkSession, batched: DataFrame, **faults) -> DataFrame:
    """Written answers (fixtures) to batches of cleaned posts."""
    lab = topics.label_posts(batched, fixtures.topic_rules(spark), keep=["batch_id", "rn", "index"])
    # Texts are gathered by batch once: what follows keeps them where they are, the labels come to them.
    labels = lab.groupBy("batch_id").agg(F.collect_list(F.struct("rn", "index", "kind", "topic", "subtopic")).alias("_labels"))
    texts = batched.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("rn", "tweetText"))).alias("_texts"))
    items = texts.join(labels, "batch_id").select("batch_id", "_texts", F.inline("_labels")).select(
        "batch_id", "rn", "index", F.col("_texts")[F.col("rn")].alias("text"), "kind", "topic", "subtopic")
    return work_table(fixtures.recorded_answers(batched, items, **faults), "recorded")


def _kept(spark: SparkSession, sf_dir: str, **faults) -> str:
    """An answers store that holds the answer to every prompt of the cleaned posts."""
    batched = _batched(spark, sf_dir)
    path = work_dir(spark, "kept-answers")
    topics.record_answers(topics.prompt_batches(batched), _recorded(spark, batched, **faults), path)
    return path


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(topics.batch_posts(_clean(spark, sf_dir)), "batched")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept answers to every batch of cleaned posts."""
    return _recorded(spark, _batched(spark, sf_dir), double_braces_every=7)


_ITEMS_SQL = """
SELECT b.batch_id, t.kind, b.rn, b."index", b.tweetText AS text, t.topic, t.subtopic
FROM batches b JOIN post_topics t ON t.post_id = b.post_id"""


@query("parse_responses", with_views("""
SELECT b.batch_id, true AS ok,
       CAST(count(i.kind) FILTER (WHERE i.kind = 'faq') AS BIGINT) AS n_faq,
       CAST(count(i.kind) FILTER (WHERE i.kind = 'issue') AS BIGINT) AS n_issue
FROM (SELECT DISTINCT batch_id FROM batches) b LEFT JOIN items i ON i.batch_id = b.batch_id
GROUP BY b.batch_id""", "batches", "post_topics", ctes=[("items", _ITEMS_SQL)]))
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = topics.parse_responses(_responses(spark, sf_dir))
    return p.select("batch_id", "ok", F.size(F.coalesce("parsed.faq", F.array())).cast("long").alias("n_faq"),
                    F.size(F.coalesce("parsed.issue", F.array())).cast("long").alias("n_issue"))


def _explode_sql(kind: str) -> str:
    return with_views(f"SELECT batch_id, \"index\", text, topic, subtopic FROM items WHERE kind = '{kind}'",
                      "batches", "post_topics", ctes=[("items", _ITEMS_SQL)])


@query("explode_faq", _explode_sql("faq"))
def explode_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.explode_kind(topics.parse_responses(_responses(spark, sf_dir)), "faq")


@query("explode_issue", _explode_sql("issue"))
def explode_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.explode_kind(topics.parse_responses(_responses(spark, sf_dir)), "issue")


@query("running_vocab", with_views("""
SELECT kind, level, term, min(batch_id) AS first_batch FROM (
  SELECT kind, 'topic' AS level, batch_id, unnest(topic) AS term FROM items
  UNION ALL
  SELECT kind, 'subtopic' AS level, batch_id, unnest(subtopic) AS term FROM items)
GROUP BY kind, level, term""", "batches", "post_topics", ctes=[("items", _ITEMS_SQL)]))
def running_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.running_vocab(topics.parse_responses(_responses(spark, sf_dir)))


@query("vocab_in_sequence", with_views(f"""
SELECT b.batch_id, coalesce(v.vocabulary, '') AS vocabulary
FROM (SELECT DISTINCT batch_id FROM batches) b LEFT JOIN (
  SELECT w, string_agg(line, chr(10) ORDER BY line) AS vocabulary FROM (
    SELECT w, kind || ' ' || level || ': ' || string_agg(term, ', ' ORDER BY term) AS line
    FROM (SELECT DISTINCT batch_id // {topics.WAVE_BATCHES} AS w FROM batches) s
    JOIN (SELECT kind, level, term, min(batch_id) AS first_batch FROM (
            SELECT kind, 'topic' AS level, batch_id, unnest(topic) AS term FROM items
            UNION ALL
            SELECT kind, 'subtopic' AS level, batch_id, unnest(subtopic) AS term FROM items) GROUP BY kind, level, term) t
      ON t.first_batch < w * {topics.WAVE_BATCHES}
    GROUP BY w, kind, level) GROUP BY w) v ON v.w = b.batch_id // {topics.WAVE_BATCHES}""", "batches", "post_topics", ctes=[("items", _ITEMS_SQL)]))
def vocab_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch was shown of the answers before its wave."""
    batched = _batched(spark, sf_dir)
    return topics.answers_in_waves(batched, _recorded(spark, batched), work_dir(spark, "waves")).select("batch_id", "vocabulary")


@query("enrich_topics", with_views("""
SELECT i."index", i.text, i.topic, i.subtopic, c.post_id, c.tag, c.username, c.postTimeRaw, c.year, c.month, c.day
FROM items i LEFT JOIN posts_clean c ON c."index" = i."index" WHERE i.kind = 'faq'""",
    "batches", "post_topics", ctes=[("items", _ITEMS_SQL)]))
def enrich_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _batched(spark, sf_dir)  # cleaned once: for the answers and for the fields
    faq = topics.explode_kind(topics.parse_responses(_recorded(spark, c, double_braces_every=7)), "faq").drop("batch_id")
    look = c.select("index", "post_id", "tag", "username", "postTimeRaw", "year", "month", "day")
    return faq.join(look, "index", "left")


@query("classify_posts", with_views("SELECT * FROM topics", "topics"))
def classify_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.classify(fixtures.posts(spark, sf_dir), fixtures.topic_rules(spark))


@query("classify_hook", with_views("SELECT * FROM topics", "topics"))
def classify_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the whole way through prompts and answers; all of them are kept, so the model is not asked."""
    return topics.classify(fixtures.posts(spark, sf_dir), model=topics.unasked, answers=_kept(spark, sf_dir))


@query("quarantine_answers", with_views(f"""
SELECT DISTINCT batch_id, '{fixtures.RESPONSE_HEAD}' AS response, 'no JSON object' AS reason
FROM batches WHERE batch_id % 11 = 0""", "batches"))
def quarantine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3's rejects: answers that break off before their JSON are kept aside, with a reason."""
    _, _, rejected = topics.model_faq(fixtures.posts(spark, sf_dir), topics.unasked, topics.JOB_BATCH_SIZE, dedup=True,
                                      answers=_kept(spark, sf_dir, broken_every=11))
    return rejected


@query("strip_stop_words", with_views("""
SELECT t.post_id, t.kind,
  list_filter(t.topic, lambda x: NOT list_contains(s.sw, x)) AS topic,
  list_filter(t.subtopic, lambda x: NOT list_contains(s.sw, x)) AS subtopic
FROM post_topics t JOIN (SELECT list(word) AS sw FROM stop) s ON true""", "post_topics", "stop"))
def strip_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clean(spark, sf_dir)
    lab = topics.label_posts(c, fixtures.topic_rules(spark))
    return topics.remove_stop_words(lab, topics.stop_words(c), ["topic", "subtopic"])


@query("strip_stop_text", with_views("""
SELECT c.post_id, array_to_string(list_filter(
  list_filter(regexp_split_to_array(regexp_replace(c.tweetText, '^\\s+|\\s+$', '', 'g'), '\\s+'),
              lambda x: length(x) > 0),
  lambda x: NOT list_contains(s.sw, x)), ' ') AS text
FROM posts_clean c JOIN (SELECT list(word) AS sw FROM stop) s ON true""", "posts_clean", "stop"))
def strip_stop_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = topics.stored_clean(fixtures.posts(spark, sf_dir))
    return topics.remove_stop_words_text(c.select("post_id", F.col("tweetText").alias("text")), topics.stop_words(c), "text")


# --- topics store and dashboard ------------------------------------------------------------------

def _topic_rows(spark: SparkSession, posts: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    return topics.topics_direct(posts, fixtures.topic_rules(spark), clean).select(*[f.name for f in TOPICS.fields])


def topics_store_path(spark: SparkSession, sf_dir: str, clean: DataFrame | None = None) -> str:
    """``clean``: the cleaned posts, if they are stored already; the topics are the same."""
    return written_store(spark, sf_dir, "topics-store", lambda sp, d: _topic_rows(sp, fixtures.posts(sp, d), clean))


@query("scan_topics", with_views("SELECT * FROM topics", "topics"))
def scan_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_topics(spark, topics_store_path(spark, sf_dir))


_TOPIC_KEYS_EQ = "s.postTimeRaw IS NOT DISTINCT FROM n.postTimeRaw AND s.tweetText IS NOT DISTINCT FROM n.tweetText"


@query("new_topics", with_views(f"""
SELECT * FROM n_topics n
WHERE NOT EXISTS (SELECT 1 FROM s_topics s WHERE {_TOPIC_KEYS_EQ})""", "posts_new", "posts_store", "topic_rules",
    ctes=topic_views("posts_new", "n") + topic_views("posts_store", "s")))
def new_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a new batch that the topics store does not hold; of the store, its digest index is read.

    Each batch is labelled on its own (cleaning deduplicates within it), as
    the incremental flow does."""
    path = written_store(spark, sf_dir, "topics-before", lambda sp, d: _topic_rows(sp, fixtures.posts_store(sp, d)))
    return ingest.new_rows_of(spark, _topic_rows(spark, fixtures.posts_new(spark, sf_dir)), path, ingest.TOPIC_KEYS, TOPICS)


def posts_store_path(spark: SparkSession, sf_dir: str) -> str:
    """The cleaned posts as the ingest stores them."""
    return written_store(spark, sf_dir, "clean-posts-store", _clean)


def sliced_topics(spark: SparkSession, sf_dir: str, clean: DataFrame | None = None) -> DataFrame:
    """D3: the dashboard's slice of the topics store; days are pruned by the partition columns."""
    t = store.read_topics(spark, topics_store_path(spark, sf_dir, clean))
    return trends.slice_topics(t, dashboard.DASH_TAGS, dashboard.DASH_START, dashboard.DASH_END, prune_days=True)


@query("slice_topics", with_views(f"SELECT * FROM topics WHERE {_SLICE}", "topics"))
def slice_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_topics(spark, sf_dir)


@query("top_subtopics", with_views(f"""
SELECT subtopic, count FROM (
  SELECT term AS subtopic, count(*) AS count FROM (
    SELECT unnest(subtopic) AS term FROM topics WHERE {_SLICE}) WHERE term IS NOT NULL GROUP BY term)
ORDER BY count DESC, subtopic LIMIT 10""", "topics"))
def top_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(sliced_topics(spark, sf_dir), "subtopic")


def _counts_sql(level: str, where: str) -> str:
    return with_views(f"""
SELECT term, count(*) AS count FROM (
  SELECT unnest({level}) AS term FROM topics WHERE {where})
WHERE term IS NOT NULL AND term NOT IN (
  SELECT DISTINCT w FROM (SELECT unnest(string_split(tag, '#')) AS w FROM topics WHERE {where})
  WHERE w IS NOT NULL AND length(trim(w)) > 0)
GROUP BY term""", "topics")


@query("term_counts", _counts_sql("subtopic", _SLICE))
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(sliced_topics(spark, sf_dir), "subtopic")


@query("topic_counts", _counts_sql("topic", "true"))
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(store.read_topics(spark, topics_store_path(spark, sf_dir)), "topic")


@query("subtopic_counts", _counts_sql("subtopic", "true"))
def subtopic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(store.read_topics(spark, topics_store_path(spark, sf_dir)), "subtopic")


@query("drill_down", with_views(f"""
SELECT h.tweetText, h.tag, h.postTimeRaw, p.tweet_link
FROM (SELECT tweetText, tag, postTimeRaw FROM topics WHERE {_SLICE} AND list_contains(subtopic, '{DRILL_TERM}')) h
LEFT JOIN (SELECT tweetText, tag, postTimeRaw, tweet_link FROM posts_clean WHERE {_SLICE}) p
  ON h.tweetText IS NOT DISTINCT FROM p.tweetText AND h.tag IS NOT DISTINCT FROM p.tag
 AND h.postTimeRaw IS NOT DISTINCT FROM p.postTimeRaw""", "topics", "posts_clean"))
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store.read_store(spark, posts_store_path(spark, sf_dir))
    posts = trends.slice_posts(stored, dashboard.DASH_TAGS, dashboard.DASH_START, dashboard.DASH_END, prune_days=True)
    return terms.drill_down(sliced_topics(spark, sf_dir, stored), posts, DRILL_TERM)  # cleaned once, for both stores


@query("endpoint_counts", with_views("""
SELECT term, count(*) AS count FROM (SELECT unnest(sub) AS term FROM lab)
WHERE term NOT IN (SELECT word FROM st)
GROUP BY term""", "posts", "topic_rules", ctes=[
    ("pc", """SELECT post_id, tag,
  regexp_replace(regexp_replace(tweetText, '#\\S+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM posts"""),
    ("tok", "SELECT DISTINCT post_id, unnest(regexp_extract_all(lower(t), '\\p{L}+')) AS term FROM pc"),
    ("lab", """SELECT k.post_id, list_distinct(list(r.subtopic)) AS sub
FROM tok k JOIN topic_rules r ON k.term = r.term WHERE r.kind = 'faq' GROUP BY k.post_id"""),
    ("st", """SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(tag, '#')) AS w FROM posts)
WHERE w IS NOT NULL AND length(trim(w)) > 0"""),
]))
def endpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 through the label endpoint: every post labelled (no dedup), batches of 50."""
    return topics.label_endpoint(fixtures.posts(spark, sf_dir), fixtures.topic_rules(spark), level="subtopic")
