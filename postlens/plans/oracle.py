"""DuckDB SQL for the fixture views, used to build the oracle of each query.

Each oracle is one self-contained statement over the raw test tables: the
views it needs are prepended as CTEs, in dependency order.
"""

from __future__ import annotations

# name -> (SQL body, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "posts": ("""
SELECT e.event_id AS post_id,
  CASE WHEN e.event_type IN ('view','click') THEN 'engagement'
       WHEN e.event_type = 'error' THEN 'incident' ELSE 'conversion' END AS category,
  concat('#', e.event_type) AS tag,
  concat('user', e.user_id) AS username,
  concat(d.text, ' #', e.event_type) AS tweetText,
  e.ts AS postTimeRaw,
  e.ts + INTERVAL 15 MINUTE AS scrapeTime,
  concat('https://x.com/user', e.user_id, '/status/', e.event_id) AS tweet_link,
  CAST(year(e.ts) AS INT) AS year,
  CAST(month(e.ts) AS INT) AS month,
  CAST(day(e.ts) AS INT) AS day
FROM events e
JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""", ()),
    "posts_dirty": ("""
SELECT * FROM (
  SELECT post_id, category, tag,
    CASE WHEN post_id % 97 = 0 THEN NULL ELSE username END AS username,
    tweetText,
    CASE WHEN post_id % 101 = 0 THEN postTimeRaw - INTERVAL 6 YEAR ELSE postTimeRaw END AS postTimeRaw,
    scrapeTime, tweet_link, year,
    CASE WHEN post_id % 103 = 0 THEN 13 ELSE month END AS month,
    CASE WHEN post_id % 107 = 0 THEN 0 ELSE day END AS day
  FROM posts) x
UNION ALL
SELECT * FROM (
  SELECT post_id, category, tag,
    CASE WHEN post_id % 97 = 0 THEN NULL ELSE username END AS username,
    tweetText,
    CASE WHEN post_id % 101 = 0 THEN postTimeRaw - INTERVAL 6 YEAR ELSE postTimeRaw END AS postTimeRaw,
    scrapeTime, tweet_link, year,
    CASE WHEN post_id % 103 = 0 THEN 13 ELSE month END AS month,
    CASE WHEN post_id % 107 = 0 THEN 0 ELSE day END AS day
  FROM posts) y
WHERE post_id % 50 = 0""", ("posts",)),
    "posts_store": ("""
SELECT post_id, category, tag,
  CASE WHEN post_id % 97 = 0 THEN NULL ELSE username END AS username,
  tweetText, postTimeRaw, scrapeTime, tweet_link, year, month, day
FROM posts WHERE day <= 20""", ("posts",)),
    "posts_new_x": ("""
SELECT post_id, category, tag,
  CASE WHEN post_id % 97 = 0 THEN NULL ELSE username END AS username,
  tweetText, postTimeRaw, scrapeTime, tweet_link, year, month, day
FROM posts WHERE day BETWEEN 19 AND 22""", ("posts",)),
    "posts_new": ("""
SELECT * FROM posts_new_x
UNION ALL
SELECT * FROM posts_new_x WHERE post_id % 40 = 0""", ("posts_new_x",)),
    "topic_rules": ("""
SELECT * FROM (VALUES
  ('that',   'faq',   'admissions',   'documents'),
  ('attion', 'faq',   'admissions',   'deadline'),
  ('que',    'faq',   'housing',      'rules'),
  ('der',    'faq',   'housing',      'hours'),
  ('was',    'faq',   'general',      'click'),
  ('eriner', 'issue', 'registration', 'outage'),
  ('anea',   'issue', 'registration', 'stability')
) AS t(term, kind, topic, subtopic)""", ()),
    # Cleaned, deduplicated posts: earliest post per cleaned text.
    "posts_clean": ("""
SELECT post_id, category, tag, username, tweetText, postTimeRaw, scrapeTime, tweet_link,
       year, month, day, post_id + 1 AS "index"
FROM (
  SELECT p.* REPLACE (regexp_replace(regexp_replace(p.tweetText, '#\\S+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS tweetText)
  FROM posts p) c
QUALIFY row_number() OVER (PARTITION BY tweetText ORDER BY postTimeRaw, post_id) = 1""", ("posts",)),
    "post_tokens": ("""
SELECT DISTINCT c.post_id, t.term
FROM posts_clean c, unnest(regexp_extract_all(lower(c.tweetText), '\\p{L}+')) AS t(term)""", ("posts_clean",)),
    "post_topics": ("""
SELECT k.post_id, r.kind,
       list_sort(list_distinct(list(r.topic))) AS topic,
       list_sort(list_distinct(list(r.subtopic))) AS subtopic
FROM post_tokens k JOIN topic_rules r ON k.term = r.term
GROUP BY k.post_id, r.kind""", ("post_tokens", "topic_rules")),
    "stop": ("""
SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(tag, '#')) AS w FROM posts_clean)
WHERE w IS NOT NULL AND length(trim(w)) > 0""", ("posts_clean",)),
    "batches": ("""
SELECT *, (rn - 1) // 20 AS batch_id FROM (
  SELECT *, row_number() OVER (ORDER BY postTimeRaw NULLS LAST, post_id) AS rn FROM posts_clean)""",
                ("posts_clean",)),
    "topics": ("""
SELECT c.post_id, c.tweetText,
  list_filter(t.topic, lambda x: NOT list_contains(s.sw, x)) AS topic,
  list_filter(t.subtopic, lambda x: NOT list_contains(s.sw, x)) AS subtopic,
  c.tag, c.username, c.postTimeRaw, c.year, c.month, c.day
FROM post_topics t
JOIN posts_clean c ON c.post_id = t.post_id
JOIN (SELECT list(word) AS sw FROM stop) s ON true
WHERE t.kind = 'faq'""", ("post_topics", "posts_clean", "stop")),
}


def topic_views(src: str, prefix: str) -> list[tuple[str, str]]:
    """Clean, label and stop-word views over another posts view ``src``
    (CTEs named ``<prefix>_clean``, ``<prefix>_post_topics``, ``<prefix>_stop``, ``<prefix>_topics``)."""
    out = []
    for name in ("posts_clean", "post_tokens", "post_topics", "stop", "topics"):
        body = VIEWS[name][0]
        for dep in ("posts_clean", "post_tokens", "post_topics", "stop"):
            body = body.replace(f"FROM {dep}", f"FROM {prefix}_{dep}").replace(f"JOIN {dep}", f"JOIN {prefix}_{dep}")
        if name == "posts_clean":
            body = body.replace("FROM posts p", f"FROM {src} p")
        out.append((f"{prefix}_{name}", body))
    return out


def with_views(body: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prepend the CTEs needed by ``names`` (transitively), then ``ctes``, to ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [(n, VIEWS[n][0]) for n in order] + list(ctes or [])
    if not parts:
        return body.strip()
    text = ",\n".join(f"{n} AS ({q.strip()}\n)" for n, q in parts)
    return f"WITH {text}\n{body.strip()}"
