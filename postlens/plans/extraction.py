"""Extraction queries over saved pages, per-tag dedup, merges and search targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import extract
from postlens.plans.oracle import with_views
from postlens.plans.registry import query
from postlens.sources import fixtures
from postlens.sources.tables import read_table
from postlens.sources.work import work_table

_UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _text_of(x: str) -> str:
    inner = _UNESCAPE.format(x=f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    return f"regexp_replace({inner}, '^\\s+|\\s+$', '', 'g')"


_ARTICLES_CTE = ("a", """
SELECT page_id, url, unnest(arts) AS article, generate_subscripts(arts, 1) - 1 AS article_no
FROM (SELECT page_id, url,
             regexp_extract_all(html, '(?s)<article[^>]*>(.*?)(?:</article>|\\z)', 1) AS arts FROM pages)""")

_FIELDS_CTE = ("f", f"""
SELECT page_id, url, article_no,
  {_text_of("regexp_extract(article, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
  regexp_matches(article, '<h1[\\s>]') AS has_title,
  {_text_of("regexp_replace(article, '(?s)<h1[^>]*>(.*?)</h1>', '', 'g')")} AS text,
  CAST(len(links) AS INT) AS n_links,
  CASE WHEN len(links) > 2 THEN
    CASE WHEN starts_with(links[3], '/')
         THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || links[3]
         ELSE links[3] END END AS link
FROM (SELECT *, regexp_extract_all(article, '<a\\s[^>]*?href="([^"]*)"', 1) AS links FROM a)""")

def _reason_cte(min_links: int) -> tuple[str, str]:
    return ("r", f"""
SELECT *, CASE WHEN NOT has_title THEN 'no title node'
               WHEN n_links < {min_links} THEN 'too few links'
               WHEN length(title) = 0 THEN 'empty title'
               WHEN length(text) = 0 THEN 'empty text' END AS reason
FROM f""")


@query("extract_articles", with_views(
    "SELECT page_id, article_no, title, text, link FROM r WHERE reason IS NULL",
    ctes=[_ARTICLES_CTE, _FIELDS_CTE, _reason_cte(0)]))
def extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = extract.extract_articles(read_table(spark, sf_dir, "pages"), min_links=0)
    return kept


@query("extract_filter", with_views(
    "SELECT page_id, article_no, reason FROM r WHERE reason IS NOT NULL",
    ctes=[_ARTICLES_CTE, _FIELDS_CTE, _reason_cte(3)]))
def extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = extract.extract_articles(read_table(spark, sf_dir, "pages"))
    return rejected


@query("extract_pick", with_views(
    "SELECT page_id, article_no, n_links, link FROM f", ctes=[_ARTICLES_CTE, _FIELDS_CTE]))
def extract_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = extract.article_fields(extract.articles(read_table(spark, sf_dir, "pages")))
    return f.select("page_id", "article_no", "n_links", "link")


@query("extract_nonempty", with_views(
    "SELECT page_id, article_no, title, text FROM f WHERE length(title) > 0 AND length(text) > 0",
    ctes=[_ARTICLES_CTE, _FIELDS_CTE]))
def extract_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped fields, articles with an empty title or text dropped."""
    f = extract.article_fields(extract.articles(read_table(spark, sf_dir, "pages")))
    return f.filter((F.length("title") > 0) & (F.length("text") > 0)).select("page_id", "article_no", "title", "text")


_REASON_SQL = "CASE post_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixtures.ARTICLE_DEFECTS.items()) + " END"
_WHOLE = "post_id % 11 < 5"
_READ = "(post_id % 11 < 5 OR post_id % 11 = 9)"


@query("extract_posts", with_views(f"""
SELECT post_id // 2 AS page_id, row_number() OVER (PARTITION BY post_id // 2 ORDER BY post_id) - 1 AS article_no,
       CASE WHEN {_READ} THEN username END AS username,
       CASE WHEN {_READ} THEN regexp_replace(tweetText, '^\\s+|\\s+$', '', 'g') END AS tweetText,
       CASE WHEN {_WHOLE} THEN CAST(strftime(postTimeRaw, '%Y-%m-%d %H:%M:%S.') || substr('120450', 1, CAST(post_id % 6 + 1 AS INT)) AS TIMESTAMP)
       END AS postTimeRaw,
       CASE WHEN {_READ} THEN tweet_link END AS tweet_link, {_REASON_SQL} AS reason
FROM posts""", "posts"))
def extract_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2/B3/B5/B6 with the capture's rules over post-shaped pages of every post, two articles a page,
    whole ones and every kind of reject; the oracle is the posts themselves."""
    arts = extract.articles(fixtures.post_pages(spark, sf_dir)).select("page_id", "article_no", "article")
    return extract.extract_posts(arts)


@query("extract_quoted", with_views("""
SELECT post_id // 2 AS page_id, 0 AS article_no, username,
       regexp_replace(tweetText, '^\\s+|\\s+$', '', 'g') AS tweetText, date_trunc('second', postTimeRaw)::TIMESTAMP AS postTimeRaw, tweet_link
FROM posts WHERE post_id % 2 = 0
UNION ALL
SELECT post_id // 2, 1, username, regexp_replace(tweetText, '^\\s+|\\s+$', '', 'g'), date_trunc('second', postTimeRaw)::TIMESTAMP, tweet_link
FROM posts WHERE post_id % 2 = 1""", "posts"))
def extract_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1/B2 on articles that hold another article: both come out as posts, whole."""
    arts = extract.articles(fixtures.quoting_pages(spark, sf_dir)).select("page_id", "article_no", "article")
    return extract.extract_posts(arts).filter(F.col("reason").isNull()).drop("reason")


@query("extract_page_rejects", with_views("SELECT page_id, article_no, 'no name node' AS reason FROM a", ctes=[_ARTICLES_CTE]))
def extract_page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved pages hold no post markup: each of their articles is quarantined with its reason."""
    arts = extract.articles(read_table(spark, sf_dir, "pages")).select("page_id", "article_no", "article")
    return extract.extract_posts(arts).filter(F.col("reason").isNotNull()).select("page_id", "article_no", "reason")


@query("dedup_first_seen", with_views("""
SELECT * FROM posts_dirty
QUALIFY row_number() OVER (PARTITION BY tag, username, tweetText ORDER BY post_id) = 1""", "posts_dirty"))
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.dedup_first_seen(fixtures.posts_dirty(spark, sf_dir), seen_col="post_id")


# Fixed parameter: the three categories the per-category results come from.
CATEGORIES = ["engagement", "incident", "conversion"]


@query("flatten_results", with_views("SELECT * FROM posts", "posts"))
def flatten_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 + I1: per-category results merged by name (union all)."""
    # Read once: the branches filter a work table, not three copies of the view.
    p = work_table(fixtures.posts(spark, sf_dir), "per-category")
    parts = [p.filter(F.col("category") == c) for c in CATEGORIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("tag_targets", """
SELECT DISTINCT r.r_name AS category, '#' || n.n_name AS tag,
       'https://x.com/search?q=' || url_encode('#' || n.n_name) || '&src=typed_query&f=live' AS url
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey""")
def tag_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The catalog in its map form: category -> list of tags.
    cat = fixtures.tag_catalog(spark, sf_dir).groupBy("category").agg(F.collect_list("tag").alias("tags"))
    return extract.tag_targets(cat)
