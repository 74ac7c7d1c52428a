"""Extraction from saved pages (B1-B9): the browser capture re-aimed as a Spark job.

Pages are rows (page_id, url, html).  The split into articles and the field
picks are regular expressions evaluated in the JVM; the post-shaped form
(name node, spans, time, text node), whose nested markup a regular
expression cannot follow, parses each article with Python's ``html.parser``
inside ``mapInPandas`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import strip_space
from postlens.functions.time import parse_post_time
from postlens.operators.firsts import first_rows, packed_order

# The capture site and its search URL template.
SITE = "https://x.com"
SEARCH_URL = "https://x.com/search?q={q}&src=typed_query&f=live"

# '<' comes first for all of it, so that plain text is passed over by one character's test.
ARTICLE_TAG = r"<(?:(?i:article)(?=[\s>/])[^>]*|/(?i:article)\s*)>"
HEADING = r"(?s)<h1[^>]*>(.*?)</h1>"
HREF = r"<a\s[^>]*?href=\"([^\"]*)\""
TAG = r"<[^>]+>"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"

# The five basic HTML entities, decoded last-to-first so '&amp;lt;' stays '&lt;'.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _unescape(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def text_of(html: Column) -> Column:
    """Text content of a fragment: tags removed, basic entities decoded, stripped."""
    return strip_space(_unescape(F.regexp_replace(html, TAG, "")))


def articles(pages: DataFrame) -> DataFrame:
    """B1: one row per <article> of a page, in the order of their opening tags; the page itself is not copied.

    Articles nest: one that is quoted inside another is a row of its own, and the
    outer one holds it.  An opening tag is closed by the first closing tag that
    brings the running depth back below it; one that nothing closes runs to the
    end of the page.  Tags may be written in either case; stray closing tags close nothing.
    """
    cut = pages.select("page_id", "url", F.regexp_extract_all("html", F.lit(ARTICLE_TAG), 0).alias("_tags"), F.split("html", ARTICLE_TAG, -1).alias("_parts"))
    steps = F.transform("_tags", lambda t: F.when(t.startswith("</"), F.lit(-1)).otherwise(F.lit(1)))
    cut = cut.withColumn("_depths", F.aggregate(steps, F.array().cast("array<int>"), lambda ds, s: F.concat(
        ds, F.array((F.coalesce(F.try_element_at(ds, F.lit(-1)), F.lit(0)) + s).cast("int")))))
    tag, part, depth, n = F.col("_tags"), F.col("_parts"), F.col("_depths"), F.size("_tags")

    def content(i: Column) -> Column:
        closed = F.array_position(F.slice("_depths", i + 2, n), depth[i] - 1).cast("int")  # 0: never
        inside = F.when(closed > 0, closed - 1).otherwise(n - 1 - i)  # tags inside
        rest = F.transform(F.arrays_zip(F.slice("_tags", i + 2, inside).alias("t"), F.slice("_parts", i + 3, inside).alias("p")), lambda x: F.concat(x["t"], x["p"]))
        return F.concat(part[i + 1], F.array_join(rest, ""))

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    opened = F.filter(every, lambda i: ~tag[i].startswith("</"))
    # Outer, and without a filter before it: either would have the page cut once more to see whether it has articles.
    out = cut.select("page_id", "url", F.posexplode_outer(F.transform(opened, content)).alias("article_no", "article"))
    return out.filter(F.col("article_no").isNotNull())


def absolute(url: Column, href: Column) -> Column:
    """A site-relative link made absolute against the page's origin."""
    origin = F.regexp_extract(url, ORIGIN, 1)
    return F.when(href.startswith("/"), F.concat(origin, href)).otherwise(href)


def article_fields(arts: DataFrame) -> DataFrame:
    """Fields of each article: title (h1), text (the rest), links of the article.

    B2 needs a title node, more than two links and a text; B3 picks the third
    link; B6 strips every field.
    """
    body = F.regexp_replace(F.col("article"), HEADING, "")
    links = F.regexp_extract_all(F.col("article"), F.lit(HREF), 1)
    return arts.select(
        "page_id", "url", "article_no",
        text_of(F.regexp_extract(F.col("article"), HEADING, 1)).alias("title"),
        F.when(F.col("article").rlike(r"<h1[\s>]"), F.lit(True)).otherwise(F.lit(False)).alias("has_title"),
        text_of(body).alias("text"),
        F.size(links).alias("n_links"),
        F.when(F.size(links) > 2, absolute(F.col("url"), F.element_at(links, 3))).alias("link"),
    )


def reject_reason(min_links: int = 3) -> Column:
    """B2 + B6: why an article is not kept (null when it is)."""
    return (F.when(~F.col("has_title"), F.lit("no title node"))
            .when(F.col("n_links") < min_links, F.lit("too few links"))
            .when(F.length("title") == 0, F.lit("empty title"))
            .when(F.length("text") == 0, F.lit("empty text")))


def extract_articles(pages: DataFrame, min_links: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pages -> (kept articles, rejected articles with a reason).

    ``min_links``: links that an article needs of its own; general pages, whose
    articles are prose, take 0.
    """
    f = article_fields(articles(pages)).withColumn("reason", reject_reason(min_links))
    kept = f.filter(F.col("reason").isNull()).select("page_id", "article_no", "title", "text", "link")
    rejected = f.filter(F.col("reason").isNotNull()).select("page_id", "article_no", "reason")
    return kept, rejected


# --- post-shaped articles ------------------------------------------------------------------------

class _Node:
    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.text = tag, attrs, [], []

    def walk(self):
        """Everything below, in document order; a stack of its own, so depth has no limit."""
        todo = list(reversed(self.children))
        while todo:
            ch = todo.pop()
            yield ch
            if isinstance(ch, _Node):
                todo.extend(reversed(ch.children))

    def content(self) -> str:
        return "".join(ch for ch in self.walk() if isinstance(ch, str))

    def find_all(self, pred):
        return (ch for ch in self.walk() if isinstance(ch, _Node) and pred(ch))


_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "param",
         "track"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.stack = [self.root]

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, dict(attrs))
        self.stack[-1].children.append(n)
        if tag not in _VOID:
            self.stack.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _testid(value: str):
    return lambda n: n.attrs.get("data-testid") == value


def parse_post_article(html: str) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """One post-shaped article -> (username, text, time text, link, reason).

    Rules of the capture: a name node with more than two links (the third is
    the post link), more than three spans, a time node and a text node; the
    user name is span 3 when there are exactly four spans, else span 4.
    """
    t = _Tree()
    t.feed(html or "")
    t.close()
    name = next(t.root.find_all(_testid("User-Name")), None)
    if name is None:
        return None, None, None, None, "no name node"
    links = list(name.find_all(lambda n: n.tag == "a"))
    if len(links) <= 2:
        return None, None, None, None, "too few links"
    href = links[2].attrs.get("href")
    spans = list(name.find_all(lambda n: n.tag == "span"))
    tm = next(name.find_all(lambda n: n.tag == "time"), None)
    body = next(t.root.find_all(_testid("tweetText")), None)
    if not (len(spans) > 3 and tm is not None and body is not None):
        return None, None, None, None, "unexpected structure"
    user = (spans[2] if len(spans) == 4 else spans[3]).content().strip()
    text = body.content().strip()
    when = tm.attrs.get("datetime")
    if not (user and text and when):
        return None, None, None, None, "empty field"
    return user, text, when, f"{SITE}{href}", None


def _parse_or_reject(html: str) -> tuple:
    """One article that cannot be parsed is a reject, never a failed job."""
    try:
        return parse_post_article(html)
    except Exception as e:  # noqa: BLE001 - whatever markup raises, the row is kept with its reason
        return None, None, None, None, f"unreadable: {type(e).__name__}"


def _parse_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        parsed = [_parse_or_reject(h) for h in pdf["article"]]
        out = pdf.drop(columns=["article"]).copy()
        out["username"] = [p[0] for p in parsed]
        out["tweetText"] = [p[1] for p in parsed]
        out["time_text"] = [p[2] for p in parsed]
        out["tweet_link"] = [p[3] for p in parsed]
        out["reason"] = [p[4] for p in parsed]
        yield out


def extract_posts(arts: DataFrame) -> DataFrame:
    """B2/B3/B5/B6 on post-shaped articles (columns: category, tag, seen, article).

    The parse runs per Arrow batch in the tasks; the time is parsed strictly
    in the JVM afterwards, a bad time becomes a rejected row (B5).
    """
    keep = [c for c in arts.columns if c != "article"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arts.schema.fields if f.name != "article")
    schema += ", username string, tweetText string, time_text string, tweet_link string, reason string"
    p = arts.mapInPandas(_parse_batches, schema)
    p = p.withColumn("postTimeRaw", parse_post_time("time_text"))
    p = p.withColumn("reason", F.when(F.col("reason").isNull() & F.col("postTimeRaw").isNull(),
                                      F.lit("bad time")).otherwise(F.col("reason")))
    return p.select(*keep, "username", "tweetText", "postTimeRaw", "tweet_link", "reason")


def dedup_first_seen(posts: DataFrame, seen_col: str = "seen") -> DataFrame:
    """Per tag, the first-seen post of each (username, text); across tags the
    same post stays.  ``seen_col``: a time or a whole number, nulls last."""
    timed = posts.schema[seen_col].dataType.typeName().startswith("timestamp")
    seen = F.col(seen_col)
    return first_rows(posts, ["tag", "username", "tweetText"], packed_order(seen, None) if timed else packed_order(None, seen))


# --- B9 + J7 + J8: search targets from the tag catalog -----------------------------------------

def percent_encode(c: Column) -> Column:
    """RFC 3986 percent-encoding of every reserved character (safe='').

    ``url_encode`` is form encoding: it writes a space as '+', keeps '*' and
    encodes '~'.  Those three are repaired; a literal '+' is already '%2B'.
    """
    e = F.url_encode(c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    return F.replace(e, F.lit("%7E"), F.lit("~"))


def search_url(tag: Column) -> Column:
    """The search URL of one tag."""
    head, tail = SEARCH_URL.split("{q}")
    return F.concat(F.lit(head), percent_encode(tag), F.lit(tail))


def tag_targets(catalog: DataFrame) -> DataFrame:
    """(category, tags) catalog -> one (category, tag, url) per distinct tag."""
    if "tags" in catalog.columns:
        catalog = catalog.select("category", F.explode("tags").alias("tag"))
    pairs = catalog.select("category", "tag").distinct()
    return pairs.withColumn("url", search_url(F.col("tag")))
