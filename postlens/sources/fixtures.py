"""Post-shaped views over the test tables.

The test tables hold no posts, so posts are derived from ``events`` (who, when,
which tag) and ``documents`` (what was written).  Every view reads whole
tables and whole texts; the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.schemas import STORED_COLUMNS
from postlens.sources.tables import read_table


def _category(event_type: Column) -> Column:
    return (F.when(event_type.isin("view", "click"), F.lit("engagement"))
            .when(event_type == "error", F.lit("incident"))
            .otherwise(F.lit("conversion")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event; its text is a whole document plus the tag."""
    events = read_table(spark, sf_dir, "events")
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # Scalar subquery inside the plan: no driver round trip, no cross join.
    n_docs = documents.select(F.count(F.lit(1))).scalar()
    return posts_of(events, documents, n_docs)


def posts_of(events: DataFrame, documents: DataFrame, n_docs: Column) -> DataFrame:
    """Events (batch or stream) joined to their documents, in post shape."""
    keyed = events.withColumn("_doc", F.col("event_id") % n_docs)
    j = keyed.join(documents, keyed["_doc"] == documents["doc_id"], "inner")
    return j.select(*_post_columns(F.concat(F.col("text"), F.lit(" #"), F.col("event_type")).alias("tweetText")))


def _post_columns(*text: Column) -> list[Column]:
    """A post's columns from its event's, and its text if given."""
    ts = F.col("ts")
    return [
        F.col("event_id").alias("post_id"),
        _category(F.col("event_type")).alias("category"),
        F.concat(F.lit("#"), F.col("event_type")).alias("tag"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        *text,
        ts.alias("postTimeRaw"),
        (ts + F.expr("INTERVAL 15 MINUTES")).alias("scrapeTime"),
        F.concat(F.lit("https://x.com/user"), F.col("user_id").cast("string"),
                 F.lit("/status/"), F.col("event_id").cast("string")).alias("tweet_link"),
        F.year(ts).cast("int").alias("year"),
        F.month(ts).cast("int").alias("month"),
        F.dayofmonth(ts).cast("int").alias("day"),
    ]


def dirty(p: DataFrame) -> DataFrame:
    """Inject the defects of ``posts_dirty`` into a posts frame (batch or stream)."""
    pid = F.col("post_id")
    x = p.select(
        "post_id", "category", "tag",
        _null_username(p).alias("username"),
        "tweetText",
        F.when(pid % 101 == 0, F.col("postTimeRaw") - F.expr("INTERVAL 6 YEARS"))
         .otherwise(F.col("postTimeRaw")).alias("postTimeRaw"),
        "scrapeTime", "tweet_link", "year",
        F.when(pid % 103 == 0, F.lit(13)).otherwise(F.col("month")).alias("month"),
        F.when(pid % 107 == 0, F.lit(0)).otherwise(F.col("day")).alias("day"),
    )
    return _repeated(x, 50)


def _repeated(x: DataFrame, every: int) -> DataFrame:
    """``x`` and once more its rows whose post_id is divisible by ``every``; a union would read the texts twice."""
    copies = F.when(F.col("post_id") % every == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.withColumn("_copy", F.explode(copies)).drop("_copy")


def _null_username(df: DataFrame) -> Column:
    return F.when(F.col("post_id") % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("username"))


def posts_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with injected defects: null user, old time, month 13, day 0, repeats."""
    return dirty(posts(spark, sf_dir))


def posts_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is already stored: days 1..20, some null users."""
    p = posts(spark, sf_dir)
    cols = [c if c != "username" else _null_username(p).alias("username") for c in p.columns]
    return p.filter(F.col("day") <= 20).select(*cols)


def posts_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new batch overlapping the store on days 19-20, with repeats."""
    p = posts(spark, sf_dir)
    cols = [c if c != "username" else _null_username(p).alias("username") for c in p.columns]
    x = p.filter(F.col("day").between(19, 22)).select(*cols)
    return _repeated(x, 40)


# The rule table that stands in for the remote topic model.
# (term, kind, topic, subtopic)
TOPIC_RULES = [
    ("that", "faq", "admissions", "documents"),
    ("attion", "faq", "admissions", "deadline"),
    ("que", "faq", "housing", "rules"),
    ("der", "faq", "housing", "hours"),
    ("was", "faq", "general", "click"),
    ("eriner", "issue", "registration", "outage"),
    ("anea", "issue", "registration", "stability"),
]


def topic_rules(spark: SparkSession) -> DataFrame:
    """The rules as an inline table, whose size Spark knows (as it knows a file's)."""
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in TOPIC_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, kind, topic, subtopic)")


def tag_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, tag) pairs of the tag catalog: region, '#' + nation."""
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    pairs = region.join(nation, region["r_regionkey"] == nation["n_regionkey"], "inner").select(
        F.col("r_name").alias("category"), F.concat(F.lit("#"), F.col("n_name")).alias("tag"))
    return pairs


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as captured records (RAW shape): scrapeTime still text, no date parts."""
    p = posts(spark, sf_dir)
    return p.select(
        "category", "tag", "username", "tweetText", "postTimeRaw",
        F.date_format("scrapeTime", "yyyy-MM-dd'T'HH:mm:ss").alias("scrapeTime"),
        "tweet_link", "post_id",
    )


def _escaped(c: Column) -> Column:
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


# What is wrong with a post's article, by post_id % 11 (0 to 4: nothing).
ARTICLE_DEFECTS = {5: "no name node", 6: "too few links", 7: "unexpected structure", 8: "empty field", 9: "bad time", 10: "unexpected structure"}


def _paged(spark: SparkSession, sf_dir: str, number: Column, head: Column, tail: Column) -> DataFrame:
    """(page_id, xs): for each two posts an array of (``number``, markup), sorted; markup: ``head``, the post's text escaped, ``tail``.

    The three columns are made from a post's columns but its text.  No post's text is
    shuffled: a page meets the documents of both its posts in one join, for which each
    document is sent to the pages where it is the first post's and to those where it is the second's.
    """
    events = read_table(spark, sf_dir, "events")
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = documents.select(F.count(F.lit(1))).scalar()
    page, place = F.floor(F.col("post_id") / 2).cast("long"), F.col("post_id") - 2 * F.col("page_id")
    p = events.select(*_post_columns()).withColumn("page_id", page)
    p = p.select("page_id", F.struct(place.alias("place"), (F.col("post_id") % n_docs).alias("doc"), number.alias("number"), head.alias("head"),
                                     F.concat(_escaped(F.concat(F.lit(" "), F.col("tag"))), tail).alias("tail")).alias("e"))
    pages = p.groupBy("page_id").agg(F.collect_list("e").alias("es")).withColumn("_at", F.pmod(2 * F.col("page_id"), n_docs))
    sent = documents.select("doc_id", _escaped(F.col("text")).alias("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    texts = (sent.groupBy(F.pmod(F.col("doc_id") - F.col("place"), n_docs).alias("_near"))
             .agg(F.collect_list(F.struct("place", "doc_id", "text")).alias("ds")))
    xs = F.flatten(F.transform("es", lambda e: F.transform(
        F.filter("ds", lambda d: (d["place"] == e["place"]) & (d["doc_id"] == e["doc"])),
        lambda d: F.struct(e["number"].alias("n"), F.concat(e["head"], d["text"], e["tail"]).alias("a")))))
    both = pages.join(texts, F.col("_at") == F.col("_near")).select("page_id", F.array_sort(xs).alias("xs"))
    return both.filter(F.size("xs") > 0)


def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of two post-shaped articles each, from every post.

    Texts are escaped and nested in markup; user names stand in the third of four
    spans or the fourth of five; times have 1 to 6 fraction digits; ``ARTICLE_DEFECTS``
    of all kinds are mixed in.
    """
    k = F.col("post_id") % 11
    digits = F.substr(F.lit("120450"), F.lit(1), (F.col("post_id") % 6 + 1).cast("int"))
    time = F.concat(F.date_format("postTimeRaw", "yyyy-MM-dd'T'HH:mm:ss."), digits, F.lit("Z"))
    time = F.when(k == 9, F.replace(time, F.lit("T"), F.lit(" "))).otherwise(time)
    user = F.when(k == 8, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("username"), F.lit(" ")))
    spans = F.when(F.col("post_id") % 2 == 0, F.concat(F.lit("<span>a</span><span>b</span><span>"), user, F.lit("</span><span>.</span>"))).otherwise(
        F.concat(F.lit("<span>a</span><span>b</span><span>c</span><span>"), user, F.lit("</span><span>.</span>")))
    spans = F.when(k == 7, F.lit("<span>a</span>")).otherwise(spans)
    path = F.substr(F.col("tweet_link"), F.lit(len("https://x.com") + 1))
    head = F.concat(
        F.lit("<article><div"), F.when(k == 5, F.lit("")).otherwise(F.lit(' data-testid="User-Name"')), F.lit('><a href="/u">U</a>'),
        F.when(k == 6, F.lit("")).otherwise(F.lit('<a href="/v">V</a>')), F.lit('<a href="'), path, F.lit('"><time datetime="'), time,
        F.lit('">t</time></a>'), spans, F.lit('</div><div'), F.when(k == 10, F.lit("")).otherwise(F.lit(' data-testid="tweetText"')), F.lit('> <p>'))
    return (_paged(spark, sf_dir, F.col("post_id"), head, F.lit("</p> </div></article>"))
            .select("page_id", F.lit("https://x.com/search").alias("url"),
                    F.concat(F.lit("<html><body>"), F.array_join(F.transform("xs", lambda x: x["a"]), "\n"), F.lit("</body></html>")).alias("html")))


def quoting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved page for every two posts: the even one quotes the odd one in an article of its own.

    Tags are in upper case on every other page; on every fifth the outer article is never closed.
    """
    time = F.concat(F.date_format("postTimeRaw", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    path = F.substr(F.col("tweet_link"), F.lit(len("https://x.com") + 1))
    head = F.concat(F.lit('<div data-testid="User-Name"><a href="/u">U</a><a href="/v">V</a><a href="'), path, F.lit('"><time datetime="'), time,
                    F.lit('">t</time></a><span>a</span><span>b</span><span>'), F.col("username"), F.lit('</span><span>.</span></div><div data-testid="tweetText">'))
    both = _paged(spark, sf_dir, F.col("post_id") % 2, head, F.lit("</div>"))
    upper = F.col("page_id") % 2 == 1
    tag, end = F.when(upper, "ARTICLE").otherwise("article"), F.when(upper, "</ARTICLE >").otherwise("</article>")
    inner = F.transform("xs", lambda x: F.when(x["n"] == 0, x["a"]).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), x["a"], end)))
    close = F.when(F.col("page_id") % 5 == 0, "").otherwise(end)
    return both.select("page_id", F.lit("https://x.com/search").alias("url"),
                       F.concat(F.lit("<html></article><"), tag, F.lit(' class="p">'), F.array_join(inner, ""), F.lit("<footer>f</footer>"), close, F.lit("</html>")).alias("html"))


def stored(p: DataFrame) -> DataFrame:
    """A posts view in the form of the posts store (with ``index``)."""
    return p.withColumn("index", (F.col("post_id") + 1).cast("long")).select(*STORED_COLUMNS)


# --- answers as a model wrote them: a table, like the other test data ------------------------------

# Free text around the JSON answer.
RESPONSE_HEAD = "Here are the groups for these messages:"
RESPONSE_TAIL = "Let me know if you need anything else."


def recorded_answers(batches: DataFrame, items: DataFrame, double_braces_every: int = 0, broken_every: int = 0) -> DataFrame:
    """(batch_id, response) for every batch of ``batches``.

    items: batch_id, rn, index, text, kind, topic, subtopic.  Every
    ``double_braces_every``-th batch's JSON has doubled braces, and of every
    ``broken_every``-th batch the answer breaks off, as answers sometimes do.
    """
    rows = items.select("batch_id", "rn", "kind", F.struct("index", "text", "topic", "subtopic").alias("item"))
    one = rows.groupBy("batch_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rn", "item")))), lambda x: x["item"]).alias(k)
                                         for k in ("issue", "faq")])
    none = F.array().cast(one.schema["faq"].dataType)
    body = F.to_json(F.struct(*[F.coalesce(F.col(k), none).alias(k) for k in ("issue", "faq")]))
    if double_braces_every:
        twice = F.replace(F.replace(body, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
        body = F.when(F.col("batch_id") % double_braces_every == 0, twice).otherwise(body)
    answer = F.concat(F.lit(f"{RESPONSE_HEAD}\n"), body, F.lit(f"\n{RESPONSE_TAIL}"))
    if broken_every:
        answer = F.when(F.col("batch_id") % broken_every == 0, F.lit(RESPONSE_HEAD)).otherwise(answer)
    return batches.select("batch_id").distinct().join(one, "batch_id", "left").select("batch_id", answer.alias("response"))
