"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: four kinds are found by fixed expressions (``BASE``) and checks.
2. Patterns: what stands around an identifier.  Each occurrence gives up to three
   lexical patterns: the two words before it, the words on either side, the
   two words after it.
3. Candidates: anything else shaped like an identifier (``LOOSE``): numbers with
   other separators or without a plus sign, addresses with a spelt-out at sign.
   A candidate can be of a kind only if it passes that kind's check.
4. Graph: patterns and values, one edge however often they meet (copies of a
   document prove nothing new).  Each round scores, for every kind,
   * a pattern by its values: known ones of the kind against known ones of
     other kinds and candidates that cannot be of this kind, plus one;
     fewer than ``SUPPORT`` known values are no evidence;
   * a candidate by its patterns of at least ``CONFIDENT``: one less the product of
     their doubts.  At ``ACCEPTED`` it becomes a known value of its best kind,
     and lends its score to its own patterns in the next round.
   Scores are whole thousandths, so sums do not depend on their order.
5. Every occurrence of an accepted value is added to the spans of the seeds.

A pass over the texts writes the hits with their contexts; everything after it
moves hits, not texts.  A word or value that is everywhere is pre-aggregated by
its distinct edges; joins on it are left to the adaptive skew split.

Expressions are written with possessive quantifiers, so matching is linear in
the text and needs no stack; they match what ``BASE``'s plain forms match, because
no character could be given back to any use.

Defined results: null and empty texts have no spans.  Repeated documents are
documents each.  A null id is returned as such.  An empty table gives an
empty one.  Extra columns, of any name, are not looked at.  A candidate that
overlaps a seed, or a number that overlaps a spelt-out address, is no candidate.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import stored

# The kinds in their order and their expressions.
KINDS = ["email", "ip", "card", "phone"]
BASE = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_AT, _DOT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20?@\x20?)", r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)"
LOOSE = [
    rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    r"[(]?[0-9](?:[\x20()\[\]{}./_:-]{0,3}+[0-9])++",
]
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDRESS, NUMBER = 4, 5  # the classes of LOOSE, after the kinds

ROUNDS = 3
SUPPORT = 3
CONFIDENT = 500
ACCEPTED = 900
NEAR = 80  # characters beside a hit in which its context words are looked for


class Found(NamedTuple):
    documents: DataFrame  # rid, doc_id: every document
    spans: DataFrame  # rid, kind (its place in KINDS), start, stop, value, base, score


# ---------------------------------------------------------------- occurrences

def _words(side: Column, before: bool) -> Column:
    """The nearest two words in front of a hit, or behind it, farthest left first; empty if there are none."""
    if before:
        return F.regexp_extract(F.lower(F.right(side, F.lit(NEAR))), r"(\p{L}++\P{L}++\p{L}++)\P{L}*+$", 1)
    return F.regexp_extract(F.lower(F.left(side, F.lit(NEAR))), r"^\P{L}*+(\p{L}++\P{L}++\p{L}++)", 1)


def _hits(texts: DataFrame) -> DataFrame:
    """(rid, doc_id, hits): one pass over the texts."""
    cut = {}
    for n, e in enumerate(BASE + LOOSE):
        sign = "@" if n == 0 else "+" if n == KINDS.index("phone") else None
        there = F.contains("text", F.lit(sign)) if sign else F.col("text").rlike("[0-9@]" if n != ADDRESS else r"@|[(\[{]\x20?at\x20?[)\]}]")
        cut[f"gaps{n}"] = F.when(there, F.split("text", e, -1))
        cut[f"hits{n}"] = F.when(there, F.regexp_extract_all("text", F.lit(e), 0))
    parts = texts.select("rid", "doc_id", *[c.alias(k) for k, c in cut.items()])

    def hits(n: int) -> Column:
        gaps = F.col(f"gaps{n}")
        return F.coalesce(F.transform(f"hits{n}", lambda h, i: F.struct(
            F.lit(n).alias("class"), i.alias("i"), F.length(gaps[i]).alias("gap"), h.alias("value"),
            _words(gaps[i], True).alias("before"), _words(gaps[i + 1], False).alias("after"))), F.array())

    every = reduce(lambda a, b: F.concat(a, b), [hits(n) for n in range(len(BASE + LOOSE))])
    return parts.select("rid", "doc_id", every.alias("hits"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _checks(value: Column) -> list[Column]:
    """Whether digits and groups of a value suit each kind (address: its shape says so)."""
    digits = _digits(value)
    card = F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return [F.lit(True), value.rlike(rf"^[^0-9]*{OCTET}(?:[^0-9]+{OCTET}){{3}}[^0-9]*$"), card, F.length(digits).between(10, 15)]


def _occurrences(found: DataFrame) -> DataFrame:
    """Seeds that pass their check and candidates that overlap nothing before them, with places and contexts."""
    rows = found.select("rid", F.explode("hits").alias("h")).select("rid", "h.*").repartition("rid")
    size = F.length("value")
    stop = F.sum(F.col("gap") + size).over(Window.partitionBy("rid", "class").orderBy("i"))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - size).drop("i", "gap")
    ok = _checks(F.col("value"))
    can = [(F.col("class") == k) & ok[k] | (F.col("class") == (ADDRESS if k == 0 else NUMBER)) & ok[k] for k in range(len(KINDS))]
    rows = rows.withColumn("can", F.array(*can)).filter((F.col("class") >= ADDRESS) | F.array_contains("can", True))
    here = Window.partitionBy("rid")
    blocked = F.lit(False)
    for rank in (ADDRESS, NUMBER):  # seeds are before addresses, these before numbers
        last = F.max(F.when(F.col("class") < rank, F.col("stop"))).over(here.orderBy("start"))
        nxt = F.min(F.when(F.col("class") < rank, F.col("start"))).over(here.orderBy(F.desc("start")))
        overlaps = F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(nxt < F.col("stop"), F.lit(False))
        blocked = blocked | ((F.col("class") == rank) & overlaps)
    rows = rows.withColumn("blocked", blocked).filter(~F.col("blocked")).drop("blocked")
    return rows.withColumn("node", F.unhex(F.md5(F.concat(F.col("class").cast("string"), F.lit(":"), F.col("value")))))


# ---------------------------------------------------------------- graph

def _edges(occurrences: DataFrame) -> DataFrame:
    """(pattern, node, class, can), each once."""
    two = lambda c: F.split(c, r"\P{L}+")
    b, a = two("before"), two("after")
    there = lambda c: F.length(c) > 0
    patterns = F.array(F.when(there("before"), F.concat_ws(" ", b[0], b[1], F.lit("_"))),
                       F.when(there("before") & there("after"), F.concat_ws(" ", b[1], F.lit("_"), a[0])),
                       F.when(there("after"), F.concat_ws(" ", F.lit("_"), a[0], a[1])))
    rows = occurrences.select("node", "class", "can", F.explode(patterns).alias("pattern")).filter("pattern is not null")
    return rows.groupBy("pattern", "node").agg(F.first("class").alias("class"), F.first("can").alias("can"))  # one value each per node


def _patterns(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """(pattern, trust0 .. trust3): thousandths by kind."""
    if known is not None:
        edges = edges.join(known, "node", "left")
    else:
        edges = edges.withColumns({"kind": F.lit(None).cast("int"), "score": F.lit(None).cast("long")})
    seed = F.col("class") < ADDRESS
    kind = F.when(seed, F.col("class")).otherwise(F.col("kind"))
    score = F.when(seed, F.lit(1000)).otherwise(F.col("score"))
    sums, trust = [], []
    for k in range(len(KINDS)):
        for_it, against = kind == k, F.coalesce(kind != k, ~F.col("can")[k])
        sums += [F.sum(F.when(for_it, score).otherwise(0)).alias(f"pos{k}"), F.count_if(for_it).alias(f"n{k}"), F.count_if(against).alias(f"neg{k}")]
        trust.append(F.when(F.col(f"n{k}") >= SUPPORT, F.expr(f"1000 * pos{k} div (pos{k} + 1000 * neg{k} + 1000)")).alias(f"trust{k}"))
    out = edges.groupBy("pattern").agg(*sums).select("pattern", *trust)
    return out.filter(F.greatest(*[F.coalesce(f"trust{k}", F.lit(0)) for k in range(len(KINDS))]) >= CONFIDENT)


def _accepted(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(node, kind, score) of the candidates that their patterns vouch for."""
    met = edges.filter(F.col("class") >= ADDRESS).join(patterns, "pattern")
    doubt = [F.sum(F.when(F.col("can")[k] & (F.col(f"trust{k}") >= CONFIDENT), F.floor(-1e6 * F.log1p(-F.col(f"trust{k}") / 1000)))).alias(f"d{k}")
             for k in range(len(KINDS))]
    scores = [1000 - F.ceil(1000 * F.exp(-F.coalesce(f"d{k}", F.lit(0)) / 1e6)) for k in range(len(KINDS))]
    best = F.greatest(*[F.struct(s.cast("long").alias("score"), F.lit(-k).alias("first")) for k, s in enumerate(scores)])
    out = met.groupBy("node").agg(*doubt).select("node", best.alias("best"))
    return out.filter(F.col("best.score") >= ACCEPTED).select("node", (-F.col("best.first")).alias("kind"), F.col("best.score").alias("score"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Found:
    """Spans of personal data in whole texts, in characters (code points), ends exclusive.

    ``base`` spans come from the expressions; the others are accepted values'
    occurrences with their score in thousandths.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        F.monotonically_increasing_id().alias("rid"))
    found = stored(_hits(texts), "pii-hits")
    occurrences = stored(_occurrences(found), "pii-occurrences")
    edges = stored(_edges(occurrences), "pii-edges")
    known = None
    for _ in range(rounds):
        new = _accepted(edges, _patterns(edges, known))
        if known is not None:
            new = known.union(new.join(known, "node", "left_anti"))
        known = stored(new, "pii-known")
    spans = occurrences.filter(F.col("class") < ADDRESS).select("rid", F.col("class").alias("kind"), "start", "stop", "value",
                                                                F.lit(True).alias("base"), F.lit(1000).cast("long").alias("score"))
    if known is not None:
        more = occurrences.filter(F.col("class") >= ADDRESS).join(known, "node")
        spans = spans.union(more.select("rid", "kind", "start", "stop", "value", F.lit(False), "score"))
    return Found(found.select("rid", "doc_id"), spans)


def summary(found: Found) -> DataFrame:
    """One row per document: counts of seeds by kind, n_added, and spans as ``kind:start:end`` lists."""
    own = F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "base")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))
    rows = found.spans.groupBy("rid").agg(own.alias("own"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(KINDS)])
    rows = rows.select("rid", *[f"n_{n}" for n in KINDS], F.array_join(F.transform(F.filter("own", lambda s: s["base"]), text), ",").alias("base"),
                       F.array_join(F.transform("own", text), ",").alias("spans"), F.size(F.filter("own", lambda s: ~s["base"])).cast("long").alias("n_added"))
    every = found.documents.join(rows, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.select("doc_id", *[zero(f"n_{n}") for n in KINDS], F.coalesce("base", F.lit("")).alias("base"),
                        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
