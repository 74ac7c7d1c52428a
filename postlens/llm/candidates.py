"""From groups of candidates to verified links, without all pairs of a group.

A group (all ids that share a key) may hold very many ids, most of them alike.
0. Of groups that the caller marks as ``few`` all pairs that can link are listed; each id is
   compared with its smallest partner, and what then lies in different components too.
   So the facts of the many small groups of ids that are not alike are moved once.
1. Star: every id is compared with a hub of each of its groups.  Hubs have the
   smallest cost (the most typical ids first), then the smallest of one of
   ``COLOURS`` hashes, the key choosing which; so groups of the same ids share a
   few hubs and a group of n ids costs about COLOURS * n pairs at most.
2. Verified links give components; groups of one component are finished.  A
   second star among what is left, by hash alone, joins more of it.
3. Pairs of ids that share a group, lie in different components, have not been
   compared and can link at all are then compared, each once.  So no link between
   two components is missed, and nothing is capped: links that are not looked
   for would join ids that are connected already.  ``marks`` tell here which pairs can
   link: in a group of near copies that are too far from each other to link, its
   pairs are met by a bit test each, but make no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stored
from postlens.llm.components import components

COLOURS = 3
STARS = 2


def _star(groups: DataFrame, seed: int, possible: str) -> DataFrame:
    """(a, b), a < b: each id with the hub of its group, where their components differ and a link is possible."""
    place = F.xxhash64(F.pmod("key", F.lit(COLOURS)) + F.lit(seed * COLOURS), "id")
    cost = F.col("cost") if seed == 0 else F.lit(0.0)
    facts = [c for c in groups.columns if c != "key"]
    hubs = groups.groupBy("key").agg(F.min(F.struct(cost.alias("c"), place.alias("h"), *facts)).alias("hub"))
    hubs = hubs.select("key", *[F.col(f"hub.{c}").alias(f"{c}2") for c in facts])
    pairs = groups.join(hubs, "key").filter(f"component <> component2 and ({possible})")
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _pairs(groups: DataFrame, condition: str) -> DataFrame:
    """(a, b), a < b: the pairs of a group that meet a condition."""
    other = groups.select("key", *[F.col(c).alias(f"{c}2") for c in groups.columns if c != "key"])
    return (groups.join(other, "key").filter(f"id < id2 and {condition}")
            .select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())


def _of_pairs(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) whose components are those of all ``pairs`` that are verified."""
    star = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    found = stored(verify(star).select(F.col("a").alias("u"), F.col("b").alias("v")), "found")
    now = components(found)
    rest = (pairs.join(star, ["a", "b"], "left_anti").join(now.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
            .join(now.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
            .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return found.union(stored(verify(stored(rest, "rest")).select(F.col("a").alias("u"), F.col("b").alias("v")), "found"))


def _unfinished(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of groups that hold more than one component."""
    now = components(links).withColumnsRenamed({"node": "id", "component": "now"})
    known = groups.join(now, "id", "left").withColumn("component", F.coalesce("now", "id")).drop("now").select(*groups.columns)
    open_keys = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return known.join(open_keys, "key")


def link(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: str = "true",
         marks: DataFrame | None = None, likely: str = "true") -> DataFrame:
    """Links (u, v) whose components are those of all pairs that share a group and are verified.

    groups: key long, id long (no nulls), optionally cost and facts of the id, each row once.
    few boolean, if there: the key's group is small enough for all its pairs.
    ``verify`` takes pairs (a, b), a < b, each once, and returns the pairs that link.
    ``possible``: SQL over the facts of two ids (the second one's end in 2) that holds for
    every pair that links.  Facts are copied into every group of the id: keep them small.
    ``marks``: larger facts, one row for every id (and for each value of other columns that both have); only what the stars leave open meets them.
    ``likely``: SQL like ``possible``, over the marks too.
    """
    tried = links = None
    if "few" in groups.columns:
        tried = stored(_pairs(groups.filter("few").drop("few"), possible), "few")
        links = _of_pairs(tried, verify)
        groups = groups.filter("not few").drop("few")
    if "cost" not in groups.columns:
        groups = groups.withColumn("cost", F.lit(0.0))
    groups = stored(groups.withColumn("component", F.col("id")), "groups")
    if groups.isEmpty() and links is not None:
        return links
    for seed in range(STARS):
        pairs = _star(groups, seed, possible)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "star")
        found = stored(verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v")), "found")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        groups = stored(_unfinished(groups, links), "groups")
        if groups.isEmpty():
            return links
    if marks is not None:
        groups = groups.join(marks, [c for c in marks.columns if c in groups.columns])
    rest = _pairs(groups, f"component <> component2 and ({possible}) and ({likely})").join(tried, ["a", "b"], "left_anti")
    return links.union(verify(stored(rest, "rest")).select(F.col("a").alias("u"), F.col("b").alias("v")))
