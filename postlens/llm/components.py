"""Connected components of a link table by distributed union-find.

Each partition first shrinks its links to a spanning forest with an in-task
union-find; rounds of large-star and small-star steps then hang every node on
the smallest node of its component.  Every round writes its (shrinking) link
table to the shared folder, so a lost executor costs one round at most.  All
minima are aggregates with a map-side part; a node with very many links is a
skewed join that adaptive execution splits.  Links and components never
reach the driver, only two numbers per round do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stored

LINKS = "u long, v long"


def find(parent: dict, x):
    """Root of x, halving the path on the way."""
    while True:
        p = parent.setdefault(x, x)
        if p == x:
            return x
        parent[x] = parent.setdefault(p, p)
        x = parent[x]


def unite(parent: dict, a, b) -> bool:
    """Join two classes under the smaller root; False if they were one."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's links, each node linked with its root instead."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in batches:
        parent: dict = {}
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            unite(parent, u, v)
        pairs = [(x, find(parent, x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], schema=schema)


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``links`` (u, v).

    component: the smallest node reachable, the node itself included.  Null
    ends and links of a node with itself are ignored (a node with only such
    links is absent); repeated links and either direction are fine; no links
    give an empty table.
    """
    cur = (links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
           .filter("u is not null and v is not null and u <> v"))
    cur = stored(cur.mapInArrow(_forest, LINKS).distinct(), "links")
    before = _state(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = (large.join(small, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                .filter("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct())
        cur = stored(hung, "links")
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
