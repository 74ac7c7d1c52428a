"""Near-duplicate embeddings: exact threshold links by cover-tree dual traversal.

Vectors of one label are compared as unit vectors; cosine >= t is distance <=
tau = sqrt(2 - 2t).

* Top of the tree, on Spark: each label has pivots (about one for
  ``CELL_ROWS`` vectors, at most ``PIVOTS``); every vector goes to its nearest
  pivot's cell, and the cell's covering radius is the largest distance in it.
  Two cells meet only if d(p, q) <= r_p + r_q + tau.
* A large cell is dealt over blocks of about ``BLOCK_ROWS`` vectors, so a label
  or a cell that holds a third of all rows is many tasks.
* In a task: a cover tree of each block (nested levels, radii 2, 1, 1/2, ...),
  traversed together.  A pair of nodes is dropped when d > r_a + r_b + tau and
  linked as a whole when d + r_a + r_b <= tau; otherwise its children meet.
  What is left at the last level is compared exactly.

A task returns link counts and a spanning forest of its links, never all pairs;
counts are added per vector and forests joined by union-find.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import stored
from postlens.llm.components import components, find, unite
from postlens.llm.vectors import dots, matrix, with_usable

CELL_ROWS = 2048
PIVOTS = 64
BLOCK_ROWS = 1024
BROADCAST_PIVOTS = 16_384
LEVELS = (2.0, 1.0, 0.5, 0.25, 0.125)
MARGIN = 1e-9  # rounding of distances: bounds decide only beyond it
SOME_PAIRS = 1 << 15


class CoverTree:
    """Nested levels: nodes are ranges of ``order``; children of a node are a range of the next level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order, groups = np.arange(len(x)), [np.arange(len(x))]
        self.levels = []  # (center row, radius, begin, size, first child, children)
        centers = [0]
        for depth, _ in enumerate(LEVELS):
            begin, rows, radius = 0, [], []
            for c, members in zip(centers, groups):
                d = self._distance(members, c)
                radius.append(float(d.max()))
                rows.append((c, begin, len(members)))
                begin += len(members)
            order = np.concatenate(groups)
            kids, nxt_centers, nxt_groups = [], [], []
            if depth + 1 < len(LEVELS):
                for (c, _, _), members, r in zip(rows, groups, radius):
                    found = [(c, members)] if r <= LEVELS[depth + 1] else self._cover(members, c, LEVELS[depth + 1])
                    kids.append((len(nxt_centers), len(found)))
                    nxt_centers += [f[0] for f in found]
                    nxt_groups += [f[1] for f in found]
            self.levels.append({"center": np.array([r[0] for r in rows]), "radius": np.array(radius), "begin": np.array([r[1] for r in rows]),
                                "size": np.array([r[2] for r in rows]), "order": order,
                                "kid": np.array([k[0] for k in kids], int), "kids": np.array([k[1] for k in kids], int)})
            centers, groups = nxt_centers, nxt_groups

    def _distance(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[center]), 0)) if len(rows) > 1 else np.zeros(1)

    def _cover(self, members: np.ndarray, center: int, r: float) -> list[tuple[int, np.ndarray]]:
        """Centres more than ``r`` apart, the node's own first, each with the rest within ``r``."""
        out, left = [], members
        while len(left):
            near = self._distance(left, center) <= r
            near |= left == center
            out.append((center, left[near]))
            left = left[~near]
            if len(left):
                center = left[0]
        return out


class Links:
    """Link counts of rows and a spanning forest of the links."""

    def __init__(self, n: int):
        self.counts, self.parent = np.zeros(n, np.int64), {}

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.counts, a, 1)
        np.add.at(self.counts, b, 1)
        for u, v in zip(a.tolist(), b.tolist()):
            unite(self.parent, u, v)

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every row of ``a`` with every row of ``b`` (of ``a``, if the same)."""
        self.counts[a] += len(b) - same
        if not same:
            self.counts[b] += len(a)
        for u in [*a[1:].tolist(), *b.tolist()]:
            unite(self.parent, int(a[0]), u)


def _products(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes n, m: (pair number, i, j) of all i < n, j < m of each pair."""
    total = n * m
    of = np.repeat(np.arange(len(n)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return of, k // m[of], k % m[of]


def traverse(a: CoverTree, b: CoverTree, same: bool, cosine: float, links: Links, shift: int) -> None:
    """Links between the rows of two trees (within one, if the same); b's rows count from ``shift``."""
    tau = math.sqrt(max(2 - 2 * cosine, 0))
    pa, pb = np.zeros(1, int), np.zeros(1, int)
    for depth in range(len(LEVELS)):
        la, lb = a.levels[depth], b.levels[depth]
        keep_a, keep_b = [], []
        dense = len(pa) > 0.05 * len(la["center"]) * len(lb["center"])
        table = a.x[la["center"]] @ b.x[lb["center"]].T if dense else None
        for lo in range(0, len(pa), SOME_PAIRS):
            i, j = pa[lo:lo + SOME_PAIRS], pb[lo:lo + SOME_PAIRS]
            dot = table[i, j] if dense else dots(a.x[la["center"][i]], b.x[lb["center"][j]])
            d = np.sqrt(np.maximum(2 - 2 * dot, 0))
            if same:
                d[i == j] = 0.0
            r = la["radius"][i] + lb["radius"][j]
            near = d <= r + tau + MARGIN + 1e-7 * (d < 1e-6)
            # The rows of one node are up to twice its radius apart.
            whole = np.where(same & (i == j), 2 * la["radius"][i], d + r) <= tau - 1e-6
            for x, y in zip(i[whole], j[whole]):
                rows_a = la["order"][la["begin"][x]:la["begin"][x] + la["size"][x]]
                rows_b = lb["order"][lb["begin"][y]:lb["begin"][y] + lb["size"][y]] + shift
                links.whole(rows_a, rows_b, bool(same and x == y))
            go = near & ~whole
            keep_a.append(i[go])
            keep_b.append(j[go])
        if not any(len(k) for k in keep_a):
            return
        pa, pb = np.concatenate(keep_a), np.concatenate(keep_b)
        if depth + 1 < len(LEVELS):
            of, i, j = _products(la["kids"][pa], lb["kids"][pb])
            na, nb = la["kid"][pa][of] + i, lb["kid"][pb][of] + j
            if same:  # each pair of children once
                once = na <= nb
                na, nb = na[once], nb[once]
            pa, pb = na, nb
    la, lb = a.levels[-1], b.levels[-1]
    step = 0
    while step < len(pa):  # as many pairs of nodes at a time as hold about SOME_PAIRS pairs of rows
        work = np.cumsum(la["size"][pa[step:]] * lb["size"][pb[step:]])
        n = max(1, int(np.searchsorted(work, SOME_PAIRS, side="right")))
        i, j = pa[step:step + n], pb[step:step + n]
        step += n
        of, u, v = _products(la["size"][i], lb["size"][j])
        u, v = la["order"][la["begin"][i][of] + u], lb["order"][lb["begin"][j][of] + v]
        if same:  # rows of different nodes meet in one order only, rows of one node in both
            once = (i[of] != j[of]) | (u < v)
            u, v = u[once], v[once]
        for lo in range(0, len(u), SOME_PAIRS):
            x, y = u[lo:lo + SOME_PAIRS], v[lo:lo + SOME_PAIRS]
            hit = dots(a.x[x], b.x[y]) >= cosine
            links.pairs(x[hit], y[hit] + shift)


def block_links(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray | None, b: np.ndarray | None, cosine: float) -> pd.DataFrame:
    """(vec_id, n_links, root) of the rows of one or two blocks that have links."""
    same = ids_b is None
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    links = Links(len(ids))
    if len(ids_a) and (same or len(ids_b)):
        tree = CoverTree(a)
        traverse(tree, tree if same else CoverTree(b), same, cosine, links, 0 if same else len(ids_a))
    at = np.flatnonzero(links.counts)
    return pd.DataFrame({"vec_id": ids[at], "n_links": links.counts[at], "root": ids[[find(links.parent, int(r)) for r in at]] if len(at) else ids[:0]})


def near_duplicates(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null and their cosine, in
    double precision, is at least ``cosine``.  n_links: other vectors linked directly;
    component_id: the smallest vec_id reachable by links, itself included;
    kept: vec_id = component_id.  Vectors are compared with those of their own
    dimension.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do rows with a null id (component_id null, kept null).  Rows
    repeated as a whole count once; a vec_id with several vectors is one
    vector with the links of all of them.  An empty table gives none.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    everything = base.select("vec_id").distinct()
    marked = with_usable(base.filter("vec_id is not null and label is not null").dropDuplicates(), "vec")
    marked = marked.withColumn("label", F.concat_ws(":", F.col("dim").cast("string"), F.col("label").cast("string")))  # a dimension's own labels
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    units = (marked.withColumn("norm", norm).filter("norm > 0")
             .select("vec_id", "label", F.transform("vec", lambda v: v / F.col("norm")).alias("vec")))
    units = stored(units, "units")

    # ---- pivots: hash order, so the same ones whenever this runs again
    hashed = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    cells = units.groupBy("label").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / CELL_ROWS)).cast("int").alias("cells"), F.count("*").alias("n"))
    few = (units.join(cells.filter("cells > 1"), "label").withColumn("h", hashed)
           .filter(F.col("h") < 8.0 * F.col("cells") / F.col("n")))  # about 8 per pivot wanted
    pivots = (few.withColumn("cell", F.row_number().over(Window.partitionBy("label").orderBy("h", "vec_id")) - 1)
              .filter("cell < cells").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("cell", "vec"))).alias("pivots"))
              .select("label", F.transform("pivots", lambda p: p["vec"]).alias("pivots")))
    pivots = stored(pivots, "pivots")

    def nearest(vecs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dot = vecs @ own.T
        cell = dot.argmax(axis=1)
        return cell, np.sqrt(np.maximum(2 - 2 * dot[np.arange(len(vecs)), cell], 0))

    def assign(of_label):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b.reset_index(drop=True)
                cell, dist = np.zeros(len(b), np.int32), np.full(len(b), 2.0)
                for label, group in b.groupby("label"):
                    own = of_label(label, group)
                    if own is not None:
                        cell[group.index], dist[group.index] = nearest(matrix(group["vec"]), own)
                yield b[["vec_id", "label", "vec"]].assign(cell=cell, dist=dist)

        return run

    kind = dict(units.dtypes)["label"]
    placed = f"vec_id long, label {kind}, vec array<double>, cell int, dist double"
    if pivots.agg(F.coalesce(F.sum(F.size("pivots")), F.lit(0))).first()[0] <= BROADCAST_PIVOTS:
        table = spark.sparkContext.broadcast({r["label"]: np.array(r["pivots"], float) for r in pivots.collect()})
        celled = units.mapInPandas(assign(lambda label, _: table.value.get(label)), placed)
    else:
        joined = units.join(pivots, "label", "left")
        celled = joined.mapInPandas(assign(lambda _, group: None if group["pivots"].iloc[0] is None else np.vstack(group["pivots"].iloc[0]).astype(float)), placed)
    celled = stored(celled, "cells")

    stats = celled.groupBy("label", "cell").agg(F.max("dist").alias("r"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    stats = stored(stats.join(pivots, "label", "left").select("label", "cell", "r", "blocks", F.expr("pivots[cell]").alias("pivot")), "cell-stats")
    other = stats.select("label", *[F.col(c).alias(f"{c}2") for c in ("cell", "r", "blocks", "pivot")])
    dot = F.aggregate(F.zip_with("pivot", "pivot2", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    gap = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    tau = math.sqrt(max(2 - 2 * cosine, 0))
    meet = (stats.join(other, "label").filter("cell <= cell2")
            .filter((F.col("cell") == F.col("cell2")) | F.col("pivot").isNull() | (gap <= F.col("r") + F.col("r2") + tau + 1e-6))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("j", F.explode(F.sequence(F.when(F.col("cell") == F.col("cell2"), F.col("i")).otherwise(0), F.col("blocks2") - 1)))
            .select("label", "cell", "i", "cell2", "j"))
    meet = stored(meet, "block-pairs")
    dealt = (celled.join(stats.select("label", "cell", "blocks"), ["label", "cell"])
             .select("label", "cell", "vec_id", "vec", F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), "blocks").cast("int").alias("i")))
    left = dealt.join(meet, ["label", "cell", "i"])
    again = dealt.select(*[F.col(c).alias({"cell": "cell2", "i": "j"}.get(c, c)) for c in dealt.columns])
    right = again.join(meet.filter("not (cell = cell2 and i = j)"), ["label", "cell2", "j"])
    keys = ["label", "cell", "i", "cell2", "j"]

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[3] and key[2] == key[4]
        ids = a["vec_id"].to_numpy(np.int64)
        return block_links(ids, matrix(a["vec"]), None if same else b["vec_id"].to_numpy(np.int64), None if same else matrix(b["vec"]), cosine)

    found = (left.select(*keys, "vec_id", "vec").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vec").groupBy(*keys))
             .applyInPandas(compare, "vec_id long, n_links long, root long"))
    found = stored(found, "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    return (everything.join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").cast("long").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
