"""Nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on at most ``SAMPLE`` rows (the smallest hashes of the id).
For the largest inner product every vector gets one more component,
``sqrt(M^2 - |x|^2)`` with the largest norm M, which turns it into nearness.
Every row is indexed: it goes down the tree to a leaf, and leaves are laid out
in blocks of about ``BLOCK_ROWS`` rows (a leaf larger than that is dealt over
several).  A query walks the tree with a priority queue, nearest bin first, and
visits as many leaves as the calibration found necessary: the visits are
widened until ``recall`` of the true neighbours of ``CALIBRATION`` queries,
found by comparing these with all rows, lie in visited leaves.  Blocks then meet the
queries that visit them; a block that very many queries visit is copied, so
that no task holds more than ``BLOCK_QUERIES`` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stored
from postlens.llm.vectors import dots, matrix, with_usable

SAMPLE = 16_384
BRANCH = 8
LEAF_ROWS = 256
BLOCK_ROWS = 1024
BLOCK_QUERIES = 8192
CALIBRATION = 128

FOUND = "query_id long, ids array<long>, scores array<double>"


class Tree:
    """Nodes as arrays: a node's children are a contiguous range; leaves count from 0 in depth-first order."""

    def __init__(self, x: np.ndarray, leaf_size: float, branch: int, seed: int = 5):
        self.rng, self.branch = np.random.default_rng(seed), branch
        self.centers: list[np.ndarray] = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.leaf_of: list[int] = [-1]
        self._grow(0, x, max(leaf_size, 1))
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            lo, hi = self.children[node]
            if lo == hi:
                order.append(node)
            stack.extend(range(hi - 1, lo - 1, -1))
        for leaf, node in enumerate(order):
            self.leaf_of[node] = leaf
        self.leaves = len(order)
        self.centers = np.array(self.centers)
        del self.rng

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centers = x[self.rng.choice(len(x), self.branch, replace=False)]
        for _ in range(8):
            of = np.argmin((centers ** 2).sum(1) - 2 * x @ centers.T, axis=1)
            for k in range(self.branch):
                if (of == k).any():
                    centers[k] = x[of == k].mean(axis=0)
        return centers, np.argmin((centers ** 2).sum(1) - 2 * x @ centers.T, axis=1)

    def _grow(self, node: int, x: np.ndarray, leaf_size: float) -> None:
        todo = [(node, x)]
        while todo:
            node, x = todo.pop()
            if len(x) <= leaf_size or len(x) <= self.branch or (x == x[0]).all():
                continue
            centers, of = self._split(x)
            used = [k for k in range(self.branch) if (of == k).any()]
            if len(used) < 2:
                continue
            lo = len(self.centers)
            self.children[node] = (lo, lo + len(used))
            for k in used:
                self.centers.append(centers[k])
                self.children.append((0, 0))
                self.leaf_of.append(-1)
            todo += [(lo + i, x[of == k]) for i, k in enumerate(used)]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child, level by level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            lo, hi = self.children[node]
            if lo == hi:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centers[lo:hi]
            of = np.argmin((c ** 2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(lo + k, rows[of == k]) for k in range(hi - lo) if (of == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that a best-bin-first walk from ``q`` reaches."""
        near = (self.centers ** 2).sum(1) - 2 * self.centers @ q
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            lo, hi = self.children[node]
            while lo < hi:  # go down to the nearest child, keep the others for later
                best = lo + int(np.argmin(near[lo:hi]))
                for k in range(lo, hi):
                    if k != best:
                        heapq.heappush(queue, (float(near[k]), k))
                node = best
                lo, hi = self.children[node]
            out.append(self.leaf_of[node])
        return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - dots(x, x), 0))[:, None]])


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best rows for each query, its own row left out; ties to the smaller id.

    A fast product picks candidates a little below the k-th best; these are then
    summed in one fixed order, so equal vectors have equal scores.
    """
    rough = q @ x.T
    for i, own in enumerate(q_ids):
        s = rough[i].copy()
        s[ids == own] = -np.inf
        kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        least = kth - 1e-9 * max(1.0, abs(kth)) if kth > -np.inf else -np.inf
        at = np.flatnonzero((s >= least) & (s > -np.inf))
        exact = dots(x[at], q[i][None, :])
        order = np.lexsort((ids[at], -exact))[:k]
        yield int(own), ids[at][order], exact[order]


def _frame(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    found = list(found)
    return pd.DataFrame({"query_id": [f[0] for f in found], "ids": [f[1] for f in found], "scores": [f[2] for f in found]})


def _merge(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(rows["ids"].to_list()), np.concatenate(rows["scores"].to_list())
        order = np.lexsort((ids, -scores))[:k]
        return pd.DataFrame({"query_id": int(key[0]), "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": ids[order], "score": scores[order]})

    return run


RANKED = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows found: query_id, rank (from 1), vec_id, score.

    Nearness is the largest inner product, in double precision; ties go to the
    smaller id; the row with the query's own id is no candidate.  Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor
    do null ids.  Each dimension is searched among its own rows (an id asked with several:
    the commonest of them in ``rows``).  Repeated rows of
    ``queries`` count once; of ``rows`` once, too.  Fewer than ``k`` candidates: all.  Empty
    tables give none.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id is not null")
    base = with_usable(base, "vec")
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asked = with_usable(asked.filter("vec_id is not null"), "vec")
    wanted = {r["dim"] for r in asked.select("dim").distinct().collect()}
    dims = [r["dim"] for r in base.groupBy("dim").count().orderBy(F.desc("count"), "dim").collect() if r["dim"] in wanted]
    out = spark.createDataFrame([], RANKED)
    for i, dim in enumerate(dims):
        some = asked.filter(F.col("dim") == dim)
        if i:
            some = some.join(asked.filter(F.col("dim").isin(dims[:i])).select("vec_id"), "vec_id", "left_anti")
        found = _nearest(base.filter(F.col("dim") == dim).drop("dim"), some.select("vec_id", "vec").dropDuplicates(["vec_id"]), dim, k, recall)
        out = out.union(found) if i else found
    return out


def _nearest(base: DataFrame, asked: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    """``nearest`` among usable (vec_id, vec) of one dimension."""
    spark = base.sparkSession
    total, top = base.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).first()
    if not total:
        return spark.createDataFrame([], RANKED)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    tree = Tree(_lift(matrix(sample["vec"], dim), top), LEAF_ROWS * len(sample) / total, BRANCH)
    shared = spark.sparkContext.broadcast(tree)  # at most about 2 * SAMPLE centres, whatever the table's size

    def index(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.leaf(_lift(matrix(b["vec"], dim), top)))

    indexed = stored(base.mapInPandas(index, "vec_id long, vec array<double>, leaf long"), "leaves")

    # ---- calibration: all rows against a fixed number of queries
    probe = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toPandas()
    p_ids, p_vecs = probe["vec_id"].to_numpy(np.int64), matrix(probe["vec"], dim)

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame(_best(p_ids, p_vecs, b["vec_id"].to_numpy(np.int64), matrix(b["vec"], dim), k))

    true = (indexed.mapInPandas(scan, FOUND).groupBy("query_id").applyInPandas(_merge(k), RANKED)
            .join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect())  # CALIBRATION * k rows
    place = {int(q): {leaf: i for i, leaf in enumerate(tree.visits(np.append(v, 0.0), tree.leaves))} for q, v in zip(p_ids, p_vecs)}
    needed = np.sort([place[r["query_id"]][r["leaf"]] + 1 for r in true])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1

    # ---- blocks: leaves side by side; a large leaf over several blocks
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf, at most SAMPLE
        sizes[r["leaf"]] = r["count"]
    first, dealt, fill, block = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if fill and fill + n > BLOCK_ROWS:
            block, fill = block + 1, 0
        first[leaf], dealt[leaf] = block, max(1, -(-n // BLOCK_ROWS))
        fill += n
        if dealt[leaf] > 1:
            block, fill = block + dealt[leaf], 0

    def lay(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = b["leaf"].to_numpy()
            yield b.assign(block=first[leaf] + b["vec_id"].to_numpy() % dealt[leaf]).drop(columns="leaf")

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.iloc[lo:lo + 256]
                out = []
                for v in some["vec"]:
                    leaves = shared.value.visits(np.append(np.asarray(v, float), 0.0), visits)
                    out.append(sorted({int(first[x] + j) for x in leaves for j in range(dealt[x])}))
                yield some.assign(block=out).explode("block").astype({"block": "int64"})

    laid = indexed.mapInPandas(lay, "vec_id long, vec array<double>, block long")
    walked = stored(asked.mapInPandas(walk, "vec_id long, vec array<double>, block long"), "visits")
    copies = walked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("copies"))
    left = laid.join(copies, "block").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = walked.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("vec_id"), "copies").cast("int"))

    def search(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        x = x.drop_duplicates("vec_id")
        vecs, ids = matrix(x["vec"], dim), x["vec_id"].to_numpy(np.int64)
        found: list = []
        for lo in range(0, len(q), 1024):
            some = q.iloc[lo:lo + 1024]
            found += _best(some["vec_id"].to_numpy(np.int64), matrix(some["vec"], dim), ids, vecs, k)
        return _frame(found)

    keys = ("block", "copy")
    found = (left.select(*keys, "vec_id", "vec").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vec").groupBy(*keys))
             .applyInPandas(search, FOUND))
    return found.groupBy("query_id").applyInPandas(_merge(k), RANKED)

