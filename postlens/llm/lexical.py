"""Ranked lexical search: every item's best documents, by hybrid TAAT and DAAT.

The items are a query set; all documents are compared with each of them.
1. Index: each chunk of documents becomes one index shard, a row of packed
   arrays: its documents, their lengths and, for each term of the items, the
   list of (document, occurrences).  A task reads the texts once.
2. Statistics: document frequencies and lengths are summed over the shards.
   The driver gets one number per distinct term of the items, no more.
3. Search, shard by shard: a term's list is *short* in a shard if it holds at
   most one document in ``SHORT``.  An item's short lists are added up term at
   a time into one accumulator.  From there on the accumulator is one iterator
   among the item's long lists, bounded by its largest value in each window of
   ``WINDOW`` documents, as each long list is by its largest gain there.
   Windows are taken in document order.  A window whose bounds cannot reach the
   item's k-th best score so far is skipped, and within a window a document is
   dropped as soon as its score and the bounds of the lists not yet looked into
   cannot reach it.  Skipping loses nothing: a document with just that score
   stays in (it may have the smaller id).  A task carries the k-th best score
   from one shard to the next.
4. Every task gives its k best per item; two ranking steps (by a salt, then by
   the item) give the k best of all, so that no task ranks what all tasks found.

Items are taken in blocks of at most ``ITEM_BYTES`` of text, the bound of what
is sent to every task.

A term is a maximal run of ASCII letters and digits and of all other characters
beyond ASCII; only A-Z are lower-cased.  Weights and scores are as in BM25 but
whole numbers: see ``search``.

Defined results: null and empty texts hold no term, count for nothing and are
never found.  Rows with a null id are left out, documents and items alike.
Repeated documents are documents each.  Rows of one item id are one item: their
terms are put together.  Items without terms, an empty table of either kind,
and items of which no document holds a term give no rows.  Extra columns, of
any name, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import ROW_BITS, chunks, doc_of, doc_texts, pack, pack_sorted, stored, unpack, unpack_sorted, whole

ITEM_BYTES = 32 << 20
SHORT = 16
WINDOW = 256
SALTS = 64

SHARD = ("n_docs int, n_filled long, n_terms long, ids binary, lengths binary, n_lists int, terms binary, sizes binary, "
         "n_postings int, docs binary, times binary")

# ASCII other than letters and digits separates terms; A-Z become a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = [ord(chr(i).lower()) if chr(i).isalnum() else 0x20 for i in range(0x80)]


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all terms in order, the number of terms of each text, and the distinct terms."""
    texts = whole(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(offsets[-1]))
    folded = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(_FOLD[data]))
    parts = pc.ascii_split_whitespace(folded)
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    coded = flat.filter(keep).dictionary_encode()
    return coded.indices.to_numpy(), np.diff(sums[parts.offsets.to_numpy()]).astype(np.int64), coded.dictionary


# ---------------------------------------------------------------- index

def _shards(vocabulary: pa.Array):
    names = [c.split()[0] for c in SHARD.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SHARD.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in chunks(batches):
            codes, n, distinct = terms(rows.column("text"))
            number = pc.index_in(distinct, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = number[codes] if len(distinct) else np.zeros(0, np.int64)
            asked = of >= 0
            keys, times = np.unique((of[asked] << ROW_BITS) | doc_of(n)[asked], return_counts=True)
            heads, sizes = np.unique(keys >> ROW_BITS, return_counts=True)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            values = [len(n), int((n > 0).sum()), int(n.sum()), pack(ids), pack(n), len(heads), pack_sorted(heads.astype(np.uint64)),
                      pack(sizes.astype(np.int32)), len(keys), pack((keys & ((1 << ROW_BITS) - 1)).astype(np.int32)), pack(times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    return run


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies; term -1: documents with a term, -2: all terms."""
    sums: dict[int, int] = {-1: 0, -2: 0}
    for b in batches:
        for r in b.to_pylist():
            sums[-1] += r["n_filled"]
            sums[-2] += r["n_terms"]
            for t, s in zip(unpack_sorted(r["terms"], r["n_lists"]).tolist(), unpack(r["sizes"], r["n_lists"], np.int32).tolist()):
                sums[t] = sums.get(t, 0) + s
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])


# ---------------------------------------------------------------- search

class Best:
    """An item's k best documents so far: highest scores, then smallest ids."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


class Shard:
    """A shard's lists with the gains of their postings and their bounds by window."""

    def __init__(self, row: dict, weights: np.ndarray, filled: int, length: int):
        self.n = row["n_docs"]
        self.ids = unpack(row["ids"], self.n, np.int64)
        lengths = unpack(row["lengths"], self.n, np.int64)
        heads = unpack_sorted(row["terms"], row["n_lists"]).astype(np.int64)
        sizes = unpack(row["sizes"], row["n_lists"], np.int32)
        docs = unpack(row["docs"], row["n_postings"], np.int32)
        times = unpack(row["times"], row["n_postings"], np.int32).astype(np.int64)
        norm = 50 + (50 * lengths * filled) // max(length, 1)
        gains = np.repeat(weights[heads], sizes) * ((1_000_000_000 * times) // (1000 * times + 20 * norm[docs]))
        ends = np.cumsum(sizes)
        self.lists = {t: (docs[e - s : e], gains[e - s : e]) for t, e, s in zip(heads.tolist(), ends.tolist(), sizes.tolist())}
        self.windows = -(-self.n // WINDOW)
        self.long = max(1, self.n // SHORT)
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, term: int) -> np.ndarray:
        """The largest gain of a list in each window."""
        if term not in self.bounds:
            docs, gains = self.lists[term]
            self.bounds[term] = np.zeros(self.windows, np.int64)
            np.maximum.at(self.bounds[term], docs // WINDOW, gains)
        return self.bounds[term]

    def search(self, wanted: list[int], best: Best) -> None:
        own = [t for t in wanted if t in self.lists]
        longs = [t for t in own if len(self.lists[t][0]) > self.long]
        sums = np.zeros(self.windows * WINDOW, np.int64)
        for t in own:  # term at a time
            if len(self.lists[t][0]) <= self.long:
                docs, gains = self.lists[t]
                sums[docs] += gains
        tops = sums.reshape(self.windows, WINDOW).max(axis=1)
        longs.sort(key=lambda t: -int(self.bound(t).max()))
        most = tops + sum((self.bound(t) for t in longs), np.zeros(self.windows, np.int64))
        if np.count_nonzero(sums) >= best.k:  # sums are scores, or less
            best.floor = max(best.floor, int(np.partition(sums, -best.k)[-best.k]))
        for w in np.flatnonzero(most >= best.floor).tolist():  # document at a time
            if most[w] >= best.floor:
                self._window(w, sums, longs, int(most[w] - tops[w]), best)

    def _window(self, w: int, sums: np.ndarray, longs: list[int], rest: int, best: Best) -> None:
        lo = w * WINDOW
        score = sums[lo : lo + WINDOW].copy()
        docs = np.flatnonzero(score + rest >= best.floor)
        score = score[docs]
        for t in longs:
            bound = int(self.bound(t)[w])
            if not bound:
                continue
            rest -= bound
            there, gains = self.lists[t]
            a, z = np.searchsorted(there, (lo, lo + WINDOW))
            at = np.searchsorted(there[a:z], docs + lo)
            at[at == z - a] = 0
            hit = there[a:z][at] == docs + lo
            score[hit] += gains[a:z][at[hit]]
            alive = score + rest >= best.floor
            if not alive.all():
                docs, score = docs[alive], score[alive]
                if not len(docs):
                    return
        keep = score >= best.floor
        if keep.any():
            best.add(self.ids[docs[keep] + lo], score[keep])


def _search(items: list[tuple[int, list[int]]], weights: np.ndarray, filled: int, length: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in items]
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row, weights, filled, length)
                for (_, wanted), best in zip(items, found):
                    shard.search(wanted, best)
        item = np.repeat(np.array([i for i, _ in items], np.int64), [len(f.ids) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([f.ids for f in found])),
                                          pa.array(np.concatenate([f.scores for f in found]))], ["item_id", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """The search for one block of items, whose texts the driver holds."""
    codes, n, vocabulary = terms(pa.array([r.text for r in rows], pa.string()))
    wanted: dict[int, set[int]] = {}
    for r, own in zip(rows, np.split(codes, np.cumsum(n)[:-1])):
        wanted.setdefault(r.doc_id, set()).update(own.tolist())
    items = [(i, sorted(ts)) for i, ts in sorted(wanted.items()) if ts]
    if not items:
        return None
    shards = stored(docs.mapInArrow(_shards(vocabulary), SHARD), "lexical-shards")
    counts = shards.select("n_filled", "n_terms", "n_lists", "terms", "sizes").mapInArrow(_counts, "term long, n long")
    totals = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a number per term of the block
    filled = totals.get(-1, 0)
    weights = np.array([math.floor(1000.0 * math.log((2 * filled + 2) / (2 * totals.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    found = shards.mapInArrow(_search(items, weights, filled, totals.get(-2, 0), k), "item_id long, doc_id long, score long")
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0.

    N documents hold a term, L terms in all; a document holds n of them; df
    documents hold a term, which occurs tf times in one.  The term's weight w is
    floor(1000 ln((2N + 2) / (2df + 1))); m = 50 + (50 n N) div L.  A score sums
    w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.  Equal
    scores are ranked by ascending document id.
    """
    texts = doc_texts(docs, id_col, text_col).filter("doc_id is not null")
    asked = doc_texts(items, item_col, item_text_col).filter("doc_id is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).collect()  # ITEM_BYTES on average
        part = _block(texts, rows, k)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _best(_best(found, k, "item_id", "salt"), k, "item_id").select("item_id", "rank", "doc_id", "score")
