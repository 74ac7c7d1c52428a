"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. A chunk's texts become sets of word n-grams (48-bit hashes).  The chunk sends its
   sorted (n-gram, document) entries to hash ranges; a range finds how many
   documents hold each n-gram and sends back those that at least two hold.
2. The global order of n-grams is (document count, hash): the number
   ``count * 2^48 + hash`` is an n-gram's place in it.  A document in
   which fewer n-grams are shared than the threshold asks for has no partner and
   is done.  Documents with the same set become one class.
3. Classes that can reach the threshold share an n-gram of their prefixes (the
   rarest ones, as many as may be missed); these groups give candidates
   (``candidates.link``), so an n-gram that is everywhere makes no group unless it
   is among the rarest of a document.  Each class has ``PARTS`` bits, one for each part of
   the hash space that holds a shared n-gram; a bit of one class alone is an n-gram
   of it alone, so pairs with too many of these are left out and none that links is.
4. Verification: pivots cut the order into fragments, each class is cut into
   segments, partial overlaps are counted segment by segment and summed per pair,
   and the exact test is ``100 * overlap >= percent * union``.

Two n-grams are taken for one if their 48-bit hashes agree: for two documents of
500 n-grams that is a chance of 10^-9.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.candidates import link
from postlens.llm.common import (CHUNK_BYTES, bucket_bits, bucket_edges, chunks, doc_of, doc_texts, mix, pack, pack_sorted, stored, unpack,
                                 unpack_sorted, word_hashes, words)
from postlens.llm.components import components

KEY_BITS = 48
FRAGMENTS = 4
PARTS = 1024
MARKS = [f"mark_{chr(97 + i)}" for i in range(PARTS // 64)]
TOP = (1 << 15) - 1  # document counts from here on share a place in the order, hash decides
STEP = np.uint64(0xA0761D6478BD642F)

SENT = "p long, b long, n int, keys binary, docs binary"
SENT_ARROW = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
ROWS = "kind int, doc_id long, n long, class long, places array<long>, marks array<long>"


def ngram_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (n-gram, text) entries sorted by n-gram, then text: hashes and text numbers.

    A text with fewer than ``size`` words has one n-gram, all its words; one
    without words has none.
    """
    codes, counts, dictionary = words(texts)
    h = word_hashes(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    doc = doc_of(counts)
    after = ends[doc] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)  # words from here to the text's end
    full = np.flatnonzero(after >= size)
    value = np.full(len(full), size, np.uint64)
    for k in range(size):
        value = value * STEP + h[full + k]
    keys, docs = [mix(value)], [doc[full]]
    for m in range(1, size):
        at = np.flatnonzero(counts == m)
        start = ends[at] - m
        value = np.full(len(at), m, np.uint64)
        for k in range(m):
            value = value * STEP + h[start + k]
        keys.append(mix(value))
        docs.append(at.astype(np.int32))
    key, doc = np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def _send(size: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for p, b in chunks(batches, CHUNK_BYTES // 2):  # its arrays are many times the text
            key, doc = ngram_sets(b.column(1), size)
            n = np.bincount(doc, minlength=b.num_rows).astype(np.int64)
            total, twist = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            np.add.at(total, doc, mix(key + np.uint64(1)))
            np.bitwise_xor.at(twist, doc, mix(key + np.uint64(1 << 60)))
            of_class = mix(mix(total) ^ twist + n.astype(np.uint64))
            ids = b.column(0)
            head = [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                    ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]
            edges = bucket_edges(key, bits, KEY_BITS)
            at = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
            yield pd.DataFrame({"p": p, "b": [i for i, _, _ in at] + [-1 - p], "n": [hi - lo for _, lo, hi in at] + [b.num_rows],
                                "keys": [pack_sorted(key[lo:hi]) for _, lo, hi in at] + [b"".join(head)],
                                "docs": [pack(doc[lo:hi]) for _, lo, hi in at] + [n.tobytes() + of_class.tobytes()]})

    return lambda batches: (pa.RecordBatch.from_pandas(x, preserve_index=False, schema=SENT_ARROW) for x in run(batches))


def _share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One hash range: the entries of n-grams that two documents or more hold, by chunk, as places in the order."""
    if int(key[0]) < 0:  # a chunk's documents pass through
        return rows
    rows = rows.sort_values("p")
    sizes = rows["n"].to_numpy(np.int64)
    keys = np.concatenate([unpack_sorted(k, n) for k, n in zip(rows["keys"], sizes)])
    docs = np.concatenate([unpack(d, n, np.int32) for d, n in zip(rows["docs"], sizes)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(keys, kind="stable")
    run = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    count = np.zeros(len(keys), np.int64)
    count[order] = np.repeat(np.diff(run, append=len(keys)), np.diff(run, append=len(keys)))
    keep = count >= 2
    place = (np.minimum(count, TOP) << KEY_BITS) | keys.astype(np.int64)
    out = []
    for i, p in enumerate(rows["p"]):
        at = begin[i] + np.flatnonzero(keep[begin[i]:begin[i + 1]])
        if len(at):
            out.append((p, int(key[0]), len(at), pack(place[at]), pack(docs[at])))
    return pd.DataFrame(out, columns=["p", "b", "n", "keys", "docs"])


def marks_of(place: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The bits of each row's places, 64 a column."""
    bit = mix(place.astype(np.uint64)) >> np.uint64(64 - PARTS.bit_length() + 1)
    out = np.zeros((rows, PARTS // 64), np.uint64)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def likely(percent: int) -> str:
    """SQL for ``link``: the common n-grams are at most the shared ones without a bit of their own."""
    own, other = (" - ".join(f"bit_count({c}{x} & ~{c}{y})" for c in MARKS) for x, y in (("", "2"), ("2", "")))
    common = f"least(shared - {own}, shared2 - {other})"
    return f"100 * {common} >= {percent} * (n + n2 - {common})"


def _settle(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One chunk: its documents, and the places of those that can have a partner."""
        rows = rows.sort_values("b")
        info, shared = rows[rows["b"] < 0].iloc[0], rows[rows["b"] >= 0]
        m = int(info["n"])
        known, ids = np.frombuffer(info["keys"][:m], np.uint8).astype(bool), np.frombuffer(info["keys"][m:], np.int64)
        n, of_class = np.frombuffer(info["docs"][:8 * m], np.int64), np.frombuffer(info["docs"][8 * m:], np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(unpack(k, c, np.int64) for k, c in zip(shared["keys"], shared["n"]))])
        doc = np.concatenate([np.zeros(0, np.int32), *(unpack(d, c, np.int32) for d, c in zip(shared["docs"], shared["n"]))])
        order = np.lexsort((place, doc))
        place, ends = place[order], np.cumsum(np.bincount(doc, minlength=m))
        have = np.diff(ends, prepend=0)
        alive = np.flatnonzero((n > 0) & (100 * have >= percent * n))
        alive = alive[np.unique(of_class[alive], return_index=True)[1]]  # each class once
        ids = pd.array(ids, dtype="Int64")
        ids[~known] = pd.NA
        docs = pd.DataFrame({"kind": 0, "doc_id": ids, "n": n, "class": of_class, "places": None, "marks": None})
        own = [place[ends[i] - have[i]:ends[i]] for i in alive]
        marks = marks_of(np.concatenate([place[:0], *own]), np.repeat(np.arange(len(alive)), have[alive]), len(alive))
        sets = pd.DataFrame({"kind": 1, "doc_id": pd.array([pd.NA] * len(alive), dtype="Int64"), "n": n[alive], "class": of_class[alive],
                             "places": own, "marks": list(marks)})
        return pd.concat([docs, sets], ignore_index=True) if len(sets) else docs

    return run


def _between(places, lo: int | None, hi: int | None):
    if lo is not None:
        places = F.filter(places, lambda x: x > F.lit(lo))
    return places if hi is None else F.filter(places, lambda x: x <= F.lit(hi))


def _verifier(sets: DataFrame, percent: int):
    """A function from pairs of classes to the pairs that meet the threshold."""
    some = sets.filter(F.pmod(F.xxhash64("class"), F.lit(16)) == 0).select(F.explode("places").alias("x"))
    cuts = some.agg(F.percentile_approx("x", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    edges = [None, *cuts, None]  # any pivots are right; these make segments of like size
    pieces = [_between(F.col("places"), lo, hi) for lo, hi in zip(edges[:-1], edges[1:])]
    segments = sets.select("class", "n", F.posexplode(F.array(*pieces)).alias("fragment", "part"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = segments.select(F.col("class").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa"))
        right = segments.select(F.col("class").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb"))
        small = sets.select("class", "n")
        fit = (pairs.join(small.withColumnsRenamed({"class": "a", "n": "na"}), "a").join(small.withColumnsRenamed({"class": "b", "n": "nb"}), "b")
               .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"))
        partial = (fit.join(left, "a").join(right, ["b", "fragment"])
                   .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("overlap")))
        whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
        return whole.filter(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b")

    return verify


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs other than ASCII white space; a
    document's set has its distinct ``size``-word shingles, with fewer words the
    whole sequence as one.  Documents link when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id reachable by links,
    itself included.  Null texts and texts without words are empty sets (0) that link with
    nothing; a null doc_id takes part, but names no component unless all of it is
    null; repeated rows and rows with one doc_id are documents like others; other
    columns are ignored; an empty table gives none.  Whole texts, however long.
    """
    texts = doc_texts(docs)
    sent = texts.mapInArrow(_send(size, bucket_bits(texts)), SENT)
    shared = sent.groupBy("b").applyInPandas(_share, SENT)
    table = stored(shared.groupBy("p").applyInPandas(_settle(percent), ROWS), "sets")
    rows = table.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "class")
    sets = stored(table.filter("kind = 1").select("class", "n", "places", "marks").dropDuplicates(["class"]), "classes")
    # Unshared n-grams come first in the order and are the first to be missed.
    prefix = F.slice("places", F.lit(1), F.greatest(F.size("places") - _ceil_percent(percent) + 1, F.lit(1)).cast("int"))
    groups = sets.select(F.explode(prefix).alias("key"), F.col("class").alias("id"), "n", F.size("places").alias("shared"),
                         (F.col("n") - F.size("places")).cast("double").alias("cost"))
    # Two sets have no more in common than either shares with anybody.
    possible = f"100 * least(shared, shared2) >= {percent} * (n + n2 - least(shared, shared2))"
    marks = sets.select(F.col("class").alias("id"), *[F.col("marks")[i].alias(c) for i, c in enumerate(MARKS)])
    roots = components(link(groups, _verifier(sets, percent), possible, marks, likely(percent))).withColumnsRenamed({"node": "class", "component": "root"})
    placed = rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Copies may be very many rows of one class: their minimum is an aggregate, the join back a skewed join.
    least = placed.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _ceil_percent(percent: int):
    """ceil(n * percent / 100) in whole numbers."""
    return F.floor((F.col("n") * percent + 99) / 100)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row with the smallest doc_id.

    Rows that agree in doc_id and text are one; rows with a null doc_id and
    empty ones stay.  The columns are those of ``docs``.
    """
    kept = ngram_components(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))
