"""Katz backoff scoring with Good-Turing discounts, counted and evaluated at scale.

1. Documents become chunks of word codes (``common.words``), written once.
2. Every chunk sends its distinct n-grams of each order, as sorted 64-bit
   hashes with training counts, to hash ranges ("buckets").  A bucket adds the
   counts and answers each chunk in its own key order; one chunk per n-gram is
   told that it *owns* it.  The answers are the stored, partitioned tables.
3. Discounts come from the counts of counts of each order.
4. Each chunk meets its answers and evaluates every token recursively: an
   n-gram seen in training gets its discounted share; otherwise the context's
   backoff weight times the value of the next shorter one.  Owners also emit,
   per context, the mass of its seen words at both orders.
5. Backoff weights are those sums grouped by context, exactly normalised:
   (1 - seen mass) / (1 - mass of the same words one order lower).  Only tokens
   that do back off are joined with them.

An n-gram that is everywhere costs one entry per chunk, a context one row per
chunk: nothing is hot, and no task holds more than a chunk or a bucket.
N-grams are told apart by 64-bit hashes; with 10^9 distinct ones the chance of
any two being mixed up is 3 %.

Discounts: for counts r up to 5, Katz's renormalised Turing estimate
``(r*/r - q) / (1 - q)``, ``q = 6 N6 / N1``, where it lies in (0, 1); for all
others ``(1 + 1/r) ** (slope + 1)`` with the slope of log N_r over log r, at
most -1.1.  So every discount is under 1 and every context keeps some mass
for unseen words; there is no context without a backoff weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import (ROW_BITS, bucket_bits, bucket_edges, chunks, doc_of, doc_texts, mix, pack, pack_sorted,
                                 stored, unpack, unpack_sorted, word_hashes, words)

SLICE_BYTES = 4 << 20  # of text in a chunk: what a task's evaluation holds
TURING_CUT = 5
START = np.uint64(0x9E3779B97F4A7C15)  # context of a text's first token
END = np.uint64(0xD1B54A32D192ED03)
STEP = np.uint64(0xA0761D6478BD642F)

CHUNKS = ("p long, n_docs int, n_words int, n_train long, doc_ids binary, train binary, sizes binary, codes binary, "
          "n_codes int, hashes binary")
KEYS = "p long, level int, b int, n int, keys binary, counts binary"
ANSWERS = "p long, level int, b int, n int, counts binary, owned binary, hist array<struct<r:long,n:long>>"
PARTS = ("kind int, level int, key long, rk long, doc_id long, held_out boolean, n_tokens long, n_known long, "
         "base_score double, a double, b double")


# ---------------------------------------------------------------- n-grams of a chunk

def _chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, b in chunks(batches, SLICE_BYTES):
        codes, sizes, dictionary = words(b.column(1))
        hashes, place = np.unique(word_hashes(dictionary), return_inverse=True)
        codes = place[codes].astype(np.uint32) if len(codes) else codes.astype(np.uint32)
        ids = b.column(0)
        train = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        blobs = {"doc_ids": known.tobytes() + number.tobytes(), "train": train.tobytes(), "sizes": pack(sizes),
                 "codes": pack(codes), "hashes": pack_sorted(hashes)}
        row = {"p": pa.array([p], pa.int64()), "n_docs": pa.array([b.num_rows], pa.int32()),
               "n_words": pa.array([len(hashes)], pa.int32()), "n_train": pa.array([int(train.sum())], pa.int64()),
               "n_codes": pa.array([len(codes)], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in blobs.items()}}
        yield pa.RecordBatch.from_pydict({name.split()[0]: row[name.split()[0]] for name in CHUNKS.split(", ")})


class Chunk:
    """A chunk's tokens (words and one end per text) and its n-gram keys by order."""

    def __init__(self, row, order: int):
        n = int(row["n_docs"])
        raw = row["doc_ids"]
        self.doc_ids = np.frombuffer(raw[n:], np.int64)
        self.known_id = np.frombuffer(raw[:n], np.uint8).astype(bool)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.p = int(row["p"])
        sizes = unpack(row["sizes"], n, np.int64)
        hashes = unpack_sorted(row["hashes"], int(row["n_words"]))
        codes = unpack(row["codes"], int(row["n_codes"]), np.uint32)
        self.sizes = sizes + 1
        self.doc = doc_of(self.sizes)
        ends = np.cumsum(self.sizes) - 1
        h = np.empty(len(self.doc), np.uint64)
        is_word = np.ones(len(h), bool)
        is_word[ends] = False
        h[is_word] = hashes[codes]
        h[~is_word] = END
        place = np.arange(len(h)) - (ends - self.sizes + 1)[self.doc]  # in its text
        self.keys, self.contexts, self.valid = [mix(h)], [None], [np.ones(len(h), bool)]
        for k in range(2, order + 1):
            before = np.roll(self.keys[-1], 1)
            before[place == 0] = START
            self.contexts.append(before)
            self.valid.append(place >= k - 2)
            self.keys.append(mix(before * STEP + h + np.uint64(k)))

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of an order, and each valid position's place among them."""
        return np.unique(self.keys[level - 1][self.valid[level - 1]], return_inverse=True)


def _send(order: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                chunk = Chunk(row, order)
                for level in range(1, order + 1):
                    keys, place = chunk.distinct(level)
                    counts = np.bincount(place, weights=chunk.train[chunk.doc[chunk.valid[level - 1]]], minlength=len(keys)).astype(np.uint32)
                    edges = bucket_edges(keys, bits)
                    at = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
                    yield pd.DataFrame({"p": chunk.p, "level": level, "b": [i for i, _, _ in at], "n": [hi - lo for _, lo, hi in at],
                                        "keys": [pack_sorted(keys[lo:hi]) for _, lo, hi in at],
                                        "counts": [pack(counts[lo:hi]) for _, lo, hi in at]})

    return run


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: total counts of its keys, answered in each chunk's order."""
    rows = rows.sort_values("p")
    sizes = rows["n"].to_numpy(np.int64)
    keys = np.concatenate([unpack_sorted(k, n) for k, n in zip(rows["keys"], sizes)])
    counts = np.concatenate([unpack(c, n, np.uint32) for c, n in zip(rows["counts"], sizes)])
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.uint64)
    owned = np.zeros(len(keys), np.uint8)
    owned[first] = 1
    answer, cut = total[place], np.cumsum(sizes)[:-1]
    r, n = np.unique(total[total > 0], return_counts=True)
    hist = [{"r": int(x), "n": int(y)} for x, y in zip(r, n)]
    level, b = int(key[0]), int(key[1])
    out = pd.DataFrame({"p": rows["p"].to_numpy(), "level": level, "b": b, "n": sizes,
                        "counts": [pack(x) for x in np.split(answer, cut)],
                        "owned": [pack(x) for x in np.split(owned, cut)], "hist": None})
    last = pd.DataFrame({"p": [-1], "level": [level], "b": [b], "n": [0], "counts": [None], "owned": [None], "hist": [hist]})
    return pd.concat([out, last], ignore_index=True)


# ---------------------------------------------------------------- discounts

class Discount:
    """Good-Turing discount of a count, from the counts of counts of one order."""

    def __init__(self, few: dict[int, int]):
        r = [x for x in sorted(few) if few[x] > 0]
        slope = -1.1
        if len(r) > 1:
            slope = min(slope, float(np.polyfit(np.log(r), np.log([few[x] for x in r]), 1)[0]))
        self.power = slope + 1
        self.small = [math.nan] + [(1 + 1 / x) ** self.power for x in range(1, TURING_CUT + 1)]
        n1, over = few.get(1, 0), few.get(TURING_CUT + 1, 0)
        q = (TURING_CUT + 1) * over / n1 if n1 else 1.0
        for x in range(1, TURING_CUT + 1):
            if few.get(x, 0) and q < 1:
                d = ((x + 1) * few.get(x + 1, 0) / (x * few[x]) - q) / (1 - q)
                if 0 < d < 1:
                    self.small[x] = d

    def of(self, r: np.ndarray) -> np.ndarray:
        r = np.maximum(r.astype(np.float64), 1)
        table = np.array([1.0, *self.small[1:]])
        return np.where(r <= TURING_CUT, table[np.minimum(r, TURING_CUT).astype(np.int64)], (1 + 1 / r) ** self.power)

    def column(self, r: Column) -> Column:
        out = F.pow(1 + 1 / r, F.lit(self.power))
        for x in range(1, TURING_CUT + 1):
            out = F.when(r == x, F.lit(self.small[x])).otherwise(out)
        return out


class Model:
    """What every task needs of the whole corpus: a few numbers, whatever its size."""

    def __init__(self, order: int, answers: DataFrame, train_docs: int):
        self.order, self.train_docs = order, train_docs
        hist = stored(answers.filter("p = -1").select("level", F.explode("hist").alias("h")).groupBy("level", F.col("h.r").alias("r"))
                      .agg(F.sum("h.n").alias("n")), "counts-of-counts")
        few: dict[int, dict[int, int]] = {k: {} for k in range(1, order + 1)}
        for x in hist.filter(F.col("r") <= TURING_CUT + 3).collect():  # at most 8 rows an order
            few[x["level"]][x["r"]] = x["n"]
        self.discounts = [Discount(few[k]) for k in range(1, order + 1)]
        one = hist.filter("level = 1").agg(
            F.sum(F.col("n") * F.col("r")).alias("tokens"), F.sum("n").alias("kinds"),
            F.sum(F.col("n") * F.col("r") * self.discounts[0].column(F.col("r"))).alias("mass")).first()
        self.tokens, self.kinds = one["tokens"] or 0, one["kinds"] or 0
        # With nothing learnt, every token is the unknown one.
        self.unknown = 1 - one["mass"] / self.tokens if self.tokens else 1.0


# ---------------------------------------------------------------- evaluation

def _evaluate(model: Model):
    def run(key: tuple, chunk_rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk_rows):
            return pd.DataFrame()
        chunk = Chunk(chunk_rows.iloc[0], model.order)
        doc, n = chunk.doc, len(chunk.sizes)
        out = []
        value = settled = count_before = None
        for level in range(1, model.order + 1):
            mine = answers[answers["level"] == level].sort_values("b")
            total = np.concatenate([np.zeros(0, np.uint64), *(unpack(c, m, np.uint64) for c, m in zip(mine["counts"], mine["n"]))])
            owned = np.concatenate([np.zeros(0, np.uint8), *(unpack(c, m, np.uint8) for c, m in zip(mine["owned"], mine["n"]))]).astype(bool)
            keys, place = chunk.distinct(level)
            valid = chunk.valid[level - 1]
            count = np.zeros(len(doc), np.uint64)
            count[valid] = total[place]
            seen = count > 0
            d = model.discounts[level - 1].of(count)
            if level == 1:
                value = np.where(seen, d * count / max(model.tokens, 1), model.unknown)
                known = np.bincount(doc, weights=seen, minlength=n)
                base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
                base = np.bincount(doc, weights=base, minlength=n)
                settled = np.log10(value)
            else:
                context = chunk.contexts[level - 1]
                first = np.concatenate([[True], doc[1:] != doc[:-1]])
                of_context = np.roll(count_before, 1)
                of_context[first] = model.train_docs if level == 2 else 0
                own = np.where(seen, d * count / np.maximum(of_context, 1), 0.0)
                # One position for each owned, seen n-gram: its mass at both orders.
                at = np.flatnonzero(valid)
                where = np.zeros(len(keys), np.int64)
                where[place] = at
                where = where[owned & (total > 0)]
                ctx, slot = np.unique(context[where], return_inverse=True)
                out.append(pd.DataFrame({"kind": 1, "level": level, "key": ctx.view(np.int64),
                                         "a": np.bincount(slot, weights=own[where], minlength=len(ctx)),
                                         "b": np.bincount(slot, weights=value[where], minlength=len(ctx))}))
                back = valid & ~seen & (of_context > 0)
                if back.any():
                    pair = pd.DataFrame({"key": context[back].view(np.int64), "rk": doc[back]}).value_counts(sort=False).reset_index(name="a")
                    pair["rk"] = (chunk.p << ROW_BITS) + pair["rk"].astype(np.int64)
                    out.append(pair.assign(kind=2, level=level, a=pair["a"].astype(float)))
                settled = np.where(seen, np.log10(np.where(seen, own, 1.0)), settled)
                # Values without their backoff weights serve only n-grams that are seen.
                value = np.where(seen, own, value)
            count_before = count
        ids = pd.array(chunk.doc_ids, dtype="Int64")
        ids[~chunk.known_id] = pd.NA
        out.append(pd.DataFrame({"kind": 0, "rk": (chunk.p << ROW_BITS) + np.arange(n), "doc_id": ids, "held_out": ~chunk.train,
                                 "n_tokens": chunk.sizes, "n_known": known.astype(np.int64), "base_score": base,
                                 "a": np.bincount(doc, weights=settled, minlength=n)}))
        names = [c.split()[0] for c in PARTS.split(", ")]
        return pd.concat(out, ignore_index=True).reindex(columns=names).astype(
            {"kind": "Int32", "level": "Int32", "key": "Int64", "rk": "Int64", "doc_id": "Int64", "held_out": "boolean", "n_tokens": "Int64", "n_known": "Int64"})

    return run


def katz_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) with a Katz model of ``order``.

    The model learns from rows whose crc32 of doc_id as text is not 0 modulo 10;
    the others are held out.  Tokens are lower-cased (A-Z) runs of characters
    other than ASCII white space, and one end per text.  Returns one row per
    row: doc_id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens (N), base_score (sum of log10 (c + 0.1) / (N + 0.1 (V + 1))),
    score (log10 probability of the text under the model).

    A null text is empty (its end only); a null doc_id is held out; repeated rows
    count as often as they occur; very long texts are scored whole; an empty
    table gives none.  With no training rows every token is unknown.
    ``docs`` should be a stored table: it is read twice.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    texts = doc_texts(docs).select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0).alias("train"))
    bits = bucket_bits(texts)
    table = stored(texts.mapInArrow(_chunk_rows, CHUNKS), "chunks")
    train_docs = table.agg(F.sum("n_train")).first()[0] or 0
    sent = table.mapInPandas(_send(order, bits), KEYS)
    answers = stored(sent.groupBy("level", "b").applyInPandas(_add, ANSWERS), "counts")
    model = Model(order, answers, train_docs)
    mine = answers.filter("p >= 0").select("p", "level", "b", "n", "counts", "owned")
    parts = stored(table.groupBy("p").cogroup(mine.groupBy("p")).applyInPandas(_evaluate(model), PARTS), "parts")
    weights = (parts.filter("kind = 1").groupBy("level", "key").agg(F.sum("a").alias("seen"), F.sum("b").alias("lower"))
               .select("level", "key", F.log10((1 - F.col("seen")) / (1 - F.col("lower"))).alias("w")))
    backed = (parts.filter("kind = 2").select("level", "key", "rk", "a").join(weights, ["level", "key"])
              .groupBy("rk").agg(F.sum(F.col("a") * F.col("w")).alias("w")))
    rows = parts.filter("kind = 0").select("rk", "doc_id", "held_out", "n_tokens", "n_known",
                                           F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "a")
    return rows.join(backed, "rk", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        (F.col("a") + F.coalesce("w", F.lit(0.0))).alias("score"))
