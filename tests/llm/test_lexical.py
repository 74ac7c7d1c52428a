"""Ranked lexical search against plain Python, and what skipping may not lose."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from postlens.llm import lexical
from corpus_fixtures import documents  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [] if text is None else TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, k):
    docs = [(i, split(t)) for i, t in docs if i is not None]
    docs = [(i, t) for i, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    rows = []
    for i, words in asked.items():
        scores = []
        for d, t in docs:
            tf, m = Counter(t), 50 + (50 * len(t) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if s > 0:
                scores.append((-s, d))
        rows += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows)


def run(docs, items, k):
    return sorted(tuple(r) for r in lexical.search(docs, items, k=k).collect())


@pytest.fixture()
def small(monkeypatch):
    """Windows of four documents, and nearly every list a long one."""
    monkeypatch.setattr(lexical, "WINDOW", 4)


def corpus(seed, n, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.expovariate(0.08))}" for _ in range(words)] + ["Éa", "éa", "日本", "x9", "A_b", "it's"]
    rows = [(rnd.randint(0, n), " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 30, 200])))) for _ in range(n)]
    items = [(i, " ".join(rnd.sample(vocabulary, rnd.randint(1, 12)))) for i in range(25)]
    return rows, items


@pytest.mark.parametrize("seed,n,k", [(1, 400, 7), (2, 60, 50), (3, 900, 3)])
def test_equals_plain_python(spark, documents, seed, n, k):
    rows, items = corpus(seed, n)
    got = run(documents(rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got == brute(rows, items, k)


def test_nulls_empties_ties_repeats_and_clashing_names(spark, documents):
    rows = [(1, "a b"), (1, "a b"), (2, "b A"), (3, None), (4, ""), (5, "..."), (None, "a a a"), (6, "c " * 30000 + "a"), (7, "zz")]
    items = [(1, "a"), (1, "b"), (2, None), (3, "!!"), (None, "a"), (4, "nowhere"), (5, "ZZ zz")]
    docs = documents(rows, rank=3, score="x", item_id=9, salt=1, term="t")
    asked = spark.createDataFrame([(i, t, 1, "d") for i, t in items], "item_id long, text string, score int, doc_id string")
    got = run(docs.repartition(2), asked, 3)
    assert got == brute(rows, items, 3)
    assert [r[2] for r in got if r[0] == 1] == [1, 1, 2]  # equal scores by id, repeated rows one each


def test_empty_tables(spark, documents):
    docs, items = documents([(1, "a")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert run(docs.limit(0), items, 5) == run(docs, items.limit(0), 5) == []
    assert lexical.search(docs, items.limit(0)).columns == lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def shard_of(rows, items):
    """One shard and its items, as a task sees them."""
    import numpy as np
    import pyarrow as pa

    from postlens.llm.common import ROW_BITS, doc_of, pack, pack_sorted

    codes, n, distinct = lexical.terms(pa.array([t for _, t in rows]))
    keys, times = np.unique((codes.astype(np.int64) << ROW_BITS) | doc_of(n), return_counts=True)
    heads, sizes = np.unique(keys >> ROW_BITS, return_counts=True)
    row = {"n_docs": len(rows), "ids": pack(np.array([i for i, _ in rows], np.int64)), "lengths": pack(n), "n_lists": len(heads),
           "terms": pack_sorted(heads.astype(np.uint64)), "sizes": pack(sizes.astype(np.int32)), "n_postings": len(keys),
           "docs": pack((keys & ((1 << ROW_BITS) - 1)).astype(np.int32)), "times": pack(times.astype(np.int32))}
    names = {w: i for i, w in enumerate(distinct.to_pylist())}
    filled = int((n > 0).sum())
    weights = np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * int(s) + 1))) for s in sizes], np.int64)
    wanted = [sorted({names[w] for w in split(t) if w in names}) for _, t in items]
    return row, weights, filled, int(n.sum()), wanted


def test_windows_are_skipped_without_loss(small):
    rnd = random.Random(5)
    rows = [(i, " ".join(["common"] * rnd.randint(1, 3) + (["rare", "rare"] if i % 97 == 0 else []) + ["pad"] * 20)) for i in range(1000)]
    items = [(0, "common rare")]
    row, weights, filled, length, wanted = shard_of(rows, items)
    shard = lexical.Shard(row, weights, filled, length)
    seen = []
    window = shard._window
    shard._window = lambda w, *rest: (seen.append(w), window(w, *rest))
    best = lexical.Best(5)
    shard.search(wanted[0], best)
    assert [(0, r, int(d), int(s)) for r, (d, s) in enumerate(zip(best.ids, best.scores), 1)] == brute(rows, items, 5)
    assert len(seen) < shard.windows / 10  # only windows that hold the rare term


def test_short_lists_are_summed_first(small, monkeypatch):
    monkeypatch.setattr(lexical, "SHORT", 4)
    rows, items = corpus(9, 300)
    row, weights, filled, length, wanted = shard_of(rows, items)
    shard = lexical.Shard(row, weights, filled, length)
    kinds = [(len(shard.lists[t][0]) <= shard.long) for own in wanted for t in own]
    assert any(kinds) and not all(kinds)  # both ways take part
    got = []
    for (i, _), own in zip(items, wanted):
        best = lexical.Best(6)
        shard.search(own, best)
        got += [(i, r, int(d), int(s)) for r, (d, s) in enumerate(zip(best.ids, best.scores), 1)]
    assert got == brute(rows, items, 6)
