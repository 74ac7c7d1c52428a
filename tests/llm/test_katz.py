"""Katz scores against a model written out in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from postlens.llm.katz import Discount, katz_scores
from corpus_fixtures import documents  # noqa: F401


def brute(rows, order):
    texts = [(t or "") for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    toks = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), "END"] for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    for ts, tr in zip(toks, train):
        for k in range(1, order + 1) if tr else ():
            seq = ["BOS", *ts] if k > 1 else ts
            counts[k].update(tuple(seq[i:i + k]) for i in range(len(seq) - k + 1))
    few = [None] + [Discount({r: n for r, n in Counter(c.values()).items() if r <= 8}) for c in counts[1:]]
    import numpy as np

    d = [None] + [{r: float(f.of(np.array([r]))[0]) for r in set(c.values())} for f, c in zip(few[1:], counts[1:])]
    total, docs = sum(counts[1].values()), sum(train)
    of = lambda h: docs if h == ("BOS",) else counts[len(h)][h]
    unknown = 1 - sum(d[1][c] * c for c in counts[1].values()) / total if total else 1.0

    def seen(gram):
        k = len(gram)
        c = counts[k][gram]
        return d[k][c] * c / (total if k == 1 else of(gram[:-1]))

    mass, lower = defaultdict(float), defaultdict(float)
    for k in range(2, order + 1):
        for gram in counts[k]:
            mass[gram[:-1]] += seen(gram)
            lower[gram[:-1]] += seen(gram[1:])

    def p(gram):
        if counts[len(gram)][gram]:
            return seen(gram)
        if len(gram) == 1:
            return unknown
        h = gram[:-1]
        return p(gram[1:]) * ((1 - mass[h]) / (1 - lower[h]) if of(h) else 1)

    out = []
    for (i, _), ts, tr in zip(rows, toks, train):
        seq = ["BOS", *ts]
        score = sum(math.log10(p(tuple(seq[max(0 if order > 1 else j, j - order + 1):j + 1]))) for j in range(1, len(seq)))
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (len(counts[1]) + 1))) for w in ts)
        out.append((i, not tr, len(ts), sum(counts[1][(w,)] > 0 for w in ts), total, base, score))
    return out, (p, counts)


ROWS = ([(i, "the cat sat on the mat. " * (1 + i % 3) + f"Word{i % 7} and W{i}") for i in range(60)]
        + [(100, None), (101, ""), (None, "the cat sat"), (1, "the cat sat on the mat. the cat sat on the mat. Word1 and W1"), (102, "ÉtÉ THE\x0bcat x"),
           (103, "mat the cat " * 300), (105, "unheard of things"), (109, "the the the")])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(documents, order):
    want, _ = brute(ROWS, order)
    got = katz_scores(documents(ROWS, score=1, p=2), order=order)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_add_up_to_one():
    """For every context the discounted, the backed-off and the unknown mass are exactly 1."""
    _, (p, counts) = brute(ROWS, 2)
    vocabulary = [w for (w,) in counts[1]]
    for h in [("the",), ("cat",), ("BOS",), ("never seen",)]:
        assert sum(p((*h, w)) for w in vocabulary) + p((*h, "unknown word")) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("few", [{}, {1: 5}, {2: 3}, {1: 100, 2: 30, 3: 12, 4: 8, 5: 5, 6: 3}, {1: 1, 6: 100}, {1: 10, 2: 10, 3: 10}])
def test_discounts_leave_mass(few):
    import numpy as np

    d = Discount(few).of(np.arange(1, 1000))
    assert ((d > 0) & (d < 1)).all()


def test_empty_and_untrained(documents):
    assert katz_scores(documents([])).count() == 0
    held = [(i, "a b") for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = katz_scores(documents(held)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.score == 0 for r in got)


def test_held_out_text_scores_better_than_the_base(spark):
    from conftest import SF_SMALL
    from postlens.llm.queries import QUERIES

    held = [r for r in QUERIES["op3_katz_scores"](spark, SF_SMALL).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
