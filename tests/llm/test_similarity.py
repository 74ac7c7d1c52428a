"""Line dedup, n-gram join, embeddings and search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import ann, embedding_dedup, line_dedup, ngram_join
from postlens.llm.candidates import link
from postlens.llm.components import components
from corpus_fixtures import documents  # noqa: F401


class Classes:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- components and candidates

def test_components_equal_a_search(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    links += [(5, 5), (None, 3), (7, None), links[0], (-4, 1000)]
    c, ids = Classes(3000), {}
    for u, v in links:
        if u is not None and v is not None and u != v:
            c.unite(u + 10, v + 10)
            ids |= {u: 0, v: 0}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {u: c.find(u + 10) - 10 for u in ids}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("gap", [3, 60])
def test_candidate_links_have_all_components(spark, gap):
    """Ids on a line link when near: stars miss many of the links, the components are still all there."""
    rnd = random.Random(gap)
    place = {i: rnd.randint(0, 2000) for i in range(250)}
    groups = [(k, i) for i in place for k in {place[i] // 100, 50 + (place[i] + 50) // 100, 1000}]
    where = spark.createDataFrame(list(place.items()), "id long, x long")
    tried = []

    def verify(pairs):
        out = (pairs.join(where.withColumnsRenamed({"id": "a", "x": "xa"}), "a").join(where.withColumnsRenamed({"id": "b", "x": "xb"}), "b")
               .filter(F.abs(F.col("xa") - F.col("xb")) <= gap).select("a", "b"))
        tried.append(pairs.count())
        return out

    got = {r.node: r.component for r in components(link(spark.createDataFrame(groups, "key long, id long"), verify)).collect()}
    c = Classes(250)
    for i in place:
        for j in place:
            if abs(place[i] - place[j]) <= gap:
                c.unite(i, j)
    assert {i: got.get(i, i) for i in place} == {i: c.find(i) for i in place}
    if gap > 50:
        assert sum(tried) < 250 * 249 / 2  # even where one group holds all ids and few of them link


def test_small_groups_of_unlike_lines_are_not_carried_on(documents, monkeypatch):
    """Lines that share a band key with a few others are told apart once; no table of them is written for each star."""
    from postlens.llm import candidates

    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcd ") for _ in range(60)) for _ in range(120)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(500 + i, lines[i] + "b") for i in range(0, 120, 3)]
    carried, real = [], candidates.stored

    def counting(df, name):
        out = real(df, name)
        if name == "groups":
            carried.append(out.count())
        return out

    monkeypatch.setattr(candidates, "stored", counting)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows), min_chars=1).collect())
    assert got == sorted(brute_lines(rows, min_chars=1))
    assert sum(1 for d, x in got if d >= 500 and x == "") >= 38
    assert sum(carried) == 0


# ---------------------------------------------------------------- n-gram join

def words_of(rnd, n):
    return [f"w{rnd.randint(0, 400)}" for _ in range(n)]


def texts(seed):
    rnd = random.Random(seed)
    passage = words_of(rnd, 60)
    out = []
    for _ in range(12):
        base = words_of(rnd, rnd.choice([5, 30, 120]))
        out.append(base)
        for _ in range(rnd.randint(0, 9)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 9999)}"
            out.append(copy)
        out.append(words_of(rnd, 40) + passage)
    rows = [(3 * i + 1, " ".join(x)) for i, x in enumerate(out)]
    return rows + [(0, None), (2, ""), (5, " \t\n"), (8, "one"), (11, "ONE"), (14, "one two"), (17, "one two"), (20, "two one"), (1, rows[0][1]), (23, "é É" * 9)]


def brute_ngrams(rows, size, percent):
    sets = []
    for _, t in rows:
        raw = bytes(t or "", "utf8").lower().split()
        sets.append({tuple(raw[i:i + size]) for i in range(len(raw) - size + 1)} if len(raw) >= size else ({tuple(raw)} if raw else set()))
    c = Classes(len(rows))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                c.unite(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = c.find(i)
        least[r] = min(least.get(r, doc), doc)
    return sorted((doc, len(s), least[c.find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_ngram_components_equal_brute_force(documents, seed, size, percent):
    rows = texts(seed)
    got = ngram_join.ngram_components(documents(rows, n=1, places=2), size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute_ngrams(rows, size, percent)


def test_ngram_join_empty_null_ids_and_one_of_each(documents):
    assert ngram_join.ngram_components(documents([])).count() == 0
    same = "a b c d e f g h"
    rows = [(None, same), (4, same), (3, same), (3, same), (9, "p q r s t u"), (None, ""), (7, "")]
    got = sorted(map(tuple, ngram_join.ngram_components(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 5, 3), (4, 5, 3), (3, 5, 3), (3, 5, 3), (9, 3, 9), (None, 0, None), (7, 0, 7)], key=str)
    kept = ngram_join.one_of_each(documents(rows, extra="x"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", same), ("3", same), ("9", "p q r s t u"), ("None", ""), ("7", "")])


def test_many_near_copies_make_few_pairs(spark, documents, monkeypatch):
    rnd = random.Random(4)
    base = words_of(rnd, 200)
    rows = []
    for i in range(250):
        copy = list(base)
        copy[rnd.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    seen = []
    real = ngram_join._verifier

    def counting(*a):
        verify = real(*a)

        def run(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return run

    monkeypatch.setattr(ngram_join, "_verifier", counting)
    got = ngram_join.ngram_components(documents(rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 250 * 20


def test_near_copies_that_do_not_link_make_few_pairs(documents, monkeypatch):
    """Each copy is near a text that is not there and too far from the others, but for some."""
    rnd = random.Random(5)
    base = words_of(rnd, 200)
    rows = []
    for i in range(150):
        copy = list(base)
        for k, at in enumerate(rnd.sample(range(200), 3)):
            copy[at] = f"n{i}-{k}"
        rows.append((i, " ".join(copy)))
    for i in range(0, 150, 10):
        rows.append((200 + i, rows[i][1].replace(f"n{i}-0", f"m{i}")))
    seen = []
    real = ngram_join._verifier

    def counting(*a):
        verify = real(*a)

        def run(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return run

    monkeypatch.setattr(ngram_join, "_verifier", counting)
    got = sorted(map(tuple, ngram_join.ngram_components(documents(rows)).collect()))
    want = brute_ngrams(rows, 4, 85)
    assert got == want and len({c for _, _, c in want}) > 100
    assert sum(seen) < len(rows) * 10


# ---------------------------------------------------------------- line dedup

def brute_lines(rows, similarity=0.8, min_chars=20):
    lines = sorted({n for _, t in rows for n in map(line_dedup.normal, (t or "").split("\n")) if len(n) >= min_chars})
    at = {n: i for i, n in enumerate(lines)}
    sets = [line_dedup.shingles(n) for n in lines]
    c = Classes(len(lines))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                c.unite(i, j)
    first = {}
    for doc, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if (n := line_dedup.normal(x)) in at:
                r = c.find(at[n])
                first[r] = min(first.get(r, (doc, k)), (doc, k))
    out = []
    for doc, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (n := line_dedup.normal(x)) not in at or first[c.find(at[n])] == (doc, k)]
        out.append((doc, None if t is None else "\n".join(kept)))
    return out


def line_rows():
    rnd = random.Random(9)
    lines = [" ".join(words_of(rnd, rnd.choice([3, 12, 40]))) for _ in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rnd.randint(1, 6)):
            x = rnd.choice(lines).split()
            if rnd.random() < 0.4:
                x[rnd.randrange(len(x))] = f"y{rnd.randint(0, 99)}"
            own.append(rnd.choice(["  ", "", " "]) + " ".join(x).upper() if rnd.random() < 0.2 else " ".join(x))
        rows.append((i, "\n".join([*own, "", "short", f"line that only document {i * 7919} has {i}"])))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, lines[1]), (104, "z" * 50000)]


def test_lines_equal_brute_force(documents):
    rows = line_rows()
    got = line_dedup.dedup_lines(documents(rows, line_no=3, id="q"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "line_no", "id"]
    got = got.collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text is not None) == sorted(x for x in brute_lines(rows) if x[1] is not None)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert [r.text for r in got if r.doc_id == 100] == [None]


def test_repeated_rows_end_alike_and_emptied_documents_go(documents):
    one = "this is a line that is long enough"
    rows = [(1, one), (1, one), (2, one), (3, one + "\nkept"), (4, ""), (5, None)]
    out = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows)).collect()), key=str)
    assert out == sorted([(1, one), (1, one), (2, ""), (3, "kept"), (4, ""), (5, None)], key=str)
    assert sorted(r.doc_id for r in line_dedup.drop_emptied(documents(rows)).collect()) == [1, 1, 3, 4, 5]
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_short_lines_are_compared_too(spark, documents):
    rows = [(1, "les.\na\n\n你好。\nown one"), (2, "Les.\n b\n\n  \n你好。"), (3, "a\nles.\n你好。"), (4, "les.\nx")]
    want = [(1, "les.\na\n\n你好。\nown one"), (2, " b\n\n  "), (3, ""), (4, "x")]
    got = line_dedup.dedup_lines(documents(rows), min_chars=1, count_col="gone").collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
    assert sorted((r.doc_id, r.gone) for r in got) == [(1, 0), (2, 2), (3, 3), (4, 1)]
    assert [r.doc_id for r in line_dedup.drop_emptied(documents(rows), min_chars=1).collect()].count(3) == 0


def test_the_query_leaves_no_equal_lines(spark):
    from conftest import SF_SMALL
    from postlens.llm.queries import QUERIES

    left = [n for r in QUERIES["op4_line_dedup"](spark, SF_SMALL).collect() for n in map(line_dedup.normal, (r.text or "").split("\n")) if n]
    assert len(left) == len(set(left))


def test_bands_find_similar_lines():
    """Recall of the bands on pairs just above the threshold."""
    rnd = random.Random(11)
    hit = total = 0
    while total < 200:
        a = " ".join(words_of(rnd, 40))
        b = list(a)
        for _ in range(2):
            b[rnd.randrange(len(b))] = "#"
        b = "".join(b)
        s, t = line_dedup.shingles(a), line_dedup.shingles(b)
        if 0.8 <= len(s & t) / len(s | t) <= 0.9:
            x, y = line_dedup.band_keys([a, b])
            hit, total = hit + bool(set(x) & set(y)), total + 1
    assert hit / total >= 0.98


def edited(rnd, lo, hi, by_word):
    """A line of lo to hi characters and a copy with one word or one character replaced."""
    while True:
        words = ["".join(rnd.choice("etaoinsrhldcumfpgwybvk") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(3, 20))]
        a = " ".join(words)
        if lo <= len(a) <= hi:
            break
    if by_word:
        words[rnd.randrange(len(words))] = "".join(rnd.choice("etaoinsrhldcumfpgwybvk") for _ in range(6))
        return a, " ".join(words)
    at = rnd.randrange(len(a))
    return a, a[:at] + "7" + a[at + 1:]


@pytest.mark.parametrize("lo,hi,by_word,least", [(20, 30, False, 0.15), (32, 100, False, 0.97), (20, 74, True, 0.15), (76, 100, True, 0.85), (130, 300, True, 0.95)])
def test_edited_lines_link(spark, lo, hi, by_word, least):
    """Recall on lines with one edit, whatever the shingles are; at 0.8 an edit of a very short line is often too much."""
    rnd = random.Random(lo)
    rows = [(i, "\n".join(edited(rnd, lo, hi, by_word))) for i in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count_col="gone")
    assert got.agg(F.sum("gone")).first()[0] >= least * len(rows)


def test_periodic_lines_of_any_length_link(documents):
    rows = [(i, "\n".join([("-" * n), ("* " * n), ("ha " * n), ("+--" * n), f"own line number {i} " + "xyz"[i % 3] * 5])) for i, n in enumerate([30, 200, 3000])]
    got = line_dedup.dedup_lines(documents(rows), count_col="gone").collect()
    assert sorted((r.doc_id, r.gone) for r in got) == [(0, 0), (1, 4), (2, 4)]


def test_no_alike_lines_are_impossible(spark):
    """The filter before the exact test holds for every pair at or above the similarity, and for few that are much less alike."""
    rnd = random.Random(6)
    rows, truth = [], []
    for i in range(400):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(8, 90)))
        b = list(a)
        for _ in range(rnd.randint(1, 12)):
            b[rnd.randrange(len(b))] = rnd.choice("abcdefgh ")
        pair = [a, "".join(b)]
        s, t = (line_dedup.shingles(x, 3) for x in pair)
        n, bits = line_dedup.summaries(pair, 3)
        assert n.tolist() == [len(s), len(t)]
        rows.append((i, *n.tolist(), *bits.reshape(-1).tolist()))
        truth.append(len(s & t) / len(s | t))
    facts = ["n", "n2", *line_dedup.BITS, *(f"{c}2" for c in line_dedup.BITS)]
    kept = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} long" for c in facts)).filter(line_dedup.possible(0.8))
    kept = {r.i for r in kept.collect()}
    assert {i for i, j in enumerate(truth) if j >= 0.8} <= kept
    less = [i for i, j in enumerate(truth) if j < 0.5]
    assert len(kept & set(less)) <= 0.05 * len(less)


def test_bands_and_filter_lose_few_alike_lines(documents):
    """Recall of the whole on pairs at 0.8 to 0.85."""
    rnd = random.Random(7)
    rows = []
    while len(rows) < 300:
        a, b = edited(rnd, 20, 100, rnd.random() < 0.5)
        s, t = line_dedup.shingles(a, 3), line_dedup.shingles(b, 3)
        if 0.8 <= len(s & t) / len(s | t) <= 0.85:
            rows.append((len(rows), a + "\n" + b))
    gone = line_dedup.dedup_lines(documents(rows), count_col="gone").agg(F.sum("gone")).first()[0]
    assert gone >= 0.99 * len(rows)


def test_lines_of_every_length_of_shingles_link(documents):
    """Near copies on both sides of a limit of ``lengths``, which share one of their lengths."""
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(400))
    rows = [(n, line_dedup.normal(text[:n])) for n in range(90, 400)]
    assert [line_dedup.lengths(t) for n, t in rows if n in (90, 150, 300)] == [[3], [3, 8], [8]]
    got = line_dedup.drop_emptied(documents(rows)).collect()
    assert [r.doc_id for r in got] == [90]


SYLLABLES = ["the", "in", "an", "er", "on", "re", "ti", "ha", "nd", "es"]


def spoken(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_lines_alike_by_chance_make_no_groups(documents, monkeypatch):
    """Lines of one language share band keys; only those that can be alike are carried on, once for all their bands."""
    rnd = random.Random(8)
    lines = [spoken(rnd, rnd.randint(8, 12)) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, lines[i] + " x") for i in range(0, 400, 20)]
    carried, real = [], line_dedup.stored

    def counting(df, name):
        out = real(df, name)
        if name == "bands":
            carried.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counting)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows), min_chars=1).collect())
    assert got == sorted(brute_lines(rows, min_chars=1))
    assert 2 * 20 <= carried[0] <= 8 * 20


@pytest.mark.parametrize("groups", [1, 40])
def test_parts_keep_alike_lines_together(groups):
    """Groups of many and of few lines are cut, never between two lines that are alike."""
    rnd = random.Random(groups)
    lines = [spoken(rnd, rnd.randint(2, 14)) for _ in range(200)]
    lines = sorted({line_dedup.normal(x) for x in lines + [x[:-3] + "q" for x in lines] if len(x) > 5})
    n, bits = line_dedup.summaries(lines, 3)
    group = np.arange(len(lines)) // 2 % groups
    order = np.lexsort((n, group))
    facts = np.zeros(len(lines), line_dedup.FACTS)
    facts["n"], facts["bits"] = n, bits.view(np.uint64)
    label = line_dedup.parts(np.bincount(group), facts[order], 0.8)
    sets = [line_dedup.shingles(lines[i], 3) for i in order]
    group = group[order]
    for i, s in enumerate(sets):
        for j in range(i):
            if group[i] == group[j] and line_dedup.alike(s, sets[j], 0.8):
                assert label[i] == label[j]
    assert all(group[label] == group)
    assert len(set(label.tolist())) > len(lines) / 4


@pytest.mark.parametrize("block", [7, 2048])
def test_large_groups_are_linked_by_pairs_of_blocks(documents, monkeypatch, block):
    """Near copies of two lines and lines that share half of their shingles: all classes are found, no row is made for each pair."""
    rnd = random.Random(block)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(90)), "".join(rnd.choice("abcdefghij ") for _ in range(400))]
    lines = [b[:k] + "#" + b[k + 1:] for b in base for k in range(5, 85, 2)]
    lines += [base[0][:45] + "".join(rnd.choice("klmnop ") for _ in range(45)) for _ in range(40)]
    rows = list(enumerate(lines))
    links, real = [], line_dedup.components

    def counting(df):
        links.append(df.count())
        return real(df)

    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    monkeypatch.setattr(line_dedup, "components", counting)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(rows), min_chars=1).collect())
    assert got == sorted(brute_lines(rows, min_chars=1))
    assert sum(1 for _, x in got if x) == 42
    assert links[0] < 14 * len(lines)


def test_alike_is_exact_for_lines_of_any_size():
    """Counts by hashes, and shingles where a collision could decide, agree with sets."""
    rnd = random.Random(4)
    lines = sorted({line_dedup.normal("".join(rnd.choice("ab ") for _ in range(rnd.randint(9, 40)))) for _ in range(120)} - {""})
    for size in (3, 8):
        some = [x for x in lines if len(x) >= size]
        held = line_dedup._Lines(some, size, 0.8)
        x, y = np.triu_indices(len(some), 1)
        want = [line_dedup.alike(line_dedup.shingles(some[i], size), line_dedup.shingles(some[j], size), 0.8) for i, j in zip(x, y)]
        assert held.alike(x, y).tolist() == want
        for fine in (False, True):
            assert not (np.array(want) & ~held.can(x, y, fine)).any()
        assert held.n.tolist() == [len(line_dedup.shingles(z, size)) for z in some]


def test_candidate_lines_have_their_bit(spark):
    ids = [0, -1, 5, 2**63 - 1, -(2**63), 1 << 20, 12345678901]
    held = line_dedup._bitmap(spark.createDataFrame([(x,) for x in ids], "id long"))
    own = np.array(ids, np.int64) & (8 * len(held) - 1)
    assert (held[own >> 3] >> (own & 7) & 1).tolist() == [1] * len(ids)
    assert np.unpackbits(held).sum() <= len(ids)
    assert not line_dedup._bitmap(spark.createDataFrame([], "id long")).any()


def test_lines_are_told_apart_as_one_by_one():
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(2000))
    lines = [text[:n] for n in (1, 2, 3, 50, 129, 130, 131, 161, 162, 163, 300, 511, 512, 513, 2000)]
    lines += ["ab" * 5000, "ab" * 400 + text[:100], "ab" * 400 + text[:140], "ab" * 400 + text, "\u4f60\u597d" * 3]
    got = {(size, x) for size, some in line_dedup._by_length(lines) for x in some}
    assert got == {(size, x) for x in lines for size in line_dedup.lengths(x)}


# ---------------------------------------------------------------- embeddings

VECTORS = "vec_id long, embedding array<float>, label int, x string"


def vector_rows(seed=1, n=150, dim=16):
    rnd = np.random.default_rng(seed)
    rows, centers = [], rnd.normal(size=(12, dim))
    for i in range(n):
        v = centers[i % 12] + rnd.normal(size=dim) * (0.0 if i % 5 == 0 else rnd.choice([0.05, 0.1, 0.5]))
        rows.append((i + 1, (v * rnd.choice([0.5, 1, 3])).astype(np.float32).tolist(), int(i % 2) if i % 11 else None, "x"))
    return rows + [(500, None, 1, "x"), (501, [0.0] * dim, 1, "x"), (502, [float("nan")] * dim, 1, "x"), (503, [float("inf")] + [0.0] * (dim - 1), 0, "x"),
                   (504, [None] + [1.0] * (dim - 1), 0, "x"), (505, [1.0] * 3, 0, "x"), (506, [], 1, "x"), rows[0], rows[0]]


def usable(v, dim=16):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("small", [False, True])
def test_embedding_links_equal_brute_force(spark, monkeypatch, small):
    if small:  # many cells, blocks and pairs of blocks
        for k, v in (("CELL_ROWS", 20), ("BLOCK_ROWS", 7), ("SOME_PAIRS", 50)):
            monkeypatch.setattr(embedding_dedup, k, v)
    rows = vector_rows()
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.98).collect()}
    own = {r[0]: r for r in rows}
    ids = sorted(own)
    c, links = Classes(1000), {i: 0 for i in ids}
    for i in ids:
        for j in ids:
            a, b = own[i], own[j]
            if i < j and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    c.unite(i, j)
    assert got == {i: (links[i], c.find(i), c.find(i) == i) for i in ids}
    assert sum(links.values()) > 100


def test_cover_tree_holds_every_row_within_its_radius():
    x = np.random.default_rng(0).normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dedup.CoverTree(x)
    for r, level in zip(embedding_dedup.LEVELS, tree.levels):
        assert sorted(level["order"]) == list(range(200))
        for c, radius, begin, size in zip(level["center"], level["radius"], level["begin"], level["size"]):
            own = level["order"][begin:begin + size]
            assert c in own and np.linalg.norm(x[own] - x[c], axis=1).max() <= min(radius, r) + 1e-6
    assert all(set(a["center"]) <= set(b["center"]) for a, b in zip(tree.levels, tree.levels[1:]))  # nested


def test_vectors_of_two_dimensions(spark):
    """Each dimension is compared and searched among its own rows, the rarer one too."""
    rows = [(i, [1.0, 0.01 * i, 0.0], 0, "x") for i in range(1, 6)] + [(10 + i, [0.01 * i, 1.0], 0, "x") for i in range(3)] + [(20, [1.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.98).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {10 + i: (2, 10) for i in range(3)} | {20: (0, 20)}
    found = [(r.query_id, r.rank, r.vec_id) for r in sorted(ann.nearest(df, df.filter("vec_id in (1, 10)"), k=2, recall=1.0).collect())]
    assert found == [(1, 1, 5), (1, 2, 4), (10, 1, 11), (10, 2, 12)]


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert ann.nearest(empty, empty).count() == 0


def brute_nearest(rows, queries, k):
    own = {r[0]: np.array(r[1], float) for r in rows if usable(r[1])}
    out = {}
    for q in {r[0] for r in queries} & set(own):
        scored = sorted(((-(own[q] * v).sum(), i) for i, v in own.items() if i != q))[:k]
        out[q] = [i for _, i in scored]
    return out


def test_nearest_is_exact_when_all_leaves_are_visited(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rows = vector_rows(n=120)
    df = spark.createDataFrame(rows, VECTORS)
    got = ann.nearest(df, df.filter("vec_id % 10 = 0"), k=7, recall=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(got.collect()):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(found[r.query_id])
    assert found == brute_nearest(rows, [r for r in rows if r[0] % 10 == 0], 7)


def test_nearest_with_fewer_candidates_and_ties(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.0], 0, "x"), (3, [1.0, 0.0], 0, "x"), (4, [0.0, 1.0], 0, "x"), (None, [1.0, 1.0], 0, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(ann.nearest(df, df.filter("vec_id = 2"), k=20).collect())]
    assert got == [(2, 1, 1, 1.0), (2, 2, 3, 1.0), (2, 3, 4, 0.0)]


def test_recall_on_the_table(spark):
    from conftest import SF_MID
    from postlens.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    got = {}
    for r in QUERIES["op9_nearest_neighbours"](spark, SF_MID).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hit += len(got[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and hit / (20 * len(got)) >= 0.9
