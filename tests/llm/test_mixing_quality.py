"""Mixing, the quality classifier, and the pipeline."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlens.llm import mixing, quality
from corpus_fixtures import documents  # noqa: F401


def mixture_rows():
    rows = [(i, "w " * 10, "en", "big") for i in range(600)] + [(1000 + i, "w " * 10, "en", "mid") for i in range(200)]
    return rows + [(2000 + i, "w " * 10, "en", None) for i in range(50)] + [(3000, None, "en", "tiny"), (3001, "", "en", "tiny")]


def test_weights_meet_the_repetition_limit(documents):
    docs = documents(mixture_rows())
    table = {r.source: r for r in mixing.weights(docs, max_repeats=3.0).collect()}
    assert max(r.repeats for r in table.values()) == pytest.approx(3.0, rel=1e-3)
    assert min(r.repeats for r in table.values()) == pytest.approx(1.0, rel=1e-6)
    assert sum(r.weight for r in table.values()) == pytest.approx(1)
    shares = {s: r.share for s, r in table.items()}
    a = math.log(table["mid"].weight / table["big"].weight) / math.log(shares["mid"] / shares["big"])
    for s, r in table.items():
        assert r.weight / table["big"].weight == pytest.approx((shares[s] / shares["big"]) ** a)


@pytest.mark.parametrize("target", [0.9, 1.2])
def test_weights_meet_the_entropy(documents, target):
    table = mixing.weights(documents(mixture_rows()), entropy=target, max_repeats=None, budget=5000).collect()
    assert -sum(r.weight * math.log(r.weight) for r in table) == pytest.approx(target, abs=1e-4)
    assert sum(r.budget for r in table) == pytest.approx(5000)


@pytest.mark.parametrize("options", [{"max_repeats": 2.5}, {"entropy": 1.1, "max_repeats": None, "budget": 9000}, {"max_repeats": 4.0, "budget": 3000}])
def test_tokens_come_to_the_budget(documents, options):
    docs = documents(mixture_rows(), cut="c", source2=1)
    taken = mixing.mix(docs, **options)
    table = {r.source: r for r in mixing.weights(docs, **options).collect()}
    got = {r.source: r for r in taken.groupBy("source").agg(F.sum(F.col("_copies") * mixing.tokens_of(F.col("text"))).alias("t"),
                                                           F.max("_copies").alias("hi"), F.min("_copies").alias("lo")).collect()}
    for s, r in table.items():
        assert abs(got[s].t - r.budget) <= max(11, r.tokens / mixing.BLOCKS * 4)
        assert math.floor(r.repeats) <= got[s].lo <= got[s].hi <= math.floor(r.repeats) + 1
    again = mixing.mix(docs.repartition(7), **options)
    assert sorted(taken.select("doc_id", "_copies").collect()) == sorted(again.select("doc_id", "_copies").collect())
    whole = mixing.mixed(docs, **options)
    assert whole.columns == docs.columns and whole.count() == taken.agg(F.sum("_copies")).first()[0]


def test_tokens_of_any_layout_and_script(documents):
    texts = {"one two\nthree": 3, "    one\n\n\n        two  \t three\r\n": 3, "a\tb\u00a0c\u3000d": 4, "\n \t": 1, "": 1, None: 1,
             "今天天气很好。": 7, "今天 nice天": 4, "สวัสดี": 6, "안녕 세계": 2, "\U00020000\U00020001": 2, "x" * 100_000: 1}
    got = documents(list(enumerate(texts))).select("doc_id", mixing.tokens_of(F.col("text")).alias("n"))
    assert [r.n for r in sorted(got.collect())] == list(texts.values())
    plain, indented = "one two three four", "        one\n        two\n\n        three\tfour"
    docs = documents([(i, plain, "en", "plain") for i in range(20)] + [(100 + i, indented, "en", "indented") for i in range(20)])
    assert [r.share for r in mixing.weights(docs).collect()] == [0.5, 0.5]


def test_mixing_cases(documents):
    assert mixing.mixed(documents([])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents([(1, "x")], _copies=1))
    with pytest.raises(ValueError):
        mixing.weights(documents([(1, "x")]), entropy=1.0, max_repeats=2.0)
    one = mixing.mix(documents([(1, "x y"), (1, "x y"), (None, "z")])).collect()
    assert [r["_copies"] for r in one] == [1, 1, 1]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def quality_rows(n=300):
    rows = []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 7 == 0
        words = [f"word{(i * 31 + k * 7) % 90}" for k in range(40)]
        if toxic:
            words[i % 40] = "scum"
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, f"s{i % 5}"))
    return rows


def test_held_out_documents_are_told_apart(spark, documents):
    rows = quality_rows()
    some = [(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(150)] + [(None, 0, 0), (99999, 0, 1)]
    judged = quality.judge(documents(rows, path_good=5, n=6), labels(spark, some)).collect()
    held = [r for r in judged if r.doc_id >= 150]
    assert sum((r["_q_good"] >= 0.5) == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert sum((r["_q_toxic"] >= 0.5) == (r.doc_id % 7 == 0) for r in held) >= 0.95 * len(held)
    kept = quality.accept(documents(rows, extra=1), labels(spark, some))
    assert kept.columns[-1] == "extra" and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 4 and i % 7 and i >= 150} - {-1}


def test_sites_shrink_towards_their_parents(spark):
    """A path with one bad document stays near its host; one with many moves away; hosts likewise."""
    rows = [("h1", "a", 0.9)] * 400 + [("h1", "b", 0.1)] * 400 + [("h1", "c", 0.1)] + [("h2", "a", 0.9)] * 300 + [("h3", None, 0.0)] + [(None, "a", 0.5)] * 9
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "site_host string, site_path string, good double"), ["good"])
    got = {(r.site_host, r.site_path): r.path_good for r in sites.collect()}
    assert prior["good"] == pytest.approx(sum(r[2] for r in rows) / len(rows))
    assert got["h1", "a"] > 0.85 and got["h1", "b"] < 0.15
    assert 0.15 < got["h1", "c"] < got["h1", "a"]  # one document: between itself and the host
    assert got["h3", None] > 0.1 and len(got) == 6


def test_quality_cases(spark, documents):
    none = labels(spark, [])
    rows = [(1, None), (2, ""), (None, "x"), (2, ""), (3, "long " * 50000)]
    assert quality.accept(documents(rows), none).count() == 5
    assert quality.accept(documents([]), none).count() == 0
    one = labels(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)])
    assert quality.accept(documents(rows), one).count() == 5
    with pytest.raises(ValueError):
        quality.judge(documents(rows, _q_x=1), none)


# ---------------------------------------------------------------- pipeline

@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from postlens.llm.common import read, stored

    docs, out = read(spark, SF_SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, stored(stage(spark, docs, SF_SMALL), f"test-{name}")))
        docs = out[-1][2]
    return out


def test_pipeline_stages(spark, stages):
    from test_similarity import brute_lines, brute_ngrams

    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes), name
    (_, first, good), (_, _, lines), (_, _, single), (_, _, mix), (_, _, packed) = stages
    clean = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert kept < {r.doc_id for r in first.collect()} and len(clean & kept) >= 0.97 * len(clean)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = [(i, t) for (i, t), (_, old) in zip(brute_lines(rows, min_chars=1), rows) if t is None or t == old or t.strip()]
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted(want)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    alone = {d for d, _, c in brute_ngrams(rows, 5, 80) if d == c}
    assert {r.doc_id for r in single.collect()} == alone and single.count() == len(alone)
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert set(counts) == alone and set(counts.values()) <= {1, 2}
    assert packed.select("doc_id").distinct().count() == len(alone)
    assert packed.filter("piece = 0").count() == mix.count()


def test_pipeline_run_is_the_stages(spark, stages):
    import corpus_pipeline

    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(got.select(*key).collect()) == sorted(stages[-1][2].select(*key).collect())


# ---------------------------------------------------------------- against plain Python

def test_copies_equal_a_loop(documents):
    """Shares, exponent, budgets, blocks and cuts recomputed row by row; only the hashes come from Spark."""
    seed, repeats = 3, 1.5
    docs = documents(mixture_rows() + [(i, "a b c", "en", None) for i in range(9000, 9040)])
    place = mixing._unit(F.lit(seed + 1), "source", "block", "whole")
    rows = docs.select("doc_id", "source", mixing.tokens_of(F.col("text")).alias("t"), mixing._block(["doc_id", "text"], seed).alias("block")).collect()
    tokens = {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.t
    total, most = sum(tokens.values()), max(tokens.values())
    least = min(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):  # the smallest source is repeated (least / most) ^ (a - 1) times
        a = (lo + hi) / 2
        lo, hi = (a, hi) if (least / most) ** (a - 1) > repeats else (lo, a)
    budget = {s: most * (t / most) ** hi for s, t in tokens.items()}
    whole = {s: int(budget[s] / t + 1e-6) for s, t in tokens.items()}
    spark = docs.sparkSession
    blocks = {}
    for r in rows:
        blocks[r.source, r.block] = blocks.get((r.source, r.block), 0) + r.t
    places = {(r.source, r.block): r.place for r in spark.createDataFrame(
        [(s, b, whole[s]) for s, b in blocks], "source string, block long, whole long").withColumn("place", place).collect()}
    extra = set()
    for s in tokens:
        upto, cut = 0, -1.0
        for b in sorted((b for x, b in blocks if x == s), key=lambda b: (places[s, b], b)):
            if upto + blocks[s, b] / 2 < budget[s] - whole[s] * tokens[s]:
                cut = places[s, b]
            upto += blocks[s, b]
        extra |= {(s, b) for x, b in blocks if x == s and places[s, b] <= cut}
    want = sorted((r.doc_id, whole[r.source] + ((r.source, r.block) in extra)) for r in rows)
    got = sorted((r.doc_id, r["_copies"]) for r in mixing.mix(docs, max_repeats=repeats).collect())
    assert total and got == want


def test_site_posteriors_equal_a_loop(spark):
    rng = __import__("random").Random(3)
    rows = [(rng.choice(["h1", "h2", None]), rng.choice(["a", "b", None]), rng.random()) for _ in range(400)] + [("h3", "z", 0.2)]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "site_host string, site_path string, good double"), ["good"])
    mean = sum(r[2] for r in rows) / len(rows)

    def grouped(key):
        out = {}
        for r in rows:
            n, t = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, t + r[2])
        return out

    def pull(groups, parent):
        noise = sum(parent(k) * (1 - parent(k)) for k in groups)
        between = (sum(n * (t / n - parent(k)) ** 2 for k, (n, t) in groups.items()) - noise) / max(sum(n for n, _ in groups.values()), 1)
        return min(max(noise / len(groups) / max(between, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = grouped(lambda r: r[0]), grouped(lambda r: (r[0], r[1]))
    p = pull(hosts, lambda k: mean)
    host = {k: (t + p * mean) / (n + p) for k, (n, t) in hosts.items()}
    p = pull(paths, lambda k: host[k[0]])
    want = {k: (t + p * host[k[0]]) / (n + p) for k, (n, t) in paths.items()}
    got = {(r.site_host, r.site_path): r.path_good for r in sites.collect()}
    assert prior["good"] == pytest.approx(mean) and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_posterior_is_the_classifier_moved_by_the_site(spark, documents):
    rows = quality_rows()
    some = labels(spark, [(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(150)])
    import math

    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    judged = quality.judge(documents(rows), some).collect()
    for k in ("good", "toxic"):
        mean = sum(r[f"_q_doc_{k}"] for r in judged) / len(judged)
        for r in judged:
            assert r[f"_q_{k}"] == pytest.approx(1 / (1 + math.exp(-(logit(r[f"_q_doc_{k}"]) + logit(r[f"_q_site_{k}"]) - logit(mean)))), abs=1e-6)


def test_the_sample_is_bounded_whatever_repeats(spark, documents, monkeypatch):
    """3,000 rows and labels of one id are one row of the sample; words are bounded in all."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda doc, word, dense, y, **k: seen.append((len(y), len(word))))
    rows = [(1, f"w{i} x") for i in range(3000)] + [(i, "a b c d e f g h") for i in range(2, 40)]
    marks = labels(spark, [(1, 1, 0)] * 500 + [(1, 0, 1)] * 500 + [(i, i % 2, 0) for i in range(2, 40)])
    quality.train(documents(rows), marks, quality.TARGETS, rows=10)
    assert seen[-1][0] == 10
    quality.train(documents(rows).filter("doc_id = 1"), marks, quality.TARGETS, rows=10)
    assert seen[-1] == (1, 2)
    quality.train(documents(rows), marks, quality.TARGETS, rows=10, words=30)
    assert seen[-1][0] < 10 and seen[-1][1] <= 30


def test_workers_keep_nothing_of_another_operator(spark, documents):
    """Ids that packing remembered in a Python worker are gone when the worker judges texts."""
    from postlens.llm.packing import pieces
    from postlens.llm.queries import tokenizer

    class Held:  # a model that tells how many such memories its worker holds
        def __reduce__(self):
            held = "sum(type(x).__name__ == 'TokenIds' for x in __import__('gc').get_objects())"
            return eval, (f"__import__('types').SimpleNamespace(logits=lambda doc, word, dense: dense[:, 0] * 0 + {held})",)

    docs = documents([(i, f"text {i} of some words") for i in range(64)]).repartition(8)
    assert pieces(docs, tokenizer("word_bpe_49k.json")).count() == 64
    assert [r.x_held for r in quality._scored(docs, {"held": Held()}, "x_").select("x_held").distinct().collect()] == [0.0]
