"""Packing: the pieces against the tokenizers library, the bins by their rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm.packing import Island, TokenIds, pack, pack_documents

import public_tokenizers
from corpus_fixtures import documents  # noqa: F401

FILE = public_tokenizers.path("word_bpe_49k.json")


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    rnd = random.Random(5)
    alphabet = [" ", "\n", "a", "The", "'", "s", "1", "!", "\t", "É", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", ",", ".", "ΑΣ", "́", "İ", "don't", "ﬁ"]
    ids = TokenIds(FILE, keep=200)
    for _ in range(5000):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 14)))
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    rows = [(1, "some words here"), (2, None), (3, ""), (None, "x"), (1, "some words here"), (4, "long text, really. " * 500)]
    got = pack_documents(documents(rows, piece=1, offset="z"), FILE, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 64, k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert check_bins(got, 64) == -(-sum(w[3] for w in want) // 64)
    assert pack_documents(documents([]), FILE).count() == 0


@pytest.mark.parametrize("shard_items", [50, 10_000])
def test_few_bins_and_the_same_again(spark, shard_items):
    rnd = np.random.default_rng(2)
    items = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(rnd.integers(1, 101, 700))], "row long, length long")
    one = pack(items, 100, shard_items=shard_items, epochs=2).collect()
    total = sum(r.length for r in one)
    bins = check_bins(one, 100)
    shards = -(-700 // shard_items)  # each may leave a bin unfilled
    assert bins <= 1.05 * -(-total // 100) + shards
    again = pack(items.repartition(5), 100, shard_items=shard_items, epochs=2).collect()
    assert sorted(one) == sorted(again)


def test_clashing_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        pack(spark.range(3).select(F.col("id").alias("row"), F.lit(1).alias("length"), F.lit(0).alias("offset")), 10)


def test_evolution_beats_or_equals_best_fit_decreasing():
    """Sizes on which best fit decreasing wastes a bin: the search finds the packing that fills all."""
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    island = Island(sizes, 60, 1)
    first = island.rate(island.fresh(True))
    best = island.rate(island.evolve([], 6, 200)[0])
    assert best[0] == island.least == 3 < first[0]
    for child in (island.cross(island.fresh(True), island.fresh(False)), island.mutate(island.fresh(False))):
        assert sorted(i for b in child for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 60 for b in child)
