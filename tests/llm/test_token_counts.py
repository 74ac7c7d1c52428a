"""Token counts against the tokenizers library."""

from __future__ import annotations

import random

import pytest

from postlens.llm.token_counts import TokenCounter, token_counts

import public_tokenizers
from corpus_fixtures import documents  # noqa: F401

FILE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "\n", "a", "b", "the", "'", "s", "1", "!", "\t", ",", ".", "é", "\x1c", "\x85", "<|endoftext|>", "　", "ʼ", "aaaa", "日", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_library(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 16))) for _ in range(5000)] + ["x" * 20000, " " * 500, "ab " * 5000]
    counter = TokenCounter(FILE, keep=50, batch_chars=2000)
    assert counter.counts(texts) == library(texts)
    assert counter.counts(texts) == library(texts)  # also with what it remembers


def test_rows(spark, documents, library):
    long = "thonti ereading. " * 4000
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (5, long), (6, "<|endoftext|>a<|endoftext|>")]
    got = token_counts(documents(rows, n_tokens=7), FILE, limit=1024)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts(documents([]), FILE).count() == 0


def test_whole_table(spark, library):
    from conftest import SF_SMALL
    from postlens.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, SF_SMALL).collect()}
    assert got == dict(zip(texts, library(list(texts.values()))))
