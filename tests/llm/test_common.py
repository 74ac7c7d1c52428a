"""Words, blobs and slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import common, quality

TEXTS = ["A b  c", "", "d e\x0b", None, "É ä É", " x\n", "f g h i"] * 5


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("lo,n", [(0, 35), (3, 9), (34, 1), (7, 0)])
def test_words_of_slices(kind, lo, n):
    """A chunk is a slice of a batch: its words are those of its own texts."""
    rows = pa.array([t or "" for t in TEXTS], kind).slice(lo, n)
    codes, counts, dictionary = common.words(rows)
    want = [bytes(t or "", "utf8").lower().split() for t in TEXTS[lo:lo + n]]
    assert counts.tolist() == [len(w) for w in want]
    words = [w.encode() for w in dictionary.to_pylist()]
    assert [words[c] for c in codes] == [w for ws in want for w in ws]


def test_features_of_slices():
    rows = pa.array([f"some Words {i} here!! scum{i % 3}\nline" for i in range(50)])
    all_doc, all_word, all_dense = quality._features(rows)
    doc, word, dense = quality._features(rows.slice(20, 10))
    assert (dense == all_dense[20:30]).all()
    inside = (all_doc >= 20) & (all_doc < 30)
    assert (doc == all_doc[inside] - 20).all() and (word == all_word[inside]).all()


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_blobs_round_trip(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    assert (common.unpack_sorted(common.pack_sorted(keys), n) == keys).all()
    small = keys.astype(np.uint32)
    assert (common.unpack(common.pack(small), n, np.uint32) == small).all()
    edges = common.bucket_edges(keys, 4)
    assert edges[0] == 0 and edges[-1] == n and len(edges) == 17
    for b in range(16):
        assert (keys[edges[b]:edges[b + 1]] >> np.uint64(60) == b).all()


def test_rows_go_to_python_in_batches_of_less_than_a_chunk(spark):
    """Few rows of long texts make more than one batch."""
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("text "), 200_000).alias("text"))
    got = common.stored(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in got) == 60
    assert max(r.size for r in got) < common.CHUNK_BYTES + 1_000_100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
