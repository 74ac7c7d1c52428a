"""Shared helpers: input tables, work tables, word chunks and hashed-key blobs.

A *chunk* is a run of documents of one input partition, at most
``CHUNK_BYTES`` of text (one longer document is a chunk of its own).  Chunks
bound what a task holds and are the unit that talks to the count tables: a
chunk sends its distinct keys, sorted and delta-coded, to hash buckets and
gets one answer per key back.  A key that is frequent everywhere costs one
entry per chunk, so no key is hot, and no row is sent per occurrence.

Chunk numbers come from the partition number and a counter, so a task that is
run again after an executor was lost produces the same chunks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import settings, work_dir

CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16
ROW_BITS = 17  # a chunk has fewer than 2**ROW_BITS rows
CHUNK_BITS = 20  # a partition has fewer than 2**CHUNK_BITS chunks


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a work table in the shared folder and read it back.

    Cuts lineage: later steps read the files, also after executors are lost.  Rows go to
    Python and back in batches of less than a chunk, whatever their texts' size.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    with settings(spark, **{"spark.sql.execution.arrow.maxBytesPerBatch": str(CHUNK_BYTES - (CHUNK_BYTES >> 4))}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_remembered: dict = {}


def remembered(key: Hashable, make: Callable):
    """What the tasks of one operator remember in a Python worker, made once; what another operator left goes."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Workers serve one stage after the other: what earlier ones remembered goes before a task of another kind."""
    _remembered.clear()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # else what was freed stays with the worker
        trim(0)


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# ---------------------------------------------------------------- chunks

def chunks(batches: Iterable[pa.RecordBatch], max_bytes: int = CHUNK_BYTES,
           max_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Cut Arrow batches into (chunk number, rows) of bounded text size."""
    forget()
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, base + max_bytes, side="right"))
            hi = max(lo + 1, min(hi, lo + max_rows))
            yield (part << CHUNK_BITS) + seq, b.slice(lo, hi - lo)
            seq += 1
            lo = hi


def whole(texts: pa.Array) -> pa.Array:
    """Texts as an array of its own: casting a slice of a larger one reads from the wrong place."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return texts.cast(pa.large_string())


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the word codes of all texts in order, the number of words of each
    text, and the distinct words that the codes point into.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole(texts)))
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    off = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = flat.filter(keep).dictionary_encode()
    return coded.indices.to_numpy(), np.diff(sums[off]).astype(np.int64), coded.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doc_of(counts: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(counts), dtype=np.int32), counts)


# ---------------------------------------------------------------- blobs

def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (sorted keys: pack their differences)."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    body = np.ascontiguousarray(planes).tobytes()
    return pa.compress(body, codec="zstd", asbytes=True) if body else b""


def unpack(blob: bytes, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if n == 0:
        return np.zeros(0, dtype)
    body = pa.decompress(blob, decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    planes = np.frombuffer(body, np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n, np.uint64), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, bits: int, key_bits: int = 64) -> np.ndarray:
    """Where each of the 2**bits ranges of the key space begins in sorted keys."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(key_bits - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def bucket_bits(docs: DataFrame, keys_per_bucket: int = 1 << 18) -> int:
    """log2 of the number of buckets, so that one bucket's keys fit in a task.

    Counts the bytes of all texts (one cheap scan) and takes a key per four.
    At least 512 buckets, so that they spread evenly over many tasks.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(20, int(max(512, size // 4 // keys_per_bucket) - 1).bit_length())
