"""Document quality by hierarchical empirical Bayes.

* A document classifier for each target (good text; toxic text): logistic
  regression over hashed words and word shapes plus a few text statistics,
  fitted on at most ``TRAIN_ROWS`` labelled documents (the smallest id hashes).
* Sites: a host (``source``) and a path within it (``lang`` here).  All documents'
  scores are added up by path with a grouped aggregation.
* Shrinking: a host's mean is drawn towards the global one and a path's towards
  its host's, by as many pseudo-documents as the spread between sites calls for
  (method of moments).  A site with few documents hardly moves from its parent.
* Posterior odds of a document: the classifier's, times path odds over global odds.

Scores are computed twice, once for the sites and once for the result, rather
than moving every text through a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import CHUNK_BYTES, doc_of, forget, stored, whole

TRAIN_ROWS = 8_000
TRAIN_WORDS = 16_000_000
WIDTH = 1 << 16
KEPT_WORDS = 4_000
BROADCAST_SITES = 20_000
STATS = 6
SHAPES = 64
PUNCTUATION = ".,;:!?\"'()[]{}"


# ---------------------------------------------------------------- features

def _shape(word: str) -> str:
    """Character classes with runs collapsed: a lower, A upper, 0 digit, else itself."""
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:8])


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = [zlib.crc32(w.strip(PUNCTUATION).lower().encode()) % WIDTH for w in words]
    shapes = [zlib.crc32(_shape(w).encode()) % SHAPES for w in words]
    return np.array(ids, np.int64), np.array(shapes, np.int64)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word) pairs, each once, and a dense row for each text."""
    n, texts = len(texts), whole(texts)
    parts = pc.utf8_split_whitespace(texts)
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    off = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    sizes = np.diff(sums[off])
    coded = flat.filter(keep).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    ids, shapes = _word_features(words)
    doc = doc_of(sizes).astype(np.int64)
    pairs = np.unique(doc * WIDTH + ids[codes]) if len(codes) else np.zeros(0, np.int64)
    total = np.maximum(sizes, 1)
    shape = np.bincount(doc * SHAPES + shapes[codes], minlength=n * SHAPES).reshape(n, SHAPES) / total[:, None] if len(codes) else np.zeros((n, SHAPES))
    pair_doc = pairs // WIDTH
    lengths = np.array([len(w) for w in words], float)
    lines = [t.split("\n") for t in texts.to_pylist()]
    stats = np.column_stack([
        np.log1p(total),
        np.bincount(pair_doc, minlength=n) / total,
        (np.bincount(doc, weights=lengths[codes], minlength=n) if len(codes) else np.zeros(n)) / total / 10,
        [len(set(x)) / len(x) for x in lines],
        np.log1p([len(x) for x in lines]),
        np.log1p(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) / 10])
    return pair_doc, pairs % WIDTH, np.hstack([np.log1p(100 * shape), stats])


@dataclass
class Classifier:
    """Weights by hashed word (mostly 0), dense weights with their scaling, bias."""

    words: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, word: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = ((dense - self.mean) / self.scale) @ self.dense + self.bias
        out += np.bincount(doc, weights=self.words[word], minlength=len(dense))
        return np.clip(out, -12, 12)


def fit(doc: np.ndarray, word: np.ndarray, dense: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 2.0) -> Classifier | None:
    """Ridge logistic regression over the words that differ most between classes; None for a single class."""
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        return None
    mean, scale = dense.mean(0), dense.std(0) + 1e-3
    df = np.bincount(word, minlength=WIDTH).astype(float)
    df_pos = np.bincount(word, weights=y[doc], minlength=WIDTH)
    expected = df * pos / n
    spread = (df_pos - expected) ** 2 / np.maximum(expected * (1 - pos / n), 1e-9)
    spread[df < 5] = 0
    used = np.sort(np.argsort(-spread, kind="stable")[:KEPT_WORDS])
    place = np.full(WIDTH, -1)
    place[used] = np.arange(len(used))
    keep = place[word] >= 0
    d, w = doc[keep], place[word[keep]]
    x = (dense - mean) / scale
    theta, m, v = np.zeros(len(used) + x.shape[1] + 1), 0.0, 0.0
    theta[-1] = np.log(pos / (n - pos))
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = x @ theta[len(used):-1] + theta[-1] + np.bincount(d, weights=theta[w], minlength=n)
        e = 1 / (1 + np.exp(-z)) - y
        g = np.concatenate([np.bincount(w, weights=e[d], minlength=len(used)), x.T @ e, [e.sum()]])
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(WIDTH)
    weights[used] = theta[:len(used)]
    return Classifier(weights, theta[len(used):-1], mean, scale, float(theta[-1]))


# ---------------------------------------------------------------- on Spark

def _slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES // 2, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, str], rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> dict[str, Classifier | None]:
    """Classifiers by target name; ``targets`` maps a name to a SQL condition on the labels.

    Fitted on at most ``rows`` labelled documents, the smallest id hashes, with at
    most ``words`` distinct hashed words in all: 4 bytes each on the driver.  Of
    several labels of an id the least counts, and of several documents the
    shortest.
    """
    known = labels.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.expr(c).cast("double"), F.lit(0.0)).alias(f"y_{k}") for k, c in targets.items()])
    # One label and one text an id (the least ones), so that ``rows`` bounds what is fitted on whatever repeats.
    known = known.groupBy("doc_id").agg(F.min(F.struct(*[f"y_{k}" for k in targets])).alias("y")).select("doc_id", "y.*")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")  # at most ``rows`` narrow rows are sent
    names = [f"y_{k}" for k in targets]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for big in batches:
            for b in _slices(big, 1):
                doc, word, dense = _features(b.column(1))
                cut = np.searchsorted(doc, np.arange(1, b.num_rows))
                ys = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
                of = [x.astype(np.int32) for x in np.split(word, cut)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([len(x) for x in of], pa.int32()), pa.array([x.tobytes() for x in of], pa.binary()),
                    pa.array([x.tobytes() for x in dense], pa.binary()), pa.array([x.tobytes() for x in ys], pa.binary())],
                    names=["doc_id", "n", "words", "dense", "y"])

    told = joined.select("doc_id", "text", *names).mapInArrow(run, "doc_id long, n int, words binary, dense binary, y binary")
    one = told.groupBy("doc_id").agg(F.min(F.struct("n", "words", "dense", "y")).alias("d")).select("doc_id", "d.*")
    # At most ``rows`` of them, and at most ``words`` hashed words in all: the first documents of the sample's order.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = stored(one, "labelled")
    inside = kept.select("doc_id", F.sum("n").over(order).alias("upto")).filter(F.col("upto") <= words).select("doc_id")  # a row an id: at most ``rows``
    got = kept.join(F.broadcast(inside), "doc_id").select("words", "dense", "y").collect()
    if not got:
        return {k: None for k in targets}
    got = sorted(map(tuple, got))  # one order, whatever order tasks ended in
    per = [np.frombuffer(r[0], np.int32).astype(np.int64) for r in got]
    doc, word = np.repeat(np.arange(len(got)), [len(p) for p in per]), np.concatenate(per)
    dense = np.vstack([np.frombuffer(r[1]) for r in got])
    y = np.vstack([np.frombuffer(r[2]) for r in got])
    return {k: fit(doc, word, dense, y[:, i]) for i, k in enumerate(targets)}


def _scored(docs: DataFrame, models: dict[str, Classifier | None], prefix: str) -> DataFrame:
    """``docs`` and a logit column for each target (0 without a model)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # fixed size: weights of WIDTH hashed words
    plain = docs.withColumn(f"{prefix}text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    schema = T.StructType(docs.schema.fields + [T.StructField(f"{prefix}{k}", T.DoubleType()) for k in models])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for big in batches:
            at = big.num_columns - 1
            for b in _slices(big, at):
                doc, word, dense = _features(b.column(at))
                logits = [pa.array(np.zeros(b.num_rows) if m is None else m.logits(doc, word, dense)) for m in shared.value.values()]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *logits], names=[*b.schema.names[:at], *[f"{prefix}{k}" for k in models]])

    return plain.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(n: Column, total: Column, parent: Column) -> Column:
    """Pseudo-documents of the parent, by the method of moments over sites.

    The spread of site means beyond what n documents would show by chance is the
    variance between sites; the less of it, the stronger the shrinking.
    """
    noise = F.sum(parent * (1 - parent))
    between = (F.sum(n * F.pow(total / n - parent, 2)) - noise) / F.greatest(F.sum(n), F.lit(1.0))
    within = noise / F.count("*")
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def site_posteriors(scores: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Posterior means ``path_<name>`` by (site_host, site_path), and the global means.

    ``scores``: site_host, site_path and a probability column for each name.
    """
    paths = stored(scores.groupBy("site_host", "site_path").agg(F.count("*").cast("double").alias("n"), *[F.sum(k).alias(k) for k in names]), "paths")
    whole = paths.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in names]).first()
    prior = {k: (whole[k] / whole["n"] if whole["n"] else 0.5) for k in names}
    hosts = paths.groupBy("site_host").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in names])
    pull = hosts.agg(*[strength(F.col("n"), F.col(k), F.lit(prior[k])).alias(k) for k in names]).first()
    hosts = hosts.select(F.col("site_host").alias("host"), *[
        ((F.col(k) + (pull[k] or 1.0) * prior[k]) / (F.col("n") + (pull[k] or 1.0))).alias(f"host_{k}") for k in names])
    joined = paths.join(hosts, F.col("site_host").eqNullSafe(F.col("host")))
    pull = joined.agg(*[strength(F.col("n"), F.col(k), F.col(f"host_{k}")).alias(k) for k in names]).first()
    return joined.select("site_host", "site_path", *[
        ((F.col(k) + (pull[k] or 1.0) * F.col(f"host_{k}")) / (F.col("n") + (pull[k] or 1.0))).alias(f"path_{k}") for k in names]), prior


TARGETS = {"good": "quality = 1", "toxic": "toxic = 1"}


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", targets: dict[str, str] | None = None,
          rows: int = TRAIN_ROWS, prefix: str = "_q_") -> DataFrame:
    """``docs`` with, for each target k, ``<prefix>k`` (posterior), ``<prefix>doc_k`` (classifier) and ``<prefix>site_k``.

    labels: (doc_id, quality, toxic); labels of unknown documents and null ids are
    ignored.  Null texts are empty, null hosts and paths are sites of
    their own, repeated rows are judged alike, texts are read whole.  Without
    labelled rows of both classes a target's classifier says 0.5 for everything.
    Other columns pass through; a column whose name begins with ``prefix`` is
    an error, so choose another prefix then.  An empty table gives none.
    """
    if any(c.startswith(prefix) for c in docs.columns):
        raise ValueError(f"columns beginning with {prefix!r} are taken; choose another prefix")
    targets = targets or TARGETS
    names, models = list(targets), train(docs, labels, targets or TARGETS, rows)
    odds = {k: 1 / (1 + F.exp(-F.col(f"{prefix}{k}"))) for k in names}
    # The first pass needs the texts and the site columns only.
    narrow = docs.select("text", F.col(host).alias("site_host"), F.col(path).alias("site_path"))
    sites, prior = site_posteriors(_scored(narrow, models, prefix).select("site_host", "site_path", *[p.alias(k) for k, p in odds.items()]), names)
    sites = stored(sites.select(*[F.col(c).alias(f"{prefix}{c}") for c in sites.columns]), "sites")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    both = _scored(docs, models, prefix).join(
        sites, F.col(host).eqNullSafe(F.col(f"{prefix}site_host")) & F.col(path).eqNullSafe(F.col(f"{prefix}site_path")), "left")
    out = [F.col(c) for c in docs.columns]
    for k in names:
        shift = _logit(F.col(f"{prefix}path_{k}")) - _logit(F.lit(prior[k]))
        out += [(1 / (1 + F.exp(-(F.col(f"{prefix}{k}") + shift)))).alias(f"{prefix}{k}"), odds[k].alias(f"{prefix}doc_{k}"),
                F.col(f"{prefix}path_{k}").alias(f"{prefix}site_{k}")]
    return both.select(*out)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prefix: str = "_q_", **options) -> DataFrame:
    """The rows of ``docs`` that are judged good and not toxic, with their own columns only.

    See ``judge`` for the cases.  A document goes if its posterior of being good
    is under ``threshold`` or that of being toxic is over it.  A target without
    labelled rows of both classes rejects nothing.
    """
    judged = judge(docs, labels, prefix=prefix, **options)
    return judged.filter((F.col(f"{prefix}good") >= threshold) & (F.col(f"{prefix}toxic") <= threshold)).select(*docs.columns)
