"""Best-fit packing of token sequences by a distributed grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Full pieces fill a sequence alone.  The others are dealt by a hash of their
row into shards of about ``SHARD_ITEMS`` pieces; packing a shard is one search.
Each shard has ``islands`` populations that evolve in tasks of their own:

* a chromosome is a list of bins (groups), the unit that crossover handles;
* crossover injects the well-filled bins of one parent into the other, removes
  the bins that now hold a piece twice, and puts the displaced pieces back by
  best fit;
* mutation opens the emptiest bins and some others and best-fits their pieces;
* after each epoch every island's elite migrates to the next island.

The populations between epochs are small work tables in the shared folder.
Every random choice is seeded by shard, island and epoch, so a task that runs
again after an executor was lost gives the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import doc_texts, remembered, stored

CAPACITY = 2048
KEPT_BYTES = 320 << 20
ENTRY_BYTES = 190  # a text's, a bytes object's and a dictionary entry's own size
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
CHROMOSOME = "shard long, island int, place int, n_bins long, squares double, genome binary"


# ---------------------------------------------------------------- tokens

class TokenIds(dict):
    """Ids by the tokenizers library of text parts (as little-endian unsigned 32-bit integers), remembered.

    For a tokenizer that lower-cases, drops white space and never joins letters
    with other characters: text between spaces and newlines can be encoded apart,
    a closing full stop or comma apart from the letters before it, and letters in
    lower case.  What is remembered is bounded by its bytes.
    """

    def __init__(self, path: str, keep: int = KEPT_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.keep, self.held = Tokenizer.from_file(path), keep, 0
        for some in (("ab cd", "ab  cd", "ab\ncd", " ab cd\n", "AB Cd"), ("ab.", "ab ."), ("ab, c", "ab , c")):
            if len({tuple(self.tok.encode(p, add_special_tokens=False).ids) for p in some}) != 1:
                raise ValueError("expected a tokenizer that lower-cases, drops white space and splits at punctuation")
        self.word = self.tok.model.tokenize

    def __missing__(self, part: str) -> bytes:
        if self.held >= self.keep:
            self.clear()
            self.held = 0
        plain = part.isascii() and part.isalpha()
        if len(part) > 1 and part[-1] in ",." and part[-2].lower().isalpha():
            out = self[part[:-1]] + self[part[-1]]
        elif plain and not part.islower():
            out = self[part.lower()]
        else:
            found = [t.id for t in self.word(part)] if plain else self.tok.encode(part, add_special_tokens=False).ids
            out = np.array(found, "<u4").tobytes()
        self[part] = out
        self.held += 2 * len(part) + len(out) + ENTRY_BYTES
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def shared_ids(path: str) -> TokenIds:
    """One memory for all tasks that a Python worker runs."""
    return remembered(("ids", path), lambda: TokenIds(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): every document's ids, the end id included, cut at ``capacity``.

    row: a number of the row, unique in the result, from the partition number
    and a counter.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = shared_ids(tokenizer).ids, TaskContext.get().partitionId() << 40
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                out: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = ids(text) + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        out.append((row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return doc_texts(docs).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- one island

class Bins:
    """Open bins by free room; the best fit is the lowest set bit of a mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def _open(self, b: int) -> None:
        self.by_room[self.room[b]].append(b)
        self.mask |= 1 << self.room[b]

    def add(self, items: list[int], fill: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - fill)
        self._open(len(self.items) - 1)

    def best_fit(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if not fitting:
            self.add([item], size)
            return
        room = size + (fitting & -fitting).bit_length() - 1
        shelf = self.by_room[room]
        b = shelf.pop()
        if not shelf:
            self.mask &= ~(1 << room)
        self.items[b].append(item)
        self.room[b] = room - size
        self._open(b)


class Island:
    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(sizes.sum()) // capacity)

    def fill(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Keep ``bins`` and put ``loose`` items back by best fit, largest first."""
        open_bins = Bins(self.capacity)
        for items in bins:
            open_bins.add(list(items), sum(self.sizes[i] for i in items))
        for i in sorted(loose, key=lambda i: -self.sizes[i]):
            open_bins.best_fit(i, self.sizes[i])
        return open_bins.items

    def fresh(self, first: bool) -> list[list[int]]:
        """Best fit decreasing, or best fit over sizes blurred by noise."""
        order = np.array(self.sizes, float)
        if not first:
            order *= self.rng.uniform(0.6, 1.4, len(order))
        open_bins = Bins(self.capacity)
        for i in np.argsort(-order, kind="stable").tolist():
            open_bins.best_fit(i, self.sizes[i])
        return open_bins.items

    def rate(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; then bins as unequally filled as possible. Smaller is better."""
        fills = [sum(self.sizes[i] for i in b) / self.capacity for b in bins]
        return len(bins), -sum(f * f for f in fills)

    def by_fill(self, bins: list[list[int]]) -> list[int]:
        return sorted(range(len(bins)), key=lambda b: -sum(self.sizes[i] for i in bins[b]))

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        best = self.by_fill(b)[: max(1, len(b) // 2)]
        injected = [b[k] for k in best if self.rng.random() < 0.5]
        taken = {i for items in injected for i in items}
        rest, loose = [], []
        for items in a:
            if taken.isdisjoint(items):
                rest.append(items)
            else:
                loose += [i for i in items if i not in taken]
        return self.fill(injected + rest, loose)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        order = self.by_fill(bins)
        n = max(1, len(bins) // 20)
        opened = {*order[-n:], *self.rng.choice(len(bins), n).tolist()}
        return self.fill([b for k, b in enumerate(bins) if k not in opened], [i for k in opened for i in bins[k]])

    def evolve(self, population: list[list[list[int]]], size: int, generations: int) -> list[list[list[int]]]:
        while len(population) < size:
            population.append(self.fresh(not population))
        ranked = sorted(((self.rate(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
        for g in range(generations):
            if ranked[0][0][0] <= self.least:
                break  # no packing has fewer bins
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.mutate(self.cross(ranked[a][2], ranked[b][2]))
            ranked.append((self.rate(child), len(population) + g, child))
            ranked = sorted(ranked, key=lambda x: x[:2])[:size]
        return [p for _, _, p in ranked[:size]]


def _genome(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def _bins(genome: bytes) -> list[list[int]]:
    of = np.frombuffer(genome, np.int32)
    out: list[list[int]] = [[] for _ in range(int(of.max(initial=-1)) + 1)]
    for i, b in enumerate(of.tolist()):
        out[b].append(i)
    return out


# ---------------------------------------------------------------- all shards

def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
         epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS, seed: int = 7) -> DataFrame:
    """Place items (row unique, length in 1..capacity) into bins of ``capacity``.

    Returns the columns of ``items`` with sequence_id long and offset long
    (gapless from 0 in each sequence, in order of row).  An empty table gives an empty one.
    """
    for c in ("sequence_id", "offset", "shard"):
        if c in items.columns:
            raise ValueError(f"items already have a column {c}")
    full = items.filter(F.col("length") >= capacity)
    open_items = items.filter(F.col("length") < capacity)
    shards = max(1, -(-open_items.count() // shard_items))
    dealt = open_items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(shards)))
    narrow = dealt.select("shard", "row", "length", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("genome"))
    everywhere = narrow.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))

    def epoch(e: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            own = group[group["genome"].isna()].sort_values("row")
            sizes = own["length"].to_numpy(np.int64)
            start = [_bins(g) for g in group[group["genome"].notna()].sort_values("place")["genome"]]
            world = Island(sizes, capacity, zlib.crc32(f"{seed}/{shard}/{island}/{e}".encode()))
            found = world.evolve(start, population, generations)
            rates = [world.rate(p) for p in found]
            return pd.DataFrame({"shard": shard, "island": island, "place": range(len(found)), "n_bins": [r[0] for r in rates],
                                 "squares": [r[1] for r in rates], "genome": [_genome(p, len(sizes)) for p in found]})

        return run

    people = None
    for e in range(epochs):
        rows = everywhere
        if people is not None:
            elite = people.filter("place = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
            came = people.filter(F.col("place") < population - 1).unionByName(elite.withColumn("place", F.lit(population)))
            rows = everywhere.unionByName(came.select("shard", "island", "place", "genome"), allowMissingColumns=True)
        people = stored(rows.groupBy("shard", "island").applyInPandas(epoch(e), CHROMOSOME), "islands")
    best = people.groupBy("shard").agg(F.min(F.struct("n_bins", "squares", "island", "place", "genome"))["genome"].alias("genome"))

    def place(key: tuple, own: pd.DataFrame, genomes: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row")
        bins = np.frombuffer(genomes["genome"].iloc[0], np.int32).astype(np.int64) if len(own) else np.zeros(0, np.int64)
        ends = own["length"].groupby(bins).cumsum().to_numpy() if len(own) else bins
        return pd.DataFrame({"row": own["row"], "sequence_id": (int(key[0]) << 32) + bins, "offset": ends - own["length"]})

    placed = (dealt.select("shard", "row", "length").groupBy("shard").cogroup(best.groupBy("shard"))
              .applyInPandas(place, "row long, sequence_id long, offset long"))
    alone = full.select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return items.join(placed.union(alone), "row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece that holds the end token alone.  A null
    doc_id stays null; repeated rows are packed as often as they occur; very
    long texts become many pieces; other columns are ignored; an empty table
    gives none.  Only texts of more than ``capacity`` tokens are cut.
    """
    return pack(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity, **options).drop("row")
