"""Mixing sources to target weights by temperature.

A source's weight is proportional to its token share to the power ``a``; a = 1
keeps the shares, a = 0 makes all sources equal.  The exponent is bisected
over the table of sources until the weights reach a target entropy or until
the most repeated source is repeated ``max_repeats`` times; each pass over the
table tries ``GRID`` exponents at once.  The weights are realised by budget: a
source's documents are dealt into blocks by a hash of the row, each epoch
is a permutation of the blocks, and the source takes whole epochs and then
blocks of the next one until its budget of tokens is met.  Which blocks those
are is one number a source (a cut through hash order), so documents
only need the small table of sources: no text is shuffled, and a source that
holds a third of all rows is read by as many tasks as the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import stored

GRID = 32
PASSES = 4
BLOCKS = 256
BROADCAST_SOURCES = 20_000


SPACE = r"\s\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Scripts written without spaces: Thai, Lao, Burmese, Khmer, kana and ideographs with their punctuation.
LONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FFF\u3001-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\x{20000}-\x{3FFFF}"
# Common letters first: a run of them is told by two ranges, not by all of the sets above.
TOKEN = rf"(?:[!-~\u00A1-\u024F]++|[^{SPACE}{LONE}])++|[{LONE}]"


def tokens_of(text: Column) -> Column:
    """Words between white space, and single characters of scripts without spaces; at least 1 (an empty text is one token: its end)."""
    return F.greatest(F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN)), F.lit(1)).cast("long")


def _unit(*parts) -> Column:
    """A uniform number in [0, 1) from a hash, the same whenever it is computed."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def bisect_exponent(sources: DataFrame, measure, target: float) -> float:
    """The exponent in [0, 1] where ``measure`` (falling in it) meets ``target``.

    ``measure(sums)`` is given sum(s^a), sum(s^a ln s), max(s^(a-1)) and max(s) as
    columns of one aggregate.  Ends of the interval are returned if the target
    lies beyond them.
    """
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        tried = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        row = sources.agg(*[measure(F.lit(a)).alias(f"m{i}") for i, a in enumerate(tried)]).first()
        values = [row[f"m{i}"] for i in range(GRID)]
        above = [i for i, v in enumerate(values) if v is not None and v > target]
        if not above:
            return lo
        i = max(above)
        if i == GRID - 1:
            return hi
        lo, hi = tried[i], tried[i + 1]
    return hi


def weights(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 1.5, budget: int | None = None,
            source_col: str = "source") -> DataFrame:
    """One row per source: source, tokens, share, weight, budget, repeats.

    ``entropy`` (nats) or ``max_repeats`` sets the exponent; give one of them.
    budget None: the smallest total that takes every source at least once.
    A null source is a source of its own.
    """
    return _weights(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_of(F.col("text"))).alias("tokens")), entropy, max_repeats, budget)


def _weights(counted: DataFrame, entropy: float | None, max_repeats: float | None, budget: int | None) -> DataFrame:
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    counted = stored(counted, "sources")
    total = counted.agg(F.sum("tokens")).first()[0]
    if not total:
        return counted.selectExpr("source", "tokens", "0D as share", "0D as weight", "0D as budget", "0D as repeats")
    table = counted.withColumn("share", F.col("tokens") / F.lit(float(total)))
    s = F.col("share")
    if entropy is not None:
        def measure(a):
            z = F.sum(F.pow(s, a))
            return F.log(z) - a * F.sum(F.pow(s, a) * F.log(s)) / z
        target = entropy
    elif budget is None:
        # The largest source is taken once; another one is repeated (share / largest) ^ (a - 1) times.
        def measure(a):
            return F.max(F.pow(s, a - 1)) / F.min(F.pow(s, a - 1))
        target = max_repeats
    else:
        def measure(a):
            return F.max(F.pow(s, a - 1)) * F.lit(budget / float(total)) / F.sum(F.pow(s, a))
        target = max_repeats
    a = bisect_exponent(table, measure, target)
    sums = table.agg(F.sum(F.pow(s, F.lit(a))).alias("z"), F.max(s / F.pow(s, F.lit(a))).alias("most")).first()
    table = table.withColumn("weight", F.pow(s, F.lit(a)) / F.lit(sums["z"]))
    whole = float(budget) if budget is not None else float(total) * sums["most"] * sums["z"]
    table = table.withColumn("budget", F.col("weight") * F.lit(whole))
    return table.withColumn("repeats", F.col("budget") / F.col("tokens")).select("source", "tokens", "share", "weight", "budget", "repeats")


def block_tokens(docs: DataFrame, key: list[str], seed: int, source_col: str) -> DataFrame:
    """(source, block, t): the tokens of every block, the one pass over the texts that weights and cuts need."""
    blocks = docs.select(F.col(source_col).alias("source"), tokens_of(F.col("text")).alias("t"), _block(key, seed).alias("block"))
    return stored(blocks.groupBy("source", "block").agg(F.sum("t").alias("t")), "blocks")


def plan(blocks: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """``table`` with whole (epochs taken in full) and cut: blocks of the next epoch up to it are taken too."""
    table = stored(table.withColumn("whole", F.floor(F.col("repeats") + 1e-9)), "mixture")
    joined = blocks.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    place = _unit(F.lit(seed + 1), "source", "block", "whole")
    run = Window.partitionBy("source").orderBy("place", "block")  # at most BLOCKS rows a source
    ranked = joined.withColumn("place", place).withColumn("upto", F.sum("t").over(run) - F.col("t"))
    left = F.col("budget") - F.col("whole") * F.col("tokens")
    cuts = (ranked.filter((F.col("upto") + F.col("t") / 2 < left)).groupBy("source").agg(F.max("place").alias("cut")))
    return stored(table.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
                  .select("source", "whole", F.coalesce("cut", F.lit(-1.0)).alias("cut")), "cuts")


def _block(key: list[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(BLOCKS))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 1.5, budget: int | None = None,
        source_col: str = "source", seed: int = 3, copies_col: str = "_copies") -> DataFrame:
    """``docs`` with how often each row is taken, ``copies_col`` (0: not at all).

    Every source's tokens come to its budget within half a block (a 256th of the
    source).  With the default budget every row is taken at least once.  Null
    texts count one token; repeated rows (same doc_id and text) fall into one
    block; a null source is a source of its own; other columns pass through, a
    column named ``copies_col`` is an error; an empty table gives none.
    """
    if copies_col in docs.columns:
        raise ValueError(f"a column {copies_col!r} is there already; choose another name")
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    blocks = block_tokens(docs, key, seed, source_col)
    table = _weights(blocks.groupBy("source").agg(F.sum("t").alias("tokens")), entropy, max_repeats, budget)
    cuts = plan(blocks, table, seed).withColumnsRenamed({"source": "_m_source", "whole": "_m_whole", "cut": "_m_cut"})
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    taken = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("_m_source")), "left")
    place = _unit(F.lit(seed + 1), F.col(source_col), _block(key, seed), F.col("_m_whole"))
    copies = F.coalesce(F.col("_m_whole") + (place <= F.col("_m_cut")).cast("long"), F.lit(0)).cast("int")
    return taken.select(*docs.columns, copies.alias(copies_col))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``mix`` takes it, its own columns only."""
    taken = mix(docs, **options)
    copies = options.get("copies_col", "_copies")
    return taken.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)
