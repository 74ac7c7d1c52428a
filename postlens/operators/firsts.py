"""First row per key without sorting rows.

Whole rows are never aggregated, sorted or written.  A narrow pass packs, for each
row, a 16-byte digest of the key, the order in one decimal and a hash of the
whole row: fixed-width values, which Spark aggregates by hashing.  The winners'
orders then pick their rows from the input by a semi-join.  An order that
belongs to one row only names that row, and such a semi-join reads nothing but the
order's columns, so Spark moves it below the joins that bring the wide
columns: rows that do not win are gone before their texts are met, however many
win.  Orders that several rows share (counted) are told apart by the row's hash, after
the same first step.  The winners' side is broadcast if it is short (counted),
otherwise the join is a shuffled hash join, which builds on it and does not
sort.  A key that a third of all rows share is reduced inside each task before it is shuffled.

The input is read twice, so it must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.ingest import row_digest
from postlens.sources.work import work_table

# At most so many winners, of 24 bytes, are sent to every task.
BROADCAST_ROWS = 500_000

_TIME_DIGITS, _ID_DIGITS = 18, 20
_TIME_SHIFT = 70_000_000_000_000_000  # microseconds of year 0 are above its negative
_LAST = Decimal(10) ** _TIME_DIGITS - 1


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a wall time, whatever the session's zone."""
    t = t.cast("timestamp_ntz")
    minutes = (F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def packed_order(time: Column | None, number: Column | None) -> Column:
    """Time, then number, as one decimal(38); null times and numbers come last."""
    out = F.lit(Decimal(0)).cast("decimal(38,0)")
    if time is not None:
        out = F.coalesce((micros(time) + F.lit(_TIME_SHIFT)).cast(f"decimal({_TIME_DIGITS},0)"), F.lit(_LAST).cast(f"decimal({_TIME_DIGITS},0)"))
        out = (out * F.lit(Decimal(10) ** _ID_DIGITS).cast("decimal(21,0)")).cast("decimal(38,0)")
    if number is not None:
        shifted = number.cast("decimal(20,0)") + F.lit(Decimal(2) ** 63).cast("decimal(20,0)")
        out = out + F.coalesce(shifted, F.lit(Decimal(2) ** 64).cast("decimal(21,0)"))
    return F.coalesce(out.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))  # never null: joins need no filter on it


def text_digest(text: Column) -> Column:
    """16 bytes of one text, another value for a null; the text is computed once."""
    return F.unhex(F.coalesce(F.md5(text), F.lit("00")))


def narrow_keys(marked: DataFrame, key: Column | Sequence[str]) -> DataFrame:
    """(_key, _order, _tie, _n): repeats are counted inside each task before they are shuffled."""
    digest = key if isinstance(key, Column) else F.unhex(row_digest(key))
    return marked.select(digest.alias("_key"), "_order", "_tie").groupBy("_key", "_order", "_tie").agg(F.count(F.lit(1)).alias("_n"))


def first_rows(df: DataFrame, key: Column | Sequence[str], order: Column) -> DataFrame:
    """The row of least ``order`` (see ``packed_order``) per ``key`` (a digest, or columns; nulls equal).

    Ties are settled by a hash of the whole row; of identical rows one stays.
    """
    marked = df.withColumns({"_order": order, "_tie": F.xxhash64(*df.columns)})
    ties = work_table(narrow_keys(marked, key), "keys")  # read twice: keys cost a pass over the texts
    first = work_table(ties.groupBy("_key").agg(F.min("_order").alias("_order")), "firsts")
    shared = work_table(ties.groupBy("_order").agg(F.sum("_n").alias("_rows")).filter("_rows > 1").select("_order"), "shared-orders")

    def rows_of(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
        if some.count() <= BROADCAST_ROWS:
            return rows.join(some.select(*on).hint("broadcast"), on, "left_semi")
        if on == ["_order"]:  # a filter, which Spark moves below projections and joins (a semi-join over computed columns stays)
            return rows.filter(F.col("_order").isin(some.select("_order").hint("shuffle_hash")))
        return rows.join(some.select(*on).hint("shuffle_hash"), on, "left_semi")

    if shared.isEmpty():
        return rows_of(marked, first, ["_order"]).select(*df.columns)
    alone = rows_of(marked, work_table(first.join(shared, "_order", "left_anti"), "alone"), ["_order"]).select(*df.columns)
    least = (ties.join(shared, "_order", "left_semi").join(first, ["_key", "_order"]).groupBy("_key", "_order")
             .agg(F.min("_tie").alias("_tie"), F.max("_n").alias("_n")))
    tied = work_table(least.select("_order", "_tie", "_n"), "tied")
    near = rows_of(marked, tied, ["_order"])  # by the order alone first, see above
    seldom, often = tied.filter("_n = 1"), tied.filter("_n > 1")
    out = alone.union(rows_of(near, seldom, ["_order", "_tie"]).select(*df.columns))
    if often.isEmpty():
        return out
    return out.union(rows_of(near, often, ["_order", "_tie"]).select(*df.columns).distinct())
