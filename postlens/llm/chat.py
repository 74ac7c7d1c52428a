"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations.  Per conversation, in sequence order:

* ``delta``       streamed text, appended to the message ``turn``;
* ``edit``        replaces everything the message held before;
* ``regenerate``  discards what the message held before; later deltas make
                  its new text, and all later turns that exist are withdrawn
                  (they answered the old text).

The fold needs no loop: with the events of a message sorted, its text is the
concatenation of everything from its last ``edit`` on, or after its last
``regenerate``; an event is undone if an earlier turn was regenerated after it.
Both are window aggregates.

Template: each message is ``<turn:ROLE>text</turn>`` followed by a newline.
Inside roles and texts ``\\``, ``<`` and ``>`` are written ``\\b``, ``\\l`` and
``\\g``, so no text can look like a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(c: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Inverse of escape: every backslash left is followed by its own letter."""
    for raw, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def events_of(conversations: DataFrame) -> DataFrame:
    """A log with one delta per stored message (conv_id, turn, role, text).

    Repeated turns of a conversation are messages of their own, in the order
    of role and text; a null turn comes first, a null conversation is one.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                                F.row_number().over(w).cast("long").alias("seq")).select(
        "conv_id", "seq", F.col("seq").alias("turn"), F.lit("delta").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    turn and seq are whole numbers.  role: the last one named by the message's
    events (null if none names any).  A null turn is a message of its own.
    Null texts are empty.  Ties of seq are ordered by kind and text.  Events of an
    unknown or null kind raise no error and add nothing.  A conversation with
    no message left is absent.
    """
    kind = F.col("kind")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    known = (events.filter(kind.isin("delta", "edit", "regenerate"))
             .withColumn("undone", F.max(F.when(kind == "regenerate", F.col("seq"))).over(earlier))
             .filter("undone is null or seq >= undone"))
    newest = Window.partitionBy("conv_id", "turn").orderBy(F.desc("seq"), F.desc("kind"), F.desc("text"))
    behind = newest.rowsBetween(Window.unboundedPreceding, -1)
    live = (known.withColumn("cut_after", F.coalesce(F.max(kind.isin("edit", "regenerate").cast("int")).over(behind), F.lit(0)))
            .withColumn("last_role", F.first("role", ignorenulls=True).over(
                newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    adds = (F.col("cut_after") == 0) & kind.isin("delta", "edit")
    messages = live.groupBy("conv_id", "turn").agg(
        F.first("last_role").alias("role"),
        F.sort_array(F.collect_list(F.when(adds, F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))).alias("adds"))
    return messages.select("conv_id", "turn", "role", F.array_join(F.transform("adds", lambda a: a["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    formatted: the messages in turn order in the template above.  loss_spans:
    an array of (begin, length), 0-based code points of ``formatted``: the
    escaped text of each ``loss_role`` message, in order.  Null roles and texts
    are empty.  A conversation is one output row and has to fit in one.
    """
    head = F.concat(F.lit("<turn:"), escape(F.coalesce("role", F.lit(""))), F.lit(">"))
    body = escape(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (messages.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
            .withColumn("place", F.row_number().over(w))
            .withColumn("size", F.length("head") + F.length("body") + len(END))
            .withColumn("begin", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head")))
    span = F.when(F.col("role") == loss_role, F.struct("place", F.col("begin").cast("long").alias("begin"), F.length("body").cast("long").alias("length")))
    return (rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("s")))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("spans"))
        .select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"),
                F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["length"].alias("length"))).alias("loss_spans")))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold a log and render it: see ``reconstruct`` and ``render``."""
    return render(reconstruct(events), loss_role)


def read_back(formatted: Column) -> Column:
    """The messages of a rendered conversation: array of (role, text)."""
    marks = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(marks, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len("<turn:") + 1)), ">", 1)).alias("role"),
        unescape(F.regexp_replace(p, "^<turn:[^>]*>", "")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int")))), "")
