"""Text column functions: hashtag removal, Unicode strip, tokens, stop words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s and \S Unicode-aware, as Python's str patterns are.
HASHTAG = r"(?U)#\S+"
# Words of up to so many characters are found without looking at the rest of the text.
_TAG_CHARS = 256
# Whitespace as Python's str.strip() sees it: every code point below U+3001
# for which str.isspace() holds (none above it).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
ANY_SPACE = r"(?U)\s+"
LETTER_RUN = r"(\p{L}+)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_hashtags(c: Column | str) -> Column:
    """Drop every '#word' run ('#' and at least one character up to the next white space).

    The text is cut at its '#' and each piece loses its leading word: one plain
    scan, where replacing ``HASHTAG`` by a regular expression takes three times as
    long.  A '#' before a blank or at the very end is no tag and stays, unless
    it belongs to a run that began before it.
    """
    def tail(p: Column) -> Column:
        word = F.length(F.regexp_extract(F.left(p, F.lit(_TAG_CHARS)), r"^(?U)\S*", 0))
        word = F.when((word == _TAG_CHARS) & (F.length(p) > _TAG_CHARS), F.length(F.regexp_extract(p, r"^(?U)\S*", 0))).otherwise(word)
        return F.substr(p, word + 1)

    def piece(ps: Column, p: Column, i: Column) -> Column:
        last = i == F.size(ps) - 1
        in_run = (i > 1) & ~ps[F.greatest(i - 1, F.lit(0))].rlike(r"(?U)\s")
        return (F.when(i == 0, p).when(F.left(p, F.lit(1)).rlike(r"(?U)\S"), tail(p)).when((p == "") & ~last, F.lit(""))
                .when(in_run, p).otherwise(F.concat(F.lit("#"), p)))

    once = F.array(F.split(_c(c), "#", -1))  # bound to a variable, so that it is computed once
    return F.transform(once, lambda ps: F.array_join(F.transform(ps, lambda p, i: piece(ps, p, i)), ""))[0]


def strip_space(c: Column | str) -> Column:
    """Strip leading and trailing Unicode whitespace.

    ``trim`` with an explicit character set is a plain scan from both ends; a
    regular expression ('^\\s+|\\s+$') retries at every inner run of spaces.
    """
    return F.trim(_c(c), F.lit(WHITESPACE))


def clean_text(c: Column | str) -> Column:
    """J1 then J2: the stored form of a post's text."""
    return strip_space(remove_hashtags(c))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters of a whole text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(LETTER_RUN), 1)


def display_text(c: Column | str) -> Column:
    """Strip, HTML-escape, newline to <br>."""
    t = strip_space(c)
    t = F.replace(t, F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    t = F.replace(t, F.lit(">"), F.lit("&gt;"))
    return F.replace(t, F.lit("\n"), F.lit("<br>"))


def drop_stop_words(arr: Column | str, stop: Column) -> Column:
    """Remove stop words from a list; order and repeats are kept.

    ``stop`` is an array column (a literal array or a column).  array_except
    would also drop repeats, so a filter is used.
    """
    return F.filter(_c(arr), lambda x: ~F.coalesce(F.array_contains(stop, x), F.lit(False)))


def drop_stop_words_text(text: Column | str, stop: Column) -> Column:
    """Split on whitespace, drop stop words, rejoin with one space."""
    t = strip_space(text)
    parts = F.filter(F.split(t, ANY_SPACE), lambda x: F.length(x) > 0)
    return F.array_join(drop_stop_words(parts, stop), " ")


def literal_array(values: Iterable[str]) -> Column:
    vals = sorted(set(v for v in values if v is not None))
    if not vals:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in vals])


def json_span(c: Column | str) -> Column:
    """First '{' to last '}' of a free-text response ('' if none)."""
    return F.regexp_extract(_c(c), r"(?s)\{.*\}", 0)


def undouble_braces(c: Column | str) -> Column:
    """J11: '{{' -> '{' then '}}' -> '}'."""
    return F.replace(F.replace(_c(c), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
