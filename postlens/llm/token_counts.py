"""Token counts of a byte-level BPE by rank-synchronous array merging.

The texts of a batch are cut into pre-tokens; all distinct new pre-tokens of
the batch are held as one ragged array of symbols.  Every round finds each
sequence's pair of lowest rank and merges it in all sequences at the same
time, until no sequence has a pair left; the symbols that survive are its
tokens.  Counts of pre-tokens seen before are kept in a bounded dictionary.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.common import doc_texts, remembered

NO_RANK = np.int32(2**31 - 1)
# White space runs begin here; Python's \s holds every space of the tokenizer.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
RUN = re.compile(r"\s\s")


class RankMerger:
    """The merges of one tokenizer file as sorted arrays, merged in rank order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], pre["add_prefix_space"], spec["normalizer"]) != ("BPE", "ByteLevel", False, None):
            raise ValueError("expected a byte-level BPE without prefix space or normalizer")
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or RUN.search(t["content"]) or " " in t["content"]:
                raise ValueError(f"added token {t['content']!r} is not a plain string")
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        vocab = model["vocab"]
        self.base = np.full(max(map(ord, (c for c in vocab if len(c) == 1))) + 1, -1, np.int64)
        for c, i in vocab.items():
            if len(c) == 1:
                self.base[ord(c)] = i
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token (in the byte-level alphabet, none empty)."""
        out = np.zeros(len(pieces), np.int64)
        if not pieces:
            return out
        sym = self.base[np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)]
        seq = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(sym), NO_RANK, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            size = np.diff(starts, append=len(sym))
            low = np.minimum.reduceat(rank, starts)
            done = low == NO_RANK
            out[seq[starts[done]]] = size[done]
            low = np.repeat(low, size)
            hit = (rank == low) & (low != NO_RANK)
            # In a run of the same pair (a a a) only every second place can merge.
            first = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(sym))
            run_start = np.maximum.accumulate(np.where(first, place, -1))
            hit &= (place - run_start) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.result[rank[at]]
            stay = low != NO_RANK
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, seq, rank, at = sym[stay], seq[stay], rank[stay], moved[at]
            if not len(sym):
                break
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            redo = np.flatnonzero(near)
            nxt = np.minimum(redo + 1, len(sym) - 1)
            pair = (redo + 1 < len(sym)) & (seq[redo] == seq[nxt])
            rank[redo] = np.where(pair, self._rank(sym[redo], sym[nxt]), NO_RANK)
        return out


class Known(dict):
    """Counts of text parts; what is not there yet counts 0 and is noted in ``missed``."""

    def __init__(self):
        super().__init__({"": 0})
        self.missed: list[str] = []

    def __missing__(self, part: str) -> int:
        self.missed.append(part)
        return 0


class TokenCounter:
    """Token counts of texts; remembers the counts of up to ``keep`` text parts and pre-tokens."""

    def __init__(self, path: str, keep: int = 1_000_000, batch_chars: int = 4_000_000):
        self.merger, self.keep, self.batch_chars = RankMerger(path), keep, batch_chars
        # Parts with a space before them are kept without it.
        self.plain, self.spaced = Known(), Known()
        self.pieces: dict[str, int] = {}
        self.letters: dict[str, str] = {}
        self.space = self._pre(" a")[0][:-1]

    def _pre(self, text: str) -> list[str]:
        return [p for p, _ in self.merger.pre.pre_tokenize_str(text)]

    def _add(self, text: str) -> int:
        """Known tokens of a text without special strings; unknown parts are noted.

        A part holds whole pre-tokens: it ends where a run of white space begins.
        A single space goes with what follows; a newline between two other
        characters is a pre-token of its own.
        """
        plain, spaced = self.plain, self.spaced
        if RUN.search(text):
            return sum(map(plain.__getitem__, CUT.split(text)))
        n = 0
        for i, line in enumerate(text.split("\n")):
            if i:
                n += plain["\n"]
            parts = line.split(" ")
            n += plain[parts[0]]
            if len(parts) > 1:
                if parts[-1] == "":  # a space at the end is a part of its own
                    n += plain[" "]
                n += sum(map(spaced.__getitem__, parts[1:]))
        return n

    def _word(self, part: str) -> str | None:
        """The byte-level form of a part that is one run of Latin letters, else None."""
        if part.isascii():
            return part if part.isalpha() else None
        if not part.isalpha() or max(part) >= "\u0250":
            return None
        for c in part:
            if c not in self.letters:
                self.letters[c] = "".join(self._pre(c))
        return "".join(map(self.letters.__getitem__, part))

    def _split(self, part: str, space: bool) -> list[str]:
        """The pre-tokens of a part; letters and a closing full stop or comma are pre-tokens of their own."""
        head = self.space if space else ""
        if (word := self._word(part)) is not None:
            return [head + word]
        if part[-1] in ",." and (word := self._word(part[:-1])) is not None and word:
            return [head + word, part[-1]]
        return self._pre(" " + part if space else part)

    def _learn(self) -> None:
        """Count the noted parts: all their new pre-tokens are merged together."""
        split = [[(x, self._split(x, space)) for x in dict.fromkeys(of.missed)] for of, space in ((self.plain, False), (self.spaced, True))]
        new = list(dict.fromkeys(p for parts in split for _, s in parts for p in s if p not in self.pieces))
        self.pieces.update(zip(new, self.merger.counts(new).tolist()))
        count = self.pieces.__getitem__
        for of, parts in zip((self.plain, self.spaced), split):
            of.update((x, sum(map(count, s))) for x, s in parts)

    def _some(self, texts: list[str]) -> list[int]:
        out, missed = [], []
        plain, spaced, special = self.plain, self.spaced, self.merger.special
        for text in texts:
            before = len(plain.missed), len(spaced.missed)
            if special and (found := special.findall(text)):
                n = len(found) + sum(map(self._add, special.split(text)))
            else:
                n = self._add(text)
            out.append(n)
            missed.append((slice(before[0], len(plain.missed)), slice(before[1], len(spaced.missed))))
        self._learn()
        for i, (p, q) in enumerate(missed):
            out[i] += sum(map(plain.__getitem__, plain.missed[p])) + sum(map(spaced.__getitem__, spaced.missed[q]))
        plain.missed, spaced.missed = [], []
        if len(plain) + len(spaced) > self.keep:
            self.plain, self.spaced = Known(), Known()
        if len(self.pieces) > self.keep:
            self.pieces = {}
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out, lo, size = [], 0, 0
        for hi, text in enumerate(texts):
            size += len(text)
            if size >= self.batch_chars:
                out += self._some(texts[lo:hi + 1])
                lo, size = hi + 1, 0
        return out + self._some(texts[lo:])


def shared_counter(path: str) -> TokenCounter:
    """One counter for all tasks that a Python worker runs."""
    return remembered(("counter", path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    n_tokens: tokens of the whole text as the file ``tokenizer`` (a byte-level
    BPE for the tokenizers library) gives them, without added begin or end
    tokens; a special token's string inside a text is that one token, as the
    library does by default.  over_limit: n_tokens > limit.  A null text counts
    as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives none.
    The file must lie under the same path on every executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(tokenizer)
        for b in batches:
            raw = b.column(1)
            n = np.array(counter.counts(raw.to_pylist()), np.int64)
            size = pa.compute.binary_length(raw).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], schema=schema)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
