"""Token counts of byte-level pair merging, many pre-tokens at once.

A text is cut at the special strings of the vocabulary, each of which is one token, and the rest
into pre-tokens. The bytes of all pre-tokens that a task has not met yet lie in one ragged array.
In every round each pre-token merges all places of its own lowest-rank pair at the same time, until
no pair has a rank; what survives are its tokens. A pair made by a merge always ranks below that
merge, so merging all places of a pair at once gives what merging them one by one gives. Of
overlapping places (three equal symbols in a row) the left one is taken.

Only counts of pre-tokens are remembered, at most ``KNOWN`` of them in a task. Texts are read in
pieces of ``PIECE`` pre-tokens, so the length of a text bounds nothing. The vocabulary travels
inside the task, so executors need no file.

Null and empty texts have no bytes and no tokens. Rows with null or repeated ids are all counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_value, require

# How byte-level vocabularies cut a text, and which characters they print bytes as.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED_AS_THEMSELVES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

#: Pre-tokens a task remembers, pre-tokens read at once, bytes merged at once.
KNOWN = 400_000
PIECE = 200_000
RAGGED = 1 << 20

NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Symbols of the 256 bytes, and the merges in order of rank."""

    of_byte: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    special: list[str]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The vocabulary of a ``.json`` file; refuses what this module does not count exactly."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut, added = told["model"], told["pre_tokenizer"] or {}, told["added_tokens"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if told["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in plain):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: pre-tokens are cut in another way")
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: special strings with conditions")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        column = lambda values: np.array(list(values), np.int64)
        return cls(
            column(ids[c] for c in printed_bytes()),
            column(ids[a] for a, _ in pairs),
            column(ids[b] for _, b in pairs),
            column(ids[a + b] for a, b in pairs),
            sorted((a["content"] for a in added), key=len, reverse=True),
        )


def printed_bytes() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = {b for low, high in PRINTED_AS_THEMSELVES for b in range(low, high + 1)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Merger:
    """Counts the symbols that survive in each of many byte strings."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.of_byte, self.made = v.of_byte, v.made
        self.wide = int(max(v.of_byte.max(), v.left.max(initial=0), v.right.max(initial=0), v.made.max(initial=0))) + 1
        keys = v.left * self.wide + v.right
        # Of a pair named twice the later rank holds, as in a map that is filled in order.
        order = np.lexsort((np.arange(len(keys)), keys))
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][last], order[last].astype(np.int32)
        a, b = np.divmod(np.arange(65536), 256)
        self.first = self.rank(self.of_byte[a], self.of_byte[b])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word, none of which is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.of_byte[data]
        # The rank of the pair that begins at each place; a word's last place begins none.
        rank = np.full(len(data), NONE)
        rank[:-1] = self.first[data[:-1].astype(np.int64) * 256 + data[1:]]
        rank[np.cumsum(sizes) - 1] = NONE
        word = np.arange(len(words))
        while len(word):
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            busy = best < NONE
            if not busy.all():
                stay = np.repeat(busy, sizes)
                symbol, rank, word, sizes, best = symbol[stay], rank[stay], word[busy], sizes[busy], best[busy]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Only a pair of equal symbols overlaps itself: every second place of such a run is taken.
            follows = np.flatnonzero(np.diff(hit, prepend=-2) == 1)
            if len(follows):
                heads = np.ones(len(hit), bool)
                heads[follows] = False
                begin = np.maximum.accumulate(np.where(heads, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            owner = np.searchsorted(np.cumsum(sizes), hit, side="right")
            symbol[hit] = self.made[rank[hit]]
            rest = np.ones(len(symbol), bool)
            rest[hit + 1] = False
            # A merged pair begins the pair that its right half began, if any.
            open_end = rank[hit + 1] == NONE
            ends = hit + 1 == np.cumsum(sizes)[owner] - 1
            rank[hit] = np.where(open_end & ends, NONE, 0)
            symbol, rank = symbol[rest], rank[rest]
            at = hit - np.arange(len(hit))
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            lasts = np.cumsum(sizes) - 1
            inner = at[~ends]
            rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
            firsts = np.zeros(len(symbol), bool)
            firsts[lasts - sizes + 1] = True
            before = at[~firsts[at]] - 1
            rank[before] = self.rank(symbol[before], symbol[before + 1])
            out[word] = sizes
        return out


class TokenCounter:
    """Token counts of texts; made once in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger = Merger(vocabulary)
        self.cut = regex.compile(PRETOKEN)
        marks = "|".join(map(regex.escape, vocabulary.special))
        self.marks = regex.compile(marks) if marks else None
        self.forget()

    def forget(self) -> None:
        fresh: list[str] = []

        class Places(dict):
            def __missing__(self, word):
                self[word] = place = len(self)
                fresh.append(word)
                return place

        self.fresh, self.places, self.counts = fresh, Places(), np.empty(1024, np.int64)

    def tokens(self, words: list[str]) -> np.ndarray:
        """The count of each pre-token."""
        if len(self.places) > KNOWN:
            self.forget()
        had = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if self.fresh:
            now = len(self.places)
            if now > len(self.counts):
                self.counts = np.concatenate((self.counts[:had], np.empty(2 * now - had, np.int64)))
            group, held, done = [], 0, had
            for word in self.fresh:
                data = word.encode()
                if group and held + len(data) > RAGGED:
                    self.counts[done : done + len(group)] = self.merger.count(group)
                    done, group, held = done + len(group), [], 0
                group.append(data)
                held += len(data)
            self.counts[done:now] = self.merger.count(group)
            self.fresh.clear()
        return self.counts[at]

    def pieces(self, text: str) -> Iterator[str]:
        """All pre-tokens between special strings."""
        start = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            if start < mark.start():
                yield from self.cut.findall(text[start : mark.start()])
            start = mark.end()
        if start == 0 and len(text) < PIECE:
            yield from self.cut.findall(text)
        elif start < len(text):
            yield from (m.group() for m in self.cut.finditer(text, start))

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []  # text and how many pre-tokens of ``held`` are its own

        def settle() -> None:
            if held:
                many = np.array([n for _, n in owners])
                np.add.at(out, [i for i, _ in owners], np.add.reduceat(self.tokens(held), np.cumsum(many) - many))
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.marks:
                out[i] = sum(1 for _ in self.marks.finditer(text))
            pieces = self.pieces(text)
            while part := list(islice(pieces, PIECE)):
                held += part
                owners.append((i, len(part)))
                if len(held) >= PIECE:
                    settle()
        settle()
        return out


def _count(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter.of(batch.column(2).to_pylist()), pa.int64())],
                ["key", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every document."""
    require(docs, key, text)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), size.alias("n_bytes"), F.col(text).alias("text"))
    counted = given.mapInArrow(_count(vocabulary), f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


by_value(__name__)
