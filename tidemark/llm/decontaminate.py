"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage.

For each term the index keeps a posting list: the items that hold it with their BM25 weights. Items of one length
class lie in blocks of ``BLOCK_ITEMS``, and each list has the block's largest weight. A document is cut into overlapping
passages twice as long as the class, so any item lies whole in one of them, even with a quarter more words. An item is
retrieved when its score reaches ``share`` of the score that it gives itself.

Search is block-max WAND for all results above a threshold. The terms with the least maxima of a block, as far as these
add up to no more than ``SPARED`` of its lowest threshold, cannot lift a passage above it and are skipped: their lists are not
read. The lists of a passage's other words are, and only where their maxima reach what is then still needed are the
block's items scored.

Retrieved items are verified: ``overlap`` of the question and of the answer (its last sentence, or the
last third of its words) must stand in the passage. What stands there is the larger of two shares: that of the five-word
shingles, which lets sentences move, and that of the words less the edits of the best alignment, which lets single words be
replaced, left out or put in. Parts shorter than five words are aligned with the words next to them.

Every word of every document is read. Items without words are left out; null texts match
nothing. Equal items and documents are each reported. Document frequencies and the mean length are taken over the whole
benchmark, and an item's passages follow from its own length, so scores do not depend on how items are
grouped. The index is built in shards of at most ``SHARD_ITEMS`` items, one after the other, so what a task
holds is bounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_value, released, require
from tidemark.plans.stage import stored

SHARD_ITEMS = 4096
BLOCK_ITEMS = 4
CHUNK_WORDS = 100_000
SHINGLE = 5

#: Part of a block's threshold that skipped terms may add up to.
SPARED = 0.5

#: Words of the shortest class, growth from class to class, and room for words put in.
SHORTEST, GROWTH, ROOM = 8, 1.3, 1.25

#: Parameters of BM25.
K1, B = 1.2, 0.75

# Capital letters of ASCII, and its signs that are neither letters nor digits once letters are small.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# ASCII letters folded, other ASCII signs to spaces; all else stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def shingles(words: list[bytes], width: int = SHINGLE) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Item:
    """An item's words; shingles that reach into the last sentence are the answer's, the others the question's."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.words = item_id, words_of(text)
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_of(s)]
        tail = len(words_of(sentences[-1])) if len(sentences) > 1 else max(1, len(self.words) // 3)
        self.cut = len(self.words) - tail
        self.width = min(SHINGLE, len(self.words))  # of its shingles; shorter items are one

    def shingles(self) -> tuple[set[tuple[bytes, ...]], set[tuple[bytes, ...]]]:
        every = shingles(self.words, self.width)
        question = {s for i, s in enumerate(every) if i + self.width <= self.cut}
        answer = {s for i, s in enumerate(every) if i + self.width > self.cut}
        return question or set(every), answer

    def parts(self) -> tuple[list[bytes], list[bytes]]:
        """Question and answer, of five words or more where the item has them."""
        tail = len(self.words) - self.cut
        return self.words[: max(self.cut, self.width)], self.words[-max(tail, self.width) :]

    def length(self) -> int:
        """Words of the item's class."""
        words = float(SHORTEST)
        while words < ROOM * len(self.words):
            words *= GROWTH
        return int(words)


def edits(part: np.ndarray, passage: np.ndarray) -> int:
    """Fewest words to replace, leave out or put in that turn ``part`` into some stretch of the passage."""
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for n, word in enumerate(part.tolist(), 1):
        new = np.minimum(row[:-1] + (passage != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([n], new)) - place) + place
    return int(row.min())


@dataclass
class Lists:
    """Posting lists of one length class: for each term its blocks, with the largest weight in each."""

    length: int
    begins: np.ndarray  # of each term's list, and the end of the last
    blocks: np.ndarray
    maxima: np.ndarray
    needed: np.ndarray  # what listed terms must reach in each block
    first: np.ndarray  # item of each block, and the end of the last


class Index:
    """``holding`` tells in how many of the benchmark's ``many`` items a word stands, ``mean`` their mean length."""

    def __init__(self, items: list[Item], share: float, holding: dict[bytes, int], many: int, mean: float):
        self.items = sorted(items, key=lambda i: (i.length(), i.words, i.item_id))
        self.terms = {w: n for n, w in enumerate(sorted({w for i in self.items for w in i.words}))}
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []  # terms and weights of each item
        for item in self.items:
            counts = Counter(item.words)
            own = sorted(counts)
            idf = [math.log(1 + (many - holding[w] + 0.5) / (holding[w] + 0.5)) for w in own]
            saved = [counts[w] * (K1 + 1) / (counts[w] + K1 * (1 - B + B * len(item.words) / mean)) for w in own]
            self.weights.append((np.array([self.terms[w] for w in own]), np.array(idf) * np.array(saved)))
        self.enough = [share * float(w.sum()) * (1 - 1e-9) for _, w in self.weights]
        # The terms of all items, one after the other, and where each item's begin.
        self.flat = np.concatenate([t for t, _ in self.weights])
        self.gains = np.concatenate([w for _, w in self.weights])
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t, _ in self.weights])))
        self.lists = []
        lengths = [i.length() for i in self.items]
        for length in sorted(set(lengths)):
            first, end = lengths.index(length), len(lengths) - lengths[::-1].index(length)
            self.lists.append(self._listed(length, [*range(first, end, BLOCK_ITEMS), end]))

    def _listed(self, length: int, first: list[int]) -> Lists:
        rows, needed = [], []
        for block, (begin, end) in enumerate(zip(first, first[1:])):
            top: dict[int, float] = {}
            for terms, weights in self.weights[begin:end]:
                for t, w in zip(terms.tolist(), weights.tolist()):
                    top[t] = max(top.get(t, 0.0), w)
            lowest, skipped = min(self.enough[begin:end]), 0.0
            for t, w in sorted(top.items(), key=lambda x: (x[1], x[0])):
                if skipped + w <= SPARED * lowest:
                    skipped += w
                else:
                    rows.append((t, block, w))
            needed.append(lowest - skipped)
        rows.sort()
        term, blocks, maxima = (np.array(x) for x in zip(*rows))
        begins = np.searchsorted(term, np.arange(len(self.terms) + 1))
        return Lists(length, begins, blocks.astype(np.int64), maxima, np.array(needed) * (1 - 1e-9), np.array(first))

    def candidates(self, lists: Lists, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages, counted through all documents, and blocks whose listed maxima reach what the block needs.

        Known words are given by document, place in it and term; ``many`` are the passages of each document.
        """
        none = np.empty(0, np.int64)
        lengths = lists.begins[ids + 1] - lists.begins[ids]
        hit = np.flatnonzero(lengths)
        if not len(hit):
            return none, none
        n = lengths[hit]
        word = np.repeat(hit, n)
        entry = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lists.begins[ids[hit]], n)
        base, blocks = np.cumsum(many) - many, len(lists.needed)
        keys, gains = [], []
        for back in (0, 1):  # a word lies in the passage that begins in its stretch, and in the one before
            at = place[word] // lists.length - back
            inside = (at >= 0) & (at < many[doc[word]])
            w, e = word[inside], entry[inside]
            keys.append(((base[doc[w]] + at[inside]) * blocks + lists.blocks[e]) * len(self.terms) + ids[w])
            gains.append(lists.maxima[e])
        key, one = np.unique(np.concatenate(keys), return_index=True)  # repeated words count once
        pair = key // len(self.terms)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(starts):
            return none, none
        total = np.add.reduceat(np.concatenate(gains)[one], starts)
        passage, block = np.divmod(pair[starts], blocks)
        kept = total >= lists.needed[block]
        return passage[kept], block[kept]

    def search(self, docs: list[list[bytes]], overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """``(document, item_id, score, question overlap, answer overlap)`` of everything retrieved.

        Parts that lack too many words to reach ``overlap`` are not aligned.
        """
        sizes = np.array([len(d) for d in docs], np.int64)
        begins = np.cumsum(sizes) - sizes
        get = self.terms.get
        every = np.fromiter((get(w, -1) for d in docs for w in d), np.int64, int(sizes.sum()))
        known = np.flatnonzero(every >= 0)
        ids = every[known]
        doc = np.repeat(np.arange(len(docs)), sizes)[known]
        place = known - begins[doc]
        # Which terms a passage holds; the last place is for words that are no terms.
        held_terms = np.zeros(len(self.terms) + 1, bool)
        for lists in self.lists:
            # Passages start every ``length`` words of a document.
            many = np.maximum(1, -(-sizes // lists.length) - 1)
            base = np.cumsum(many) - many
            best: dict[tuple[int, int], tuple] = {}
            for passage, block in zip(*(x.tolist() for x in self.candidates(lists, doc, place, ids, many))):
                d = int(np.searchsorted(base, passage, side="right")) - 1
                low = (passage - int(base[d])) * lists.length
                here = every[begins[d] + low : min(begins[d] + low + 2 * lists.length, begins[d] + sizes[d])]
                first, end = int(lists.first[block]), int(lists.first[block + 1])
                own = slice(int(self.starts[first]), int(self.starts[end]))
                held_terms[here], held_terms[-1] = True, False
                scores = np.add.reduceat(self.gains[own] * held_terms[self.flat[own]], self.starts[first:end] - self.starts[first])
                held: dict[int, set] = {}
                for j in range(first, end):
                    score = float(scores[j - first])
                    if score < self.enough[j]:
                        continue
                    item = self.items[j]
                    if item.width not in held:
                        held[item.width] = set(shingles(docs[d][low : low + len(here)], item.width))
                    shares = [len(want & held[item.width]) / len(want) for want in item.shingles()]
                    for k, words in enumerate(item.parts()):
                        # Each word that the passage lacks is an edit.
                        part = np.array([self.terms[w] for w in words])
                        if shares[k] < held_terms[part].mean() >= overlap:
                            shares[k] = max(shares[k], (len(part) - edits(part, here)) / len(part))
                    row = (score, *shares)
                    if (d, j) not in best or (min(row[1:]), row) > (min(best[d, j][1:]), best[d, j]):
                        best[d, j] = row
                held_terms[here] = False
            for (d, j), row in best.items():
                yield d, self.items[j].item_id, *row


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, chunk, held = 0, [], 0
    for i, text in enumerate(texts):
        words = words_of(text.as_py() or "")
        if chunk and held + len(words) > CHUNK_WORDS:
            yield first, chunk
            first, chunk, held = i, [], 0
        chunk.append(words)
        held += len(words)
    if chunk:
        yield first, chunk


def _matches(index: Index, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for first, chunk in _chunks(batch.column(1)):
                out += [
                    (first + d, item, score, q, a)
                    for d, item, score, q, a in index.search(chunk, overlap)
                    if min(q, a) >= overlap
                ]
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(rows), *(pa.array([o[i] for o in out], pa.int64() if i == 1 else pa.float64()) for i in range(1, 5))],
                ["key", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return run


def _clean(index: Index, place: int, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, chunk in _chunks(batch.column(place)):
                for d, _, _, q, a in index.search(chunk, overlap):
                    if min(q, a) >= overlap:
                        keep[first + d] = False
            yield batch.filter(pa.array(keep))

    return run


def indexes(benchmark: DataFrame, share: float = 0.6) -> Iterator[Index]:
    """Index shards; each is collected on its own and holds ``SHARD_ITEMS`` items or not many more."""
    require(benchmark, "item_id", "text")
    folded = F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), SIGNS, " ")
    words = F.array_remove(F.split(folded, " "), "")
    items = benchmark.select("item_id", "text", words.alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    many, mean = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not many:
        return
    held = items.select("item_id", "text", F.explode(F.array_distinct("words")).alias("word"))
    holding = stored(held.groupBy("word").agg(F.count("*").alias("n")), "holding")
    shards = -(-many // SHARD_ITEMS)
    for shard in range(shards):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard
        rows = items.where(own).select("item_id", "text").collect()
        if rows:
            counts = held.where(own).select("word").distinct().join(holding, "word").collect()
            yield Index([Item(r.item_id, r.text) for r in rows], share, {r.word.encode(): r.n for r in counts}, many, mean)


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, overlap: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, item_id, score, question_overlap, answer_overlap`` of every item found in a document."""
    require(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    given = docs.select(F.col(key).alias("key"), F.col(text))
    out = docs.sparkSession.createDataFrame([], schema)
    for n, index in enumerate(indexes(benchmark, share)):
        found = given.mapInArrow(released(_matches(index, overlap)), schema)
        out = found if n == 0 else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, overlap: float = 0.8, text: str = "text") -> DataFrame:
    """The documents in which no item is found."""
    require(docs, text)
    for index in indexes(benchmark, share):
        docs = docs.mapInArrow(released(_clean(index, docs.columns.index(text), overlap)), docs.schema)
    return docs


by_value(__name__)
