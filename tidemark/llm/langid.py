"""Language identification by a linear-chain conditional random field over words.

Every word gets a score for each language from its character n-grams (with marks at both ends, so
prefixes and suffixes are features of their own) and from a lexicon of frequent words. Learned
transitions join the words of a text, and forward-backward gives each word's probabilities, so
code-switched text is labelled word by word. A document's language is the one with the highest
mean probability, and that mean is its score.

The field is fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled documents of each
language and ``SAMPLE_WORDS`` consecutive words of each. Training sequences join pieces of several
documents, so the transitions learn what a switch costs. Predictions read whole texts.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row is
labelled. Equal texts get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, by_value, released, require

#: Bounds of the training sample.
PER_LANGUAGE = 400
SAMPLE_WORDS = 240

#: Rows of the n-gram table, lexicon words of a language, length and number of training sequences.
TABLE_ROWS = 1 << 16
LEXICON = 300
SEQUENCE = 32
SEQUENCES = 2000
STEPS = 120
BATCH = 250

#: Words of full clearness that every text is given, so that short ones are not judged by a word or two.
TRUST = 5

#: Words decoded together, and words whose scores a task remembers.
CHUNK_WORDS = 150_000
CACHE_WORDS = 100_000
#: New words whose n-grams are looked up together.
WORDS_AT_ONCE = 10_000

UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # TABLE_ROWS + 1 rows of n-grams (the last is zero), then one row for each lexicon word
    lexicon: dict[bytes, int]
    start: np.ndarray
    moves: np.ndarray


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for all words, and where each word's rows begin."""
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03\x00\x00\x00", np.uint8).astype(np.uint32)
    n = len(data) - 3
    # Words may hold the marks themselves, so their ends come from their lengths.
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    # An n-gram that would run past its word's end mark is the empty row.
    left = np.repeat(ends, ends - begins + 1) - np.arange(n)
    code = data[:n].copy()
    rows = np.empty((n, 3), np.int64)
    for i in range(3):
        code = code * np.uint32(0x01000193) ^ data[i + 1 : n + i + 1]
        mixed = (code ^ np.uint32(i * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        rows[:, i] = np.where(left > i, mixed >> np.uint32(16), TABLE_ROWS)
    return rows.ravel(), begins * 3


def emissions(model: Model, words: list[bytes]) -> np.ndarray:
    """A row of scores for each word."""
    rows, begins = grams(words)
    scores = np.add.reduceat(model.weights[rows], begins, axis=0)
    known = np.fromiter((model.lexicon.get(w, TABLE_ROWS) for w in words), np.int64, len(words))
    return scores + model.weights[known]


def chain(scores: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Forward-backward over equally long sequences, ``scores[t, s, label]``.

    Returns the probabilities of labels, of moves (summed), and the log-likelihood's normaliser.
    """
    steps, many, n = scores.shape
    top = scores.max(axis=2, keepdims=True)
    seen = np.exp(scores - top)
    go, first = np.exp(moves), np.exp(start)
    ahead, back = np.empty_like(seen), np.ones_like(seen)
    scale = np.empty((steps, many, 1))
    for t in range(steps):
        ahead[t] = (first if t == 0 else ahead[t - 1] @ go) * seen[t]
        scale[t] = ahead[t].sum(axis=1, keepdims=True)
        ahead[t] /= scale[t]
    for t in range(steps - 2, -1, -1):
        back[t] = (seen[t + 1] * back[t + 1]) @ go.T / scale[t + 1]
    both = np.einsum("tsi,tsj->ij", ahead[:-1], seen[1:] * back[1:] / scale[1:]) * go
    return ahead * back, both, np.log(scale).sum() + top.sum()


def fit(texts: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """The field from ``(language, words)`` pairs."""
    labels = sorted({lang for lang, _ in texts})
    rng = np.random.default_rng(seed)
    groups = [[[w.lower().encode() for w in ws] for lang, ws in texts if lang == label and ws] for label in labels]
    lexicon: dict[bytes, int] = {}
    for group in groups:
        for w, _ in Counter(w for ws in group for w in ws).most_common(LEXICON):
            lexicon.setdefault(w, TABLE_ROWS + 1 + len(lexicon))
    n = len(labels)
    size = TABLE_ROWS + 1 + len(lexicon)
    model = Model(labels, np.zeros((size, n), np.float32), lexicon, np.zeros(n), np.zeros((n, n)))
    usable = [i for i, g in enumerate(groups) if g]
    if n < 2 or not usable:
        return model
    sequences, truth = [], np.empty((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES):
        words: list[bytes] = []
        while len(words) < SEQUENCE:
            label = usable[rng.integers(len(usable))]
            ws = groups[label][rng.integers(len(groups[label]))]
            take = min(SEQUENCE - len(words), 4 + int(rng.geometric(0.05)), len(ws))
            begin = rng.integers(len(ws) - take + 1)
            truth[s, len(words) : len(words) + take] = label
            words += ws[begin : begin + take]
        sequences.append(words)
    values = [model.weights.astype(np.float64), model.start, model.moves]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    for step in range(STEPS):
        chosen = rng.integers(SEQUENCES, size=BATCH)
        flat = [w for t in range(SEQUENCE) for s in chosen for w in (sequences[s][t],)]
        rows, begins = grams(flat)
        known = np.fromiter((lexicon.get(w, TABLE_ROWS) for w in flat), np.int64, len(flat))
        scores = np.add.reduceat(values[0][rows], begins, axis=0) + values[0][known]
        p, both, _ = chain(scores.reshape(SEQUENCE, BATCH, n), values[1], values[2])
        want = np.eye(n)[truth[chosen].T]
        off = p - want
        counts = np.diff(np.append(begins, len(rows)))
        per_row = np.repeat(off.reshape(-1, n), counts, axis=0)
        slope = np.empty_like(values[0])
        for j in range(n):
            slope[:, j] = np.bincount(rows, per_row[:, j], size) + np.bincount(known, off.reshape(-1, n)[:, j], size)
        slope[TABLE_ROWS] = 0
        moved = np.einsum("tsi,tsj->ij", want[:-1], want[1:])
        for i, g in enumerate((slope, off[0].sum(axis=0), both - moved)):
            g = g / BATCH + 1e-5 * values[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            rate = 0.05 / (1 + step / 60)
            values[i] = values[i] - rate * first[i] / (1 - 0.9 ** (step + 1)) / (np.sqrt(second[i] / (1 - 0.99 ** (step + 1))) + 1e-8)
    model.weights, model.start, model.moves = values[0].astype(np.float32), values[1], values[2]
    return model


class Decoder:
    """Labels documents with a model; remembers the scores of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        fresh: list[bytes] = []

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = number = len(self)
                fresh.append(word)
                return number

        self.fresh, self.numbers = fresh, Numbers()
        self.seen = np.empty((1024, len(self.model.labels)), np.float32)
        self.lettered = np.empty(1024, bool)

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of scores for each word, whether it has a letter, and its number among the words seen."""
        if len(self.numbers) > CACHE_WORDS:
            self.forget()
        had = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.fresh:
            now = len(self.numbers)
            if now > len(self.seen):
                grown = np.empty((2 * now, self.seen.shape[1]), np.float32)
                grown[:had] = self.seen[:had]
                self.seen = grown
                self.lettered = np.concatenate((self.lettered[:had], np.empty(len(grown) - had, bool)))
            self.lettered[had:now] = [any(map(str.isalpha, w.decode())) for w in self.fresh]
            for first in range(0, len(self.fresh), WORDS_AT_ONCE):
                part = self.fresh[first : first + WORDS_AT_ONCE]
                self.seen[had + first : had + first + len(part)] = emissions(self.model, part)
            self.fresh.clear()
        return self.seen[ids], self.lettered[ids], ids

    def decode(self, docs: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Mean label probabilities of each document (longest first), its words' labels, and how clear these are."""
        n, m = len(self.model.labels), self.model
        lengths = np.array([len(d) for d in docs])
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        flat, lettered, ids = self.scores([w for d in docs for w in d])
        seen = np.exp(flat - flat.max(axis=1, keepdims=True)).astype(np.float64)
        # What a word by itself says for its best language, from 0 (nothing) to 1, whatever the number of languages.
        own = (1 / seen.sum(axis=1) - 1 / n) / max(1 - 1 / n, 1 / n) * lettered
        # A word that is said again says nothing more about the language.
        owner = np.repeat(np.arange(len(docs)), lengths)
        _, once = np.unique(owner * len(self.numbers) + ids, return_index=True)
        told, many = (np.bincount(owner[once], x[once], len(docs)) for x in (own, lettered))
        clear = (told + TRUST) / (many + TRUST)
        active = len(docs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        place = np.concatenate(([0], np.cumsum(active)))
        order = np.concatenate([begins[:k] + t for t, k in enumerate(active)])
        seen = seen[order]
        ahead = np.empty_like(seen)
        go, state = np.exp(m.moves), np.exp(m.start)
        for t, k in enumerate(active):
            here = slice(place[t], place[t] + k)
            state = (np.broadcast_to(state, (k, n)) if t == 0 else state[:k] @ go) * seen[here]
            state /= state.sum(axis=1, keepdims=True)
            ahead[here] = state
        total, back = np.zeros((len(docs), n)), np.ones((active[-1], n))
        best = np.empty(len(flat), np.int8)
        for t in range(lengths[0] - 1, -1, -1):
            k, here = active[t], slice(place[t], place[t] + active[t])
            if t < lengths[0] - 1:
                after = active[t + 1]
                came = (seen[place[t + 1] : place[t + 1] + after] * back[:after]) @ go.T
                back = np.ones((k, n))
                back[:after] = came / came.sum(axis=1, keepdims=True)
            p = ahead[here] * back
            p /= p.sum(axis=1, keepdims=True)
            total[:k] += p
            best[order[here]] = p.argmax(axis=1)
        return total / lengths[:, None], np.split(best, begins[1:]), clear


def _runs(labels: list[str], best: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(best)) + 1
    begins = np.concatenate(([0], cuts))
    return [
        {"lang": labels[best[b]], "first_word": int(b), "n_words": int(e - b)}
        for b, e in zip(begins, np.append(cuts, len(best)))
    ]


class Judge:
    """Languages and scores of arrays of texts; made once in each task."""

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model)

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, list[np.ndarray], np.ndarray]:
        """Language, score, the words' labels and clearness of each text. Texts are decoded longest first, many at once."""
        many = len(column)
        lang, score, clear = [UNKNOWN] * many, np.zeros(many), np.zeros(many)
        labels = [np.empty(0, np.int8)] * many
        chunk: list[tuple[int, list[bytes]]] = []

        def settle() -> None:
            chunk.sort(key=lambda x: -len(x[1]))
            for (i, _), mean, own, sure in zip(chunk, *self.decoder.decode([ws for _, ws in chunk])):
                top = int(mean.argmax())
                lang[i], score[i], labels[i], clear[i] = self.model.labels[top], mean[top], own, sure
            chunk.clear()

        held = 0
        # Texts are taken out one by one, so that no second copy of all of them is held.
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i in np.argsort(-size, kind="stable").tolist() if self.model.labels else ():
            text = column[i].as_py() or ""
            if not any(map(str.isalpha, text)):
                continue
            words = words_of(text)
            if chunk and held + len(words) > CHUNK_WORDS:
                settle()
                held = 0
            chunk.append((i, words))
            held += len(words)
        if chunk:
            settle()
        return lang, score, labels, clear


def _identify(model: Model, with_runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        run_kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        for batch in batches:
            lang, score, labels, _ = judge.judge(batch.column(1))
            columns, names = [batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["key", "lang_pred", "score"]
            if with_runs:
                runs = [_runs(model.labels, best) if len(best) else [] for best in labels]
                columns, names = [*columns, pa.array(runs, run_kind)], [*names, "runs"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _accept(model: Model, place: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            lang, _, _, clear = judge.judge(batch.column(place))
            yield batch.filter(pa.array([x != UNKNOWN and c >= least for x, c in zip(lang, clear)], pa.bool_()))

    return run


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on the bounded sample of ``labelled``: the first documents of each language in hash order."""
    require(labelled, text, lang, key)
    first = Window.partitionBy("lang").orderBy("order", "key")
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(key).alias("key"), F.xxhash64(F.lit("fit"), key).alias("order"), F.col(text).alias("text")
    )
    # The first in hash order lie below a share of the hashes; no text beyond it is sent.
    # One number for each language, as the model has a column for each.
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    limits = [x for r in counts for x in (F.lit(r.lang), F.lit(int((min(1.0, 4.0 * PER_LANGUAGE / r["count"]) - 0.5) * 2**63)))]
    sample = (
        usable.where(F.shiftright("order", 1) < F.element_at(F.create_map(*limits), F.col("lang")))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= PER_LANGUAGE)
        .select("lang", "place", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    )
    begin = F.when(F.size("words") > SAMPLE_WORDS, F.pmod(F.xxhash64("place"), F.size("words") - SAMPLE_WORDS) + 1).otherwise(1)
    rows = sample.select("lang", "place", F.slice("words", begin.cast("int"), F.lit(SAMPLE_WORDS)).alias("words")).collect()
    return fit([(r.lang, r.words) for r in sorted(rows, key=lambda r: (r.lang, r.place))])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_runs: bool = False) -> DataFrame:
    """``key, lang_pred, score`` for every document, with ``with_runs`` also its runs of one language."""
    require(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double"
    schema += ", runs array<struct<lang: string, first_word: int, n_words: int>>" * with_runs
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(released(_identify(model, with_runs)), schema).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose words tell a learned language clearly enough.

    Clearness is the mean over a text's different words with letters of the probability of each word's best language by the word
    itself, put on a scale from 0 (all languages alike) to 1; ``TRUST`` words of 1 are added. It neither depends on the number of
    languages nor falls where a text changes its language; words of a script or language far from those learned have little of it.
    """
    require(docs, text)
    return docs.mapInArrow(released(_accept(model, docs.columns.index(text), least)), docs.schema)


by_value(__name__)
