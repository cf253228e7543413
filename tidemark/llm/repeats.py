"""Substring dedup: word passages that already stand earlier in the corpus are removed.

Suffixes are sampled by content. A window of ``WINDOW`` words is given its least ``PREFIX``-word
hash as anchor; equal windows have equal anchors, so only suffixes that begin at anchors need to
meet, about one word in eight. They are grouped by their first words:

* Prefixes that occur once are pruned after counting; they can begin no repeat.
* A prefix that occurs up to ``GROUP`` times is a group that fits in memory. Its suffix tree is built over
  the words from the anchor on (sorted suffixes and their longest common prefixes, whose
  intervals are the tree's nodes) and a second tree over the words before the anchor. A node of
  each, together ``WINDOW`` words deep, is a repeat; all but its first place are removed.
* Suffixes of a more frequent prefix are given longer ones, of ``LONGER`` words: those that follow the anchor for the windows
  that reach so far beyond it, and the words around it for those that end sooner but begin well before it. Groups of these
  that fit get trees, for their windows alone.
* What is still too frequent gets the longest prefix, the whole window. At that depth a
  node needs no tree: the first place is a combinable minimum, taken out by digest and place, so a
  passage that stands in a third of all documents is no hot group.

Trees compare words, not hashes. Texts are shuffled only for documents that share some prefix.
Windows are judged on the input; a removed word is one that any repeated window covers.

Null and empty texts have no words; texts shorter than a window keep all. Documents without id
keep all and remove nothing. Rows that share an id are taken as one document that was read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import flagged, possible
from tidemark.llm.common import by_value, gram_hashes, require
from tidemark.plans.stage import stored

WINDOW = 20
PREFIX = 6
#: Prefixes in a window; words before an anchor that a window can reach.
SPAN = WINDOW - PREFIX + 1
REACH = SPAN - 1
#: Words of a longer prefix, and how many of them stand before the anchor where windows end too soon for it.
LONGER = 13
LEAD = LONGER - PREFIX
#: Windows by the words between their beginning and the anchor: those that hold the longer prefix after it, and the others.
FAR, SOON = range(0, WINDOW - LONGER + 1), range(WINDOW - LONGER + 1, SPAN)
LANES = tuple(sum(1 << l for l in lanes) for lanes in (FAR, SOON))
#: Most suffixes of a group (some 150 MB while its trees are built), and suffixes whose trees are built together.
GROUP = 100_000
BATCH = 20_000
#: Most prefixes that are dealt out, and over how many keys each.
FREQUENT, SALTS = 10_000, 64
#: Rows with words that a task hands on at once.
ROWS_OUT = 20_000


def running(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, the anchor hash of every window, and where the anchors are."""
    h = gram_hashes(words, PREFIX)
    least = running(h, SPAN, np.minimum)
    padded = np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)))
    return h, least, np.flatnonzero(running(padded, SPAN, np.maximum) == h)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        ids = batch.column(0).take(pa.array(np.concatenate(rows)))
        columns = [pa.array(np.concatenate(prefixes).view(np.int64)), ids, pa.array(np.concatenate(places).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["prefix", "id", "pos"])

    for batch in batches:
        places, prefixes, rows, held = [], [], [], 0
        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").encode().split()
            if len(words) < WINDOW:
                continue
            h, _, at = anchors(words)
            places.append(at)
            prefixes.append(h[at])
            rows.append(np.full(len(at), i))
            held += len(at)
            if held >= 10 * ROWS_OUT:
                yield made()
                places, prefixes, rows, held = [], [], [], 0
        if rows:
            yield made()


def _placed(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Row, words and places of each document; a place past the end belongs to another text of the same id."""
    for i, (text, at) in enumerate(zip(batch.column(1), batch.column(2))):
        words = (text.as_py() or "").encode().split()
        places = np.array(at.as_py(), np.int64)
        places = places[places // 2 + PREFIX <= len(words)]
        if len(places) and len(words) >= WINDOW:
            yield i, words, places


def _longer_hashes(words: list[bytes], at: np.ndarray, soon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the longer prefixes and which exist; ``soon`` tells those that begin before the anchor."""
    begin = np.where(soon, at - LEAD, at)
    there = (begin >= 0) & (begin + LONGER <= len(words))
    h = gram_hashes(words, LONGER)[begin[there]] ^ np.where(soon[there], np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    return h, there


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both longer prefixes of each place; places carry which in their last bit from here on."""
    for batch in batches:
        prefixes, rows, places = [], [], []
        for i, words, at in _placed(batch):
            both = np.concatenate((at, at + 1))
            h, there = _longer_hashes(words, both // 2, both % 2 == 1)
            prefixes.append(h)
            places.append(both[there])
            rows.append(np.full(len(h), i))
        if rows:
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            columns = [pa.array(np.concatenate(prefixes).view(np.int64)), ids, pa.array(np.concatenate(places).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["prefix", "id", "pos"])


def _suffixes(batches: Iterator[pa.RecordBatch], longer: bool = False) -> Iterator[pa.RecordBatch]:
    """The words around each place, with the number of them before it, and the windows that matter."""

    def made() -> pa.RecordBatch:
        columns = [
            pa.array(np.concatenate(prefixes).view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(places, pa.int64()),
            pa.array(lanes, pa.int32()), pa.array(before, pa.int32()), pa.array(around, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["prefix", "id", "pos", "lanes", "before", "words"])

    for batch in batches:
        prefixes, rows, places, lanes, before, around = [], [], [], [], [], []
        for i, words, at in _placed(batch):
            if longer:
                h, there = _longer_hashes(words, at // 2, at % 2 == 1)
                at = at[there]
                prefixes.append(h)
            else:
                prefixes.append(gram_hashes(words, PREFIX)[at // 2])
            for p, soon in zip((at // 2).tolist(), (at % 2).tolist()):
                low = max(0, p - REACH)
                rows.append(i)
                places.append(p)
                lanes.append(LANES[soon] if longer else sum(LANES))
                before.append(p - low)
                around.append(b" ".join(words[low : p + WINDOW]))
            if len(rows) >= ROWS_OUT:
                yield made()
                prefixes, rows, places, lanes, before, around = [], [], [], [], [], []
        if rows:
            yield made()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each place that its longer prefix is for, as digests of their words."""

    def made() -> pa.RecordBatch:
        columns = [pa.array(digests, pa.binary()), batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["digest", "id", "pos"])

    for batch in batches:
        digests, rows, starts = [], [], []
        for i, words, at in _placed(batch):
            h, least, _ = anchors(words)
            begins = np.concatenate([at[at % 2 == soon] // 2 - l for soon, lanes in enumerate((FAR, SOON)) for l in lanes])
            anchor = np.concatenate([at[at % 2 == soon] // 2 for soon, lanes in enumerate((FAR, SOON)) for _ in lanes])
            inside = (begins >= 0) & (begins < len(least))
            begins, anchor = begins[inside], anchor[inside]
            for s in np.unique(begins[least[begins] == h[anchor]]).tolist():
                digests.append(xxhash.xxh3_128_digest(b" ".join(words[s : s + WINDOW])))
                rows.append(i)
                starts.append(s)
            if len(rows) >= ROWS_OUT:
                yield made()
                digests, rows, starts = [], [], []
        if rows:
            yield made()


def nodes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Tree nodes: ``out[row, d]`` is the node at depth ``d`` that the row's path passes.

    Rows are sorted as suffixes; neighbours that agree in ``d`` words lie under the same node.
    """
    order = np.lexsort((*words.T[::-1], group))
    w, g = words[order], group[order]
    agree = np.cumprod(w[1:] == w[:-1], axis=1, dtype=np.int8).sum(axis=1)
    common = np.where(g[1:] == g[:-1], agree, -1)
    out = np.empty((len(group), words.shape[1] + 1), np.int64)
    for depth in range(words.shape[1] + 1):
        out[order, depth] = np.concatenate(([0], np.cumsum(common < depth)))
    return out


def repeated(group: np.ndarray, ids: np.ndarray, places: np.ndarray, before: list[int], around: list[bytes]) -> np.ndarray:
    """Bit ``l`` of a row: the window ``l`` words before its place stands earlier. Rows are sorted by group, id, place."""
    n = len(group)
    number: dict[bytes, int] = {}
    fresh = count()
    # What lies outside a document agrees with nothing: every row pads with a number of its own.
    pad = -1 - np.arange(n)[:, None]
    after, ahead = np.repeat(pad, WINDOW, axis=1), np.repeat(pad, REACH, axis=1)
    for i, (b, text) in enumerate(zip(before, around)):
        codes = []
        for w in text.split():
            code = number.get(w)
            if code is None:
                code = number[w] = next(fresh)
            codes.append(code)
        after[i, : len(codes) - b] = codes[b:]
        ahead[i, :b] = codes[:b][::-1]
    right, left = nodes(group, after), nodes(group, ahead)
    out = np.zeros(n, np.int32)
    for l in range(SPAN):
        _, first, which = np.unique(right[:, WINDOW - l] * n + left[:, l], return_index=True, return_inverse=True)
        origin = first[which]
        out |= ((ids != ids[origin]) | (places != places[origin])).astype(np.int32) << l
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of whole groups; rows come sorted by prefix, id, place."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        prefix, ids, places = (table.column(i).to_numpy() for i in range(3))
        group = np.concatenate(([0], np.cumsum(prefix[1:] != prefix[:-1])))
        mask = repeated(group, ids, places, table.column(4).to_pylist(), table.column(5).to_pylist()) & table.column(3).to_numpy()
        kept = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(places[kept]), pa.array(mask[kept].astype(np.int32))], ["id", "pos", "mask"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BATCH:
            continue
        table = pa.Table.from_batches(held)
        prefix = table.column(0).to_numpy()
        last = int(np.flatnonzero(prefix != prefix[-1])[-1] + 1) if prefix[0] != prefix[-1] else 0
        if last:
            yield settle(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield settle(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, marks in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            marks = marks.as_py()
            gone = np.zeros(len(words) + 1, np.int32)
            starts = {m["pos"] - l for m in marks or () for l in range(SPAN) if m["mask"] >> l & 1}
            for s in starts:
                if 0 <= s <= len(words) - WINDOW:
                    gone[s] += 1
                    gone[s + WINDOW] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(int(len(words) - stay.sum()))
            kept.append(b" ".join(w for w, s in zip(words, stay) if s).decode() if starts else b" ".join(words).decode())
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``id, text, at`` of the documents that have places."""
    at = places.groupBy("id").agg(F.sort_array(F.collect_list(F.col("pos").cast("long"))).alias("at"))
    return possible(docs, "id", places.select("id")).join(at, "id").select("id", "text", "at")


def _counted(found: DataFrame, many: DataFrame) -> DataFrame:
    """Places with how ``many`` have their prefix, where several do.

    Prefixes with many places are few by definition, at most ``FREQUENT`` of them. They are told to all tasks, which
    deal their places out over ``SALTS`` keys, so a prefix of a third of all places is no hot key.
    """
    total = many.agg(F.sum("many")).first()[0] or 0
    frequent = F.broadcast(many.where(F.col("many") > max(GROUP // 20, total // FREQUENT)).select("prefix", F.lit(True).alias("often")))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    each = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = found.join(frequent, "prefix", "left").withColumn("salt", salt)
    told = many.join(frequent, "prefix", "left").withColumn("salt", F.explode(each))
    return dealt.drop("often").join(told.drop("often"), ["prefix", "salt"])


def _grouped(found: DataFrame, name: str) -> DataFrame:
    """``id, pos, large`` of the places that share their prefix; large groups have more than ``GROUP``."""
    many = stored(found.groupBy("prefix").agg(F.count("*").alias("many")).where("many > 1"), f"{name}_prefixes")
    return stored(_counted(found, many).select("id", "pos", (F.col("many") > GROUP).alias("large")), name)


def repeat_marks(docs: DataFrame) -> DataFrame:
    """``id, pos, mask`` of the repeated windows of ``id, text``."""
    kind = docs.schema["id"].dataType.simpleString()
    given = docs.where(F.col("id").isNotNull())
    row = f"prefix long, id {kind}, pos long, lanes int, before int, words binary"
    # The last bit of a place tells its longer prefixes apart; before there are any it is 0.
    found = given.mapInArrow(_anchors, f"prefix long, id {kind}, pos int").withColumn("pos", F.col("pos").cast("long") * 2)
    places = _grouped(found, "places")
    suffixes = _at_places(given, places.where("NOT large")).mapInArrow(_suffixes, row)
    frequent = places.where("large").select("id", "pos")
    if not frequent.take(1):
        return _marked(suffixes, kind)
    longer = _at_places(given, frequent).mapInArrow(_longer, f"prefix long, id {kind}, pos long")
    placed = _grouped(longer, "longer_places")
    suffixes = suffixes.unionByName(_at_places(given, placed.where("NOT large")).mapInArrow(partial(_suffixes, longer=True), row))
    # Stored, as the first places and what is left without them both read it.
    windows = stored(
        _at_places(given, placed.where("large")).mapInArrow(_windows, f"digest binary, id {kind}, pos long").withColumn(
            "order", F.col("id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("pos")
        ),
        "windows",
    )
    firsts = windows.groupBy("digest").agg(F.min("order").alias("order"))
    # What is left without the first places. Rows meet by digest and place, so no digest is a hot key.
    tagged = windows.select("digest", "order", "id", "pos", F.lit(False).alias("first")).unionByName(
        firsts.select("digest", "order", F.lit(True).alias("first")), allowMissingColumns=True
    )
    of_windows = (
        tagged.groupBy("digest", "order")
        .agg(F.max("first").alias("first"), F.min("id").alias("id"), F.min("pos").alias("pos"))
        .where("NOT first")
        .select("id", "pos", F.lit(1).alias("mask"))
    )
    return _marked(suffixes, kind).unionByName(of_windows)


def _marked(suffixes: DataFrame, kind: str) -> DataFrame:
    ordered = suffixes.repartition("prefix").sortWithinPartitions("prefix", "id", "pos")
    return ordered.mapInArrow(_trees, f"id {kind}, pos long, mask int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, kept`` for every document; ``kept`` joins the words left by spaces."""
    require(docs, key, text)
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    marks = stored(repeat_marks(given), "marks")
    listed = marks.groupBy("id").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    # Only documents that may have marks are shuffled; the others are cut as they are read.
    parted = flagged(given, "id", marks.select("id"), "possible")
    nothing = F.lit(None).cast(listed.schema["marks"].dataType)
    alone = parted.where("NOT possible").select("id", "text", nothing.alias("marks"))
    marked = parted.where("possible").join(listed, "id", "left").select("id", "text", "marks")
    schema = f"id {kind}, n_words long, n_removed long, kept string"
    return alone.mapInArrow(_cut, schema).unionByName(marked.mapInArrow(_cut, schema)).withColumnRenamed("id", key)


by_value(__name__)
