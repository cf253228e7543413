"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A signature has ``SYMBOLS`` symbols of 16 bits, each the low bits of one minimum over the hashes
of the document's five-word shingles. Two documents whose sets have similarity ``J`` differ in a symbol with probability
``1 - J``. All pairs that differ in at most ``distance`` symbols are candidates: by the pigeonhole principle such a
pair has at most one error in one of ``distance // 2 + 1`` pieces of the signature, and enumerating which
symbol of a piece may be wrong gives keys of which they share one. The distance follows from the similarity asked for: a
pair at that similarity passes it with probability 1 - ``MISSED`` or more, and more often above. Candidates become links only
when ``100 * intersection >= similar * union`` holds for their full sets.

Groups are never turned into all their pairs. Equal sets are one class from the start. Each
bucket of equal keys gives a forest of its candidate pairs; the forests' components are families,
and every candidate pair lies within one. The full sets of a family then meet, each sent
once, and a family gives a forest of its links: a pair that is already joined needs no test, any
other candidate pair is tested. Buckets and families too large for a task are cut
into parts, and every two parts meet.

Documents without words have no shingles and are alone; those without id are, too. Shorter ones
than five words have one shingle. Rows that share a document id count as one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import possible
from tidemark.llm.common import by_value, gram_hashes, mixed, released, require
from tidemark.llm.graph import components
from tidemark.plans.stage import stored

SHINGLE = 5
SYMBOLS = 40
#: Least similarity of a link, in hundredths, where none is asked for.
SIMILAR = 85
#: Largest probability with which a pair at the least similarity is no candidate.
MISSED = 3e-5


def distance_of(similar: int) -> int:
    """Symbols in which a pair may differ so that it is missed with probability ``MISSED`` at most."""
    if not 0 < similar <= 100:
        raise ValueError(f"similarity in hundredths must be in 1..100, not {similar}")
    wrong, passed = 1 - similar / 100, 0.0
    for most in range(SYMBOLS):
        passed += comb(SYMBOLS, most) * wrong**most * (1 - wrong) ** (SYMBOLS - most)
        if 1 - passed <= MISSED:
            return most
    return SYMBOLS - 1


DISTANCE = distance_of(SIMILAR)
CHUNKS = DISTANCE // 2 + 1
#: Most rows of a part of a bucket or family, and shingles of a family's part.
PART_ROWS = 1000
PART_SHINGLES = 1_000_000
#: Places of shared shingles in the sets that are held as bits at a time.
CELLS = 1 << 25

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().translate(FOLD).split()
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def signature(shingles: np.ndarray, factors: np.ndarray) -> bytes:
    """Low 16 bits of the least hash of each function."""
    if not len(shingles):
        return b""
    least = np.empty(SYMBOLS, np.uint64)
    for first in range(0, len(shingles), 4096):
        part = shingles[first : first + 4096]
        found = (part * factors[:, :1] + factors[:, 1:] >> np.uint64(20)).min(axis=1)
        least = found if first == 0 else np.minimum(least, found)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _factors() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, (SYMBOLS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for batch in batches:
        count, digest, sig = [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            count.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s, factors))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
            ["id", "n", "set_hash", "sig"],
        )


def _chunks(distance: int) -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), distance // 2 + 1)


def _keys(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """A row for each piece of the signature and each symbol of it that may be wrong."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        keys, which = [], 0
        for chunk in _chunks(distance):
            for wrong in chunk:
                h = np.full(len(sig), which, np.uint64)
                for s in chunk:
                    if s != wrong:
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, s] + np.uint64(1))
                keys.append(h.view(np.int64))
                which += 1
        ids = batch.column(0).take(pa.array(np.tile(np.arange(len(sig)), which)))
        if len(sig):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(keys))], ["id", "key"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the near pairs in each (bucket, part, part); rows come sorted by these."""
    out: list[tuple[int, int]] = []
    for _, group in groupby(_rows(batches), key=lambda r: r[:3]):
        ids, sig = zip(*(r[3:] for r in group))
        sig = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SYMBOLS)
        left = np.arange(len(ids))
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i = todo.pop()
                near = (sig[left] != sig[i]).sum(axis=1) <= distance
                found = left[near].tolist()
                out += [(ids[i], ids[j]) for j in found if ids[i] != ids[j]]
                todo += found
                left = left[~near]
        if len(out) >= 10_000:
            yield _pairs(out)
            out = []
    if out:
        yield _pairs(out)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family, part and set of each text; signatures are made again rather than sent."""
    factors = _factors()
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([signature(s, factors) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        keep = pa.array(np.flatnonzero([len(s) > 0 for s in sets]))
        columns = [c.take(keep) for c in (batch.column(0), batch.column(2), batch.column(3), *columns)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "family", "parts", "sig", "shingles"])


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``i`` and ``j``, by bits of the shingles that several sets hold."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1]))
    several = ~fresh | np.concatenate((~fresh[1:], [False]))
    column = (np.cumsum(fresh & several) - 1)[several]
    owner = owner[several]
    out = np.zeros(len(i), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    columns = 64 * max(1, min(-(-width // 64), CELLS // len(sets) // 64))
    for first in range(0, width, columns):
        low, high = np.searchsorted(column, [first, first + columns])
        bits = np.zeros((len(sets), columns), np.uint8)
        bits[owner[low:high], column[low:high] - first] = 1
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for at in range(0, len(i), 2048):
            part = slice(at, at + 2048)
            out[part] += np.bitwise_count(packed[i[part]] & packed[j[part]]).sum(axis=1, dtype=np.int64)
    return out


def links_among(ids: list[int], sigs: np.ndarray, sets: list[np.ndarray], similar: int = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the links; candidate pairs not joined so far are tested, row by row."""
    distance = distance_of(similar)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(ids))
    out = []
    for first in range(0, len(ids), 64):
        rows = np.arange(first, min(first + 64, len(ids)))
        near = (sigs[rows, None, :] != sigs[None, :, :]).sum(axis=2) <= distance
        if first == 0:
            # The first row may join most others, which then need no more tests.
            blocks = [rows[:1], rows[1:]]
        else:
            blocks = [rows]
        for block in blocks:
            i, j = np.nonzero(near[block - first] & (label[block, None] != label[None, :]))
            i = i + (block[0] if len(block) else 0)
            i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            used = np.unique(np.concatenate((i, j)))
            both = shared_counts([sets[k] for k in used], np.searchsorted(used, i), np.searchsorted(used, j))
            good = 100 * both >= similar * (sizes[i] + sizes[j] - both)
            for a, b in zip(i[good].tolist(), j[good].tolist()):
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    out.append((ids[a], ids[b]))
    return out


def _links(batches: Iterator[pa.RecordBatch], similar: int = SIMILAR) -> Iterator[pa.RecordBatch]:
    """Links within each (family, part, part); rows come sorted by these."""
    out: list[tuple[int, int]] = []
    for _, group in groupby(_rows(batches), key=lambda r: r[:3]):
        ids, sigs, sets = zip(*(r[3:] for r in group))
        sigs = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SYMBOLS)
        out += links_among(ids, sigs, [np.frombuffer(s, np.uint64) for s in sets], similar)
        if len(out) >= 10_000:
            yield _pairs(out)
            out = []
    if out:
        yield _pairs(out)


def _meeting(rows: DataFrame, group: str, parts: str, columns: list[str]) -> DataFrame:
    """Rows in tasks where every two parts of a group meet; ``parts`` counts the group's parts."""
    last = F.col(parts).cast("int") - 1
    part = F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    return (
        rows.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(group, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), *columns)
        .repartition(group, "low", "high")
        .sortWithinPartitions(group, "low", "high", "id")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every document; links have ``similar`` hundredths or more."""
    require(docs, key, text)
    distance = distance_of(similar)
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = stored(given.mapInArrow(released(_sketch), "id long, n long, set_hash binary, sig binary"), "sketch")
    classes = stored(
        sketch.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull())
        .groupBy("set_hash")
        .agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")),
        "classes",
    )
    keys = classes.select("id", "sig").mapInArrow(released(partial(_keys, distance=distance)), "id long, key long")
    many = keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    # Keys that one class alone has lead to nobody, and most are such.
    buckets = keys.join(many, "key").withColumn("parts", F.ceil(F.col("many") / PART_ROWS))
    signed = buckets.join(classes.select("id", "sig"), "id")
    forest = _meeting(signed, "key", "parts", ["id", "sig"]).mapInArrow(released(partial(_forest, distance=distance)), "a long, b long")
    families = stored(components(forest), "families")

    sizes = families.join(classes.select(F.col("id").alias("node"), "n"), "node").groupBy("component").agg(F.sum("n").alias("held"), F.count("*").alias("many"))
    parts = F.greatest(F.ceil(F.col("held") / PART_SHINGLES), F.ceil(F.col("many") / PART_ROWS)).alias("parts")
    of_family = families.join(sizes.select("component", parts), "component").select(
        F.col("node").alias("id"), F.col("component").alias("family"), "parts"
    )
    texts = possible(given, "id", families.select("node")).join(of_family, "id").select("id", "text", "family", "parts")
    sets = texts.mapInArrow(released(_with_sets), "id long, family long, parts long, sig binary, shingles binary")
    links = _meeting(sets, "family", "parts", ["id", "sig", "shingles"]).mapInArrow(released(partial(_links, similar=similar)), "a long, b long")
    comps = components(links)

    of_set = classes.join(comps.withColumnRenamed("node", "id"), "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("component")
    )
    return sketch.join(of_set, "set_hash", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


by_value(__name__)
