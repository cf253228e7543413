"""Secret scan with a trigram index.

From each rule's regular expression a Boolean query of trigrams is derived that any match must
satisfy. The documents of a task are indexed block by block: for every trigram that some rule
needs, the list of documents of the block that hold it. Postings are intersected and joined as
the query says, and only the documents left are searched with the expression itself. A rule
without mandatory trigrams is searched in every document. The index folds A-Z, so it also serves
expressions that ignore case.

Whole texts are indexed and searched, in any number of blocks. Null and empty texts have no
spans. Offsets are code points, ends exclusive. Spans are ordered by start, then rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_value, released, require

#: Bytes of text that are indexed at once.
BLOCK_BYTES = 1_000_000
#: Rows whose texts a task holds as strings at once.
ROWS_AT_ONCE = 1000
#: Longest list of alternative strings that is followed through a pattern.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base rules, then forms of keys that carry their own mark.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Runs of hex digits are maximal, so asking for 24 finds the same spans as dropping shorter ones.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("signed_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", base=False),
)

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

# A query is None (no demand), a trigram, or ("and" | "or", queries).


def _both(a, b):
    return b if a is None else a if b is None else ("and", [a, b])


def _either(parts: list):
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """Any of the strings must occur."""
    demands = []
    for s in sorted(strings):
        raw = s.encode()
        grams = sorted({raw[i : i + 3] for i in range(len(raw) - 2)})
        demands.append(("and", grams) if grams else None)
    return _either(demands)


def _walk(nodes) -> tuple[set[str] | None, object]:
    """Exact strings of a sequence (None: unknown) and its query."""
    run, demand, exact = {""}, None, True
    for op, arg in nodes:
        strings, inner = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        if strings is not None:
            inner = _of_strings(strings)
        demand, run, exact = _both(_both(demand, _of_strings(run)), inner), {""}, False
    return (run, _of_strings(run)) if exact else (None, _both(demand, _of_strings(run)))


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is K.LITERAL:
        c = chr(arg)
        return {c.lower() if c.isascii() else c}, None
    if op is K.SUBPATTERN:
        return _walk(arg[-1])
    if op is K.BRANCH:
        parts = [_walk(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        return None, _either([q for _, q in parts])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, body = arg
        strings, inner = _walk(body)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, None
        return None, inner if least else None
    if op is K.IN and len(arg) <= 4 and all(o is K.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, None
    if op is K.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str):
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def matching(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Sorted documents that satisfy the query."""
    if isinstance(query, bytes):
        return postings[query]
    lists = [matching(q, postings) for q in query[1]]
    out = lists[0]
    for other in lists[1:]:
        out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
    return out


class Index:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.number = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.wanted):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[bytes, np.ndarray]:
        """``data``: bytes of the block; ``ends``: where each document ends."""
        found = {g: np.empty(0, np.int64) for g in self.wanted}
        if len(data) < 3:
            return found
        b = self.fold[data].astype(np.uint32)
        which = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(which)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[doc]
        which, doc = which[at[inside]], doc[inside]
        pairs = np.unique(which.astype(np.int64) * (len(ends) + 1) + doc)
        for i, g in enumerate(self.wanted):
            low, high = np.searchsorted(pairs, [(i + 1) * (len(ends) + 1), (i + 2) * (len(ends) + 1)])
            found[g] = pairs[low:high] - (i + 1) * (len(ends) + 1)
        return found


def spans_in(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


class Scanner:
    """Finds spans in arrays of texts; made once in each task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.index = Index(set().union(*(trigrams_of(q) for _, _, q in self.rules)))

    def blocks(self, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        first = 0
        while first < len(ends):
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right")))
            yield first, last
            first = last

    def scan(self, column: pa.Array) -> list[list[tuple[str, int, int, bool]]]:
        texts = column.cast(pa.large_string()).fill_null("")
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        found: list[list] = [[] for _ in range(len(texts))]
        for first, last in self.blocks(offsets[1:] - offsets[0]):
            low = offsets[first]
            postings = self.index.postings(raw[low : offsets[last]], offsets[first + 1 : last + 1] - low)
            part = texts.slice(first, last - first).to_pylist()
            for order, (rule, compiled, demand) in enumerate(self.rules):
                hits = range(len(part)) if demand is None else matching(demand, postings)
                for i in hits:
                    for begin, end in spans_in(rule, compiled, part[i]):
                        found[first + i].append((begin, order, end))
        out = []
        for spans in found:
            spans.sort()
            out.append([(self.rules[o][0].kind, b, e, self.rules[o][0].base) for b, o, e in spans])
        return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time."""
    for batch in batches:
        for first in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        )
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in row] for row in scanner.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["key", "spans"])

    return run


def _hide(rules: tuple[Rule, ...], place: int, mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches):
            column = batch.column(place)
            texts = column.to_pylist()
            for i, spans in enumerate(scanner.scan(column)):
                if spans:
                    kept, at = [], 0
                    for _, begin, end, _ in spans:
                        if begin >= at:
                            kept += [texts[i][at:begin], mask]
                        at = max(at, end)
                    texts[i] = "".join(kept) + texts[i][at:]
            columns = [pa.array(texts, column.type) if j == place else c for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans`` for every document; ``spans`` is an array of ``kind, start, end, base``."""
    require(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(released(_scan(rules)), f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def hide_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span, overlapping ones joined, replaced by ``mask``."""
    require(docs, text)
    return docs.mapInArrow(released(_hide(rules, docs.columns.index(text), mask)), docs.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key,
        *map(count, ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


by_value(__name__)
