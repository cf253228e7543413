from __future__ import annotations

import hashlib
import re

import pyarrow as pa

from tidemark.llm import common, secrets
from tidemark.llm.queries import QUERIES

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{b}:{e}" for b, _, e, k in sorted(spans)]


TEXTS = [
    None,
    "",
    "PassWord = 'hunter22x' and é secret:abc secret: abcdef",
    "api_key=token=abcdefgh apikey:\"12345678",
    "AKIA" + "A" * 16 + " AKIA123 AKIAKIA" + "B" * 30,
    "x" + "0123456789abcdef" * 3 + "G" + "f" * 23,
    "tokén = abcdefgh; toKen= abcdefgh; ſecret=abcdefgh; to\nken=abcdefgh",
    "password",
    "pa" * 1000,
    "-----BEGIN RSA PRIVATE KEY-----\nabc",
]


def test_spans_against_brute_force(spark, documents):
    found = secrets.scan(documents(TEXTS)).collect()
    for r in found:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == brute(TEXTS[r.doc_id])
    assert [s.kind for s in found[9].spans] == ["private_key"]


def test_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op8_secret_scan"](spark, small).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_blocks_and_borders(monkeypatch, documents):
    monkeypatch.setattr(secrets, "BLOCK_BYTES", 20)
    scanner = secrets.Scanner(secrets.RULES)
    import pyarrow as pa

    texts = ["pass", "word=abcdefgh", "xx token=abcdefgh yy", None, "AK", "IA" + "A" * 30] + TEXTS
    got = scanner.scan(pa.array(texts).slice(1))
    assert [[f"{k}:{b}:{e}" for k, b, e, base in row if base] for row in got] == [brute(t) for t in texts[1:]]


def test_derived_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigrams_of(secrets.trigram_query("AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert secrets.trigrams_of(secrets.trigram_query("(abc|xyz)q?")) == {b"abc", b"bcq", b"xyz", b"yzq"}
    assert secrets.trigram_query("(abc|[0-9]+)") is None


def test_hidden_spans(spark, documents):
    docs = documents(["a token=deadbeefdeadbeefdeadbeefdead b", None, "clean"])
    got = secrets.hide_secrets(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["a [secret] b", None, "clean"]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_texts_are_held_few_at_a_time(monkeypatch):
    monkeypatch.setattr(secrets, "ROWS_AT_ONCE", 3)
    texts = [None, "", "password=abcdef1"] + [f"水 token: {i:06d} end" for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts)], ["doc_id", "text"])
    out = list(secrets._hide(secrets.RULES, 1, "[secret]")(iter([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)])))
    assert max(map(len, out)) == 3
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(11))
    assert [t for b in out for t in b.column(1).to_pylist()] == [None, "", "[secret]"] + ["水 [secret] end"] * 8


def test_a_task_gives_its_memory_back_when_it_has_ended(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert (next(run), calls) == (2, []) and list(run) == [3] and calls == [1]
    monkeypatch.undo()
    common.give_back()
