from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat
from tidemark.llm.queries import HOSTILE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\s>", " ", "\n", "é", "[ROLE ", "[/ROLE]", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "a b]\n", ""]))
def test_any_text_is_read_back(text, role):
    template = chat.Template()
    escaper = chat.Escaper(template)
    before, after = chat.around(template, role)
    hidden = escaper.hide(text)
    assert not any(c in hidden for c in template.control)
    formatted = before + hidden + after + " next </s>"
    found, begin, end, stop = chat.parse(template, formatted, 0)
    assert (found, escaper.show(formatted[begin:end]), stop) == (role, text, len(before + hidden + after))


def digests(turns):
    told = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_against_brute_force(spark, small):
    import collections

    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text))
    rows[-1] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op7_chat_format"](spark, small).collect()}
    assert got == {c: digests([x[1:] for x in sorted(t)]) for c, t in rows.items()}


def test_order_of_roles_nulls_and_ties(spark):
    turns = {
        1: [("system", "s"), ("user", "u"), ("assistant", "a")],
        2: [("assistant", "a"), ("user", "u")],
        3: [("user", None), ("user", "")],
        4: [(None, "n"), ("tool", "t]\n")],
        None: [("user", "q"), ("assistant", "r")],
    }
    rows = [(c, i, r, t) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c: digests(t) for c, t in turns.items()}
    twice = chat.read_back(chat.format_turns(df.union(df))).collect()
    assert sum(r.n_turns for r in twice) == 2 * len(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_loss_falls_on_assistant_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "</s>")], SCHEMA)
    segments = chat.format_turns(df).orderBy("turn_no", "part").collect()
    assert "".join(s.text for s in segments) == "<s>[INST] u [/INST] <\\/s> </s>"
    assert [s.text for s in segments if s.loss] == ["<\\/s>"]


def test_many_turns_stream(spark):
    df = spark.range(30000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    (row,) = chat.read_back(chat.format_turns(df)).collect()
    assert (row.n_turns, row.valid) == (30000, True)
