"""Chat formatting by a finite-state machine over roles and a declarative template.

``format_turns`` walks each conversation in turn order, checks the order of roles with the
machine, and emits text segments with a loss flag each; only assistant texts carry loss.
``read_back`` parses the joined segments again, without looking at the roles they came from.

Control strings inside a text are made harmless by backslashes after their first character: one
more on the way in, one less on the way out, so texts that hold such a form already survive.

Rows stream through each task in sorted order with the state of one conversation, so memory is
bounded by one turn even if one conversation holds a third of all rows. Null roles and texts are
empty; equal turns are ordered by role and text; a null conversation id is a conversation
of its own. Every conversation is formatted, also an invalid one; ``valid`` tells.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_value, require


@dataclass(frozen=True)
class Template:
    """What stands before and after each role's text. ``other`` carries the role's name."""

    # The marks of a widely used instruction format.
    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>\n", "\n<</SYS>>\n\n"),
        ("user", "<s>[INST] ", " [/INST]"),
        ("assistant", " ", " </s>"),
    )
    other: tuple[str, str, str] = ("[ROLE ", "] ", " [/ROLE]")
    control: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]")
    loss: tuple[str, ...] = ("assistant",)


#: The machine: state -> role -> next state. Anything else is a fault.
TRANSITIONS = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ACCEPTING = ("answered",)

SEGMENTS = "turn_no long, part int, text string, loss boolean, valid boolean"
DIGEST = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


class Escaper:
    def __init__(self, template: Template):
        forms = "|".join(f"(?<={re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in template.control)
        self.found = re.compile(forms)

    def hide(self, text: str) -> str:
        return self.found.sub(lambda m: m[0] + "\\", text)

    def show(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][1:], text)


def around(template: Template, role: str) -> tuple[str, str]:
    for name, before, after in template.marks:
        if name == role:
            return before, after
    opening, close, after = template.other
    return opening + quote(role, safe="") + close, after


def parse(template: Template, text: str, at: int) -> tuple[str, int, int, int]:
    """Role, start and end of the text, and end of the turn that begins at ``at``."""
    opening, close, ending = template.other
    for name, before, after in template.marks:
        if text.startswith(before, at):
            begin, role, mark = at + len(before), name, after
            break
    else:
        if not text.startswith(opening, at):
            raise ValueError(f"no turn begins at {at}")
        name_end = text.index(close, at)
        begin, role, mark = name_end + len(close), unquote(text[at + len(opening) : name_end]), ending
    end = text.index(mark, begin)
    return role, begin, end, end + len(mark)


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, missing = Escaper(template), object()
        current, turn, state = missing, 0, "start"
        for batch in batches:
            out: list[tuple] = []
            conv, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            for c, role, text in zip(conv, roles, texts):
                role, text = role or "", text or ""
                if c != current:
                    current, turn, state = c, 0, "start"
                after = TRANSITIONS.get(state, {}).get(role)
                state = after or "fault"
                before, behind = around(template, role)
                valid = after is not None
                out.append((c, turn, 0, before, False, valid))
                out.append((c, turn, 1, escaper.hide(text), role in template.loss, valid))
                out.append((c, turn, 2, behind, False, valid))
                turn += 1
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
                names = ["conv_id", "turn_no", "part", "text", "loss", "valid"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    return run


class _Conversation:
    """Digests of one conversation while its segments arrive."""

    def __init__(self, template: Template, escaper: Escaper):
        self.template, self.escaper = template, escaper
        self.pending, self.masks = "", []
        self.turns, self.state = 0, "start"
        self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.valid = True

    def add(self, text: str, loss: bool, last: bool) -> None:
        if loss:
            self.masks.append((len(self.pending), len(self.pending) + len(text)))
        self.pending += text
        if last:
            self.close()

    def close(self) -> None:
        at = 0
        while at < len(self.pending):
            role, begin, end, after = parse(self.template, self.pending, at)
            told = self.escaper.show(self.pending[begin:end])
            self.all.update(f"{role}\n{told}\n".encode())
            self.state = TRANSITIONS.get(self.state, {}).get(role, "fault")
            self.turns += 1
            at = after
        for begin, end in self.masks:
            learned = self.escaper.show(self.pending[begin:end])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(self.pending)
        self.pending, self.masks = "", []

    def row(self, conv) -> tuple:
        return (
            conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
            self.state in ACCEPTING,
        )


def _reader(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, current, told, kind = Escaper(template), None, None, pa.int64()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for c, part, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if told is None or c != current:
                    if told is not None:
                        done.append(told.row(current))
                    current, told = c, _Conversation(template, escaper)
                told.add(text, loss, part == 2)
            if done:
                yield batch_of(done)
        if told is not None:
            yield batch_of([told.row(current)])

    return run


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments ``conv_id, turn_no, part, text, loss, valid``; joined in order they are the formatted text."""
    require(turns, "conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return (
        turns.select("conv_id", "role", "text", "turn")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
        .mapInArrow(_formatter(template), f"conv_id {kind}, {SEGMENTS}")
    )


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, from the formatted text alone: turns, digests and the masked text."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    return (
        segments.select("conv_id", "part", "text", "loss", "turn_no")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn_no", "part")
        .mapInArrow(_reader(template), f"conv_id {kind}, {DIGEST}")
    )


by_value(__name__)
