"""Chat formatting: a finite-state machine over roles emits segments with loss flags.

A template declares, for each role, the marks around its text and whether the
text counts for the loss; and which role may follow which. Rows of a
conversation stream through the machine in turn order, so one that holds a third
of all rows is never gathered: each turn gives its segments at once, and only
the machine's state is carried. Control strings inside a text are escaped, so
that the marks alone delimit turns and the texts can be read back exactly.

Cases: a null text is empty; a null or unknown role gets the generic marks, which
carry the role's name. Turns out of order in role are all formatted and flagged
(``valid`` false), not dropped. Turns with equal numbers follow each other by
role and text; a null turn comes first. A null conv_id is a conversation of its
own. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pelagia.llm.common import bounded


@dataclass(frozen=True)
class Template:
    """Marks (before, after) of each role, its loss flag, and the roles that may follow."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "[/OUT]")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    #: From the role before ("" at the start) to the roles that may come.
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    closing: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """Every control string, longest first."""
        return sorted({self.begin, self.end, *self.other, *(m for pair in self.marks.values() for m in pair)}, key=lambda s: (-len(s), s))


class Escaper:
    r"""Breaks up control strings in texts: their first character becomes ``\l``, ``\b``, ...; ``\`` doubles."""

    LETTERS = "lbcdefghijkmnopqrstuvwxyz"

    def __init__(self, template: Template):
        controls = template.controls()
        firsts = sorted({c[0] for c in controls})
        if "\\" in firsts or any("\\" in c for c in controls):
            raise ValueError("control strings can't hold a backslash")
        self.code = {c: "\\" + self.LETTERS[k] for k, c in enumerate(firsts)} | {"\\": "\\\\"}
        self.plain = {v: k for k, v in self.code.items()}
        self.risky = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
        self.coded = re.compile("|".join(map(re.escape, self.plain)))
        self.marks = re.compile("|".join(map(re.escape, controls)))

    def escape(self, text: str) -> str:
        return self.risky.sub(lambda m: self.code[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.coded.sub(lambda m: self.plain[m[0]], text)


class Machine:
    """Validates role order and emits (text, loss) segments turn by turn."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, Escaper(template)
        self.state, self.valid = "", True

    def start(self) -> list[tuple[str, bool]]:
        self.state, self.valid = "", True
        return [(self.template.begin, False)]

    def turn(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        role, body = role or "", self.escaper.escape(text or "")
        self.valid &= role in self.template.follows.get(self.state, ())
        self.state = role
        if role in self.template.marks:
            before, after = self.template.marks[role]
        else:
            before, after = self.template.other[0] + self.escaper.escape(role) + self.template.other[1], self.template.other[2]
        return [(before, False), (body, role in self.template.loss), (after, False)]

    def finish(self) -> tuple[list[tuple[str, bool]], bool]:
        return [(self.template.end, False)], self.valid and self.state in self.template.closing


class Reader:
    """Reads turns back from segments of formatted text, in any cut, and sums them up."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, Escaper(template)
        self.role_of = {before: role for role, (before, _) in template.marks.items()}
        self.closers = {after for _, after in template.marks.values()} | {template.other[2]}
        self.reset()

    def reset(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.role: str | None = None
        self.body: list[str] = []

    def feed(self, segment: str, loss: bool) -> None:
        self.chars += len(segment)
        if loss:
            plain = self.escaper.unescape(segment)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode("utf-8", "surrogatepass"))
        at = 0
        for m in self.escaper.marks.finditer(segment):
            self.body.append(segment[at : m.start()])
            at = m.end()
            self._mark(m[0])
        self.body.append(segment[at:])

    def _mark(self, mark: str) -> None:
        if mark in self.role_of:
            self.role, self.body = self.role_of[mark], []
        elif mark == self.template.other[0]:
            self.body = []
        elif mark == self.template.other[1]:
            self.role, self.body = self.escaper.unescape("".join(self.body)), []
        elif mark in self.closers:
            text = self.escaper.unescape("".join(self.body))
            self.turns += 1
            self.turns_sha.update(f"{self.role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.body = []


SEGMENTS = "conv_id long, turn long, segment int, text string, loss boolean, valid boolean"
NAMES = ["conv_id", "turn", "segment", "text", "loss", "valid"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation, in order: conv_id, turn, segment, text, loss, valid.

    ``segment`` counts from 0 (the opening mark) in each conversation; ``valid`` is
    set on its last segment, null before. Concatenated texts are the formatted
    conversation. Rows come sorted within partitions, a conversation in one.
    """
    template = template or Template()
    spark = bounded(rows.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", "turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, conv, count, turn = Machine(template), None, -1, None
        for b in batches:
            out: list[list] = [[] for _ in NAMES]

            def emit(segments: list[tuple[str, bool]], at: int | None, valid: bool | None = None) -> None:
                nonlocal count
                for text, loss in segments:
                    count += 1
                    for col, v in zip(out, (conv, at, count, text, loss, valid)):
                        col.append(v)

            for c, t, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if count < 0 or c != conv:
                    if count >= 0:
                        emit(*_ended(machine, turn))
                    conv, count = c, -1
                    emit(machine.start(), None)
                emit(machine.turn(role, text), t)
                turn = t
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)
        if count >= 0:
            [(text, loss)], valid = machine.finish()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, turn, count + 1, text, loss, valid), TYPES)], NAMES)

    return dealt.mapInArrow(run, SEGMENTS)


def _ended(machine: Machine, turn: int | None) -> tuple[list[tuple[str, bool]], int | None, bool]:
    segments, valid = machine.finish()
    return segments, turn, valid


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, read from its formatted segments as ``format_conversations`` orders them."""
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        reader = Reader(template)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for conv, text, loss, valid in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5))):
                reader.feed(text, loss)
                if valid is not None:
                    for col, v in zip(out, (conv, reader.turns, reader.turns_sha.hexdigest(), reader.loss_chars, reader.loss_sha.hexdigest(), reader.chars, valid)):
                        col.append(v)
                    reader.reset()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
