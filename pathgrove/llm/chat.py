"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

``format_conversations`` reads (conv_id, turn, role, text), orders each conversation by (turn, role, text) and emits one row
per text segment: (conv_id, seg, turn, kind, text, loss, valid). Conversations are dealt by conv_id and sorted within the
partition; each task then streams over its rows, so no conversation is ever held whole in memory. The state machine
checks the order of turns: ``valid`` is false from the first turn that the template's transitions don't allow.

Texts and roles are escaped reversibly: in front of ``|`` or a backslash, ``<`` gets a backslash, so no control string of
the template can arise from a text; a line break in a role becomes ``<\\n``.

Null text or role: empty. Null turn: sorts first. Null conv_id: one conversation of its own. Repeated rows: repeated turns.
Unknown roles are formatted without loss and make the conversation invalid. An empty table gives no segments. Other columns are
ignored. A conversation is one task's work, as its turns form one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

SEGMENTS = "conv_id long, seg long, turn long, kind string, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    """Which text opens and closes a turn, which roles bear loss, and which role may follow which."""

    opens: str = "<|im_start|>{role}\n"
    closes: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    ends: frozenset = frozenset({"assistant"})


def escape(text: str) -> str:
    return re.sub(r"<(?=[|\\])", r"<\\", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<\\n")


def unescape(text: str) -> str:
    return re.sub(r"<\\([|\\n])", lambda m: "\n" if m[1] == "n" else "<" + m[1], text) if "<\\" in text else text


def turns(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, bounded in rows and in characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or n >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    bounded_batches(conversations.sparkSession)

    def run(batches):
        def segments():
            now, state, seg, ok = object(), "", 0, True
            for conv, turn, role, text in turns(batches, "conv_id", "turn", "role", "text"):
                if conv != now:
                    now, state, seg, ok = conv, "", 0, True
                ok = ok and role in template.follows.get(state, ())
                state = role
                for kind, part, loss in (
                    ("open", template.opens.replace("{role}", escape_role(role)), False),
                    ("text", escape(text), role in template.loss_roles),
                    ("close", template.closes, False),
                ):
                    yield conv, seg, turn, kind, part, loss, ok
                    seg += 1

        return batched(segments(), _SEGMENTS)

    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, ends_well boolean"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("ends_well", pa.bool_())])


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse the formatted text into turns again, one digest row per conversation.

    Only the characters of the segments, one after another, and their loss flags are read: turn boundaries are the template's control
    strings, wherever a segment ends. The parser streams; it holds back no more than the length of a control string."""
    head, tail = template.opens.split("{role}")
    closing = template.closes

    class Parser:
        """States: before a turn's opening, in its role, in its text."""

        def __init__(self):
            self.turns, self.chars, self.loss, self.valid, self.role = 0, 0, 0, True, ""
            self.all, self.learnt = hashlib.sha256(), hashlib.sha256()
            self.state, self.rest, self.flags = "open", "", []

        def feed(self, text: str, loss: bool) -> None:
            self.chars += len(text)
            self.rest += text
            self.flags.append((len(text), loss))
            while self.step():
                pass

        def take(self, n: int) -> tuple[str, str]:
            """The next n characters, and those of them under the loss mask."""
            text, self.rest, learnt, at = self.rest[:n], self.rest[n:], [], 0
            while at < n:
                size, loss = self.flags[0]
                used = min(size, n - at)
                if loss:
                    learnt.append(text[at : at + used])
                at += used
                self.flags[0] = (size - used, loss)
                if size == used:
                    self.flags.pop(0)
            return text, "".join(learnt)

        def step(self) -> bool:
            if self.state == "open":
                if len(self.rest) < len(head):
                    return False
                if not self.rest.startswith(head):
                    raise ValueError("text between turns")
                self.take(len(head))
                self.state = "role"
                return True
            mark = tail if self.state == "role" else closing
            at = self.rest.find(mark)
            if self.state == "role":
                if at < 0:
                    return False
                self.role = unescape(self.take(at)[0])
                self.take(len(mark))
                self.turns += 1
                self.all.update(f"{self.role}\n".encode())
                self.state = "text"
                return True
            # hold back what could be the beginning of an escape or of the closing
            n = at if at >= 0 else max(0, len(self.rest) - max(len(mark), 3))
            while at < 0 and n and self.rest[n - 1] in "<\\":
                n -= 1
            text, learnt = self.take(n)
            plain, own = unescape(text), unescape(learnt)
            self.all.update(plain.encode())
            self.learnt.update(own.encode())
            self.loss += len(own)
            if at >= 0:
                self.take(len(mark))
                self.all.update(b"\n")
                self.state = "open"
            return at >= 0

        def row(self, conv: int | None) -> tuple:
            if self.state != "open" or self.rest:
                raise ValueError(f"conversation {conv} ends within a turn")
            return conv, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, self.valid, self.valid and self.role in template.ends

    def run(batches):
        def digests():
            now, parser = None, None
            for conv, text, loss, ok in turns(batches, "conv_id", "text", "loss", "valid"):
                if parser is None or conv != now:
                    if parser:
                        yield parser.row(now)
                    now, parser = conv, Parser()
                parser.feed(text, loss)
                parser.valid = parser.valid and ok
            if parser:
                yield parser.row(now)

        return batched(digests(), _DIGESTS)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, DIGESTS)
