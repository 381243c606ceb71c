"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and
only that reply is trainable. Turns after the last reply, or a conversation without one,
give one more example with nothing to train on, so that the examples of a conversation
hold all its turns.

A turn is ``open role middle text close`` with the control strings of the template. Such
strings inside a role or text, in whatever template of the list, are broken up with an
escape character, which is itself doubled, so that reading an example back gives the
original. Rows of a conversation are ordered by turn, then role, then text; null turns
come first, and a null role, text counts as empty.

An example holds its conversation up to its target, so a conversation must fit in one
row, as its longest example does; examples are made one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import ship_code

ESCAPE = "\\"
# Characters of examples that leave a task in one Arrow batch.
_BATCH_CHARACTERS = 4 << 20


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    # control strings of other templates and vocabularies, which texts may not forge either
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.open, self.middle, self.close, *self.reserved

    def escape(self, text: str) -> str:
        pattern = "|".join(map(re.escape, (ESCAPE, *self.controls)))
        return re.sub(pattern, lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """A formatted turn in three parts: what stands before the text, the text, the end."""
        return f"{self.open}{self.escape(role)}{self.middle}", self.escape(text), self.close

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted example."""
        turns = []
        for part in formatted.split(self.close)[:-1]:
            role, text = part.removeprefix(self.open).split(self.middle)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


@dataclass(frozen=True)
class Example:
    text: str
    target: int | None  # place of the trainable turn
    start: int  # of the trainable characters
    end: int
    last: bool  # holds all turns of the conversation


def expand(turns: list[tuple[str, str]], template: Template, reply: str) -> Iterator[Example]:
    """The examples of one conversation, in order of their targets."""
    prefix, written = "", None
    for place, (role, text) in enumerate(turns):
        head, body, tail = template.turn(role, text)
        start = len(prefix) + len(head)
        prefix = f"{prefix}{head}{body}{tail}"
        if role == reply:
            if written is not None:
                yield written
            written = Example(prefix, place, start, start + len(body), place == len(turns) - 1)
    if written is not None:
        yield written
    if turns and (written is None or not written.last):
        yield Example(prefix, None, 0, 0, True)


def format_chats(
    rows: DataFrame,
    template: Template = Template(),
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    reply: str = "assistant",
) -> DataFrame:
    """One row per example: conversation id, target, formatted, loss_start, loss_end, last.

    ``loss_start`` and ``loss_end`` are offsets in Unicode code points of ``formatted``;
    the target is the reply's place in the conversation, null if nothing is trainable.
    Rows with a null conversation id form one conversation.
    """
    ship_code(rows.sparkSession)
    empty = F.lit("")
    own = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
    )
    gathered = rows.groupBy(F.col(conversation).alias("id")).agg(
        F.array_sort(F.collect_list(own)).alias("turns")
    )
    id_type = gathered.schema["id"].dataType.simpleString()
    schema = (
        f"`{conversation}` {id_type}, target int, formatted string, "
        "loss_start int, loss_end int, last boolean"
    )
    names = [conversation, "target", "formatted", "loss_start", "loss_end", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * len(names)
            kinds = [kind, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for batch in batches:
            found, held, kind = [], 0, batch.column("id").type
            for own_id, own_turns in zip(batch.column("id"), batch.column("turns")):
                turns = [(t["role"], t["text"]) for t in own_turns.as_py()]
                for e in expand(turns, template, reply):
                    found.append((own_id.as_py(), e.target, e.text, e.start, e.end, e.last))
                    held += len(e.text)
                    if held > _BATCH_CHARACTERS:
                        yield out(found, kind)
                        found, held = [], 0
            yield out(found, kind)

    return gathered.mapInArrow(run, schema)


def read_back(examples: DataFrame, template: Template = Template(), conversation: str = "conv_id") -> DataFrame:
    """What each example says: turns (of the last example of a conversation) and loss_text.

    ``turns`` is null except for the example that holds the whole conversation, so that
    no turn is read more than once.
    """
    ship_code(examples.sparkSession)
    turns = "array<struct<role:string,text:string>>"
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = (
        f"`{conversation}` {examples.schema[conversation].dataType.simpleString()}, target int, "
        f"n_chars long, loss_text string, turns {turns}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_end", "last"))
            sizes, losses, listed = [], [], []
            for formatted, start, end, last in zip(*columns):
                sizes.append(len(formatted))
                losses.append(template.unescape(formatted[start:end]))
                read = template.read(formatted) if last else None
                listed.append([{"role": r, "text": t} for r, t in read] if last else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(conversation),
                    batch.column("target"),
                    pa.array(sizes, pa.int64()),
                    pa.array(losses, pa.string()),
                    pa.array(listed, kind),
                ],
                names=[conversation, "target", "n_chars", "loss_text", "turns"],
            )

    return examples.mapInArrow(run, schema)
