"""Chat formatting: a state machine over roles, a declarative template, and loss flags for each segment of text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import partitions


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles may follow which, and whose text counts for the loss.

    A turn is open + name + close + text + end.  In names and texts the escape character and the control strings get an
    escape character before them, so the formatted text can be read back whatever the texts hold.
    """

    open: str = "### "
    close: str = ": "
    end: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: Turn order: from each state (the last role; "" at the start), the roles that may come.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    def _controls(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, self.open, self.close, self.end))))

    def escaped(self, text: str) -> str:
        return _replaced(self._controls(), lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return _replaced(re.compile(re.escape(self.escape) + "(.)", re.DOTALL), lambda m: m[1], text)

    def name(self, role: str) -> str:
        """Names that aren't in the template stand for themselves, behind a mark that no listed name has."""
        return self.names[role] if role in self.names else "=" + self.escaped(role)

    def role(self, name: str) -> str:
        return self.unescaped(name[1:]) if name.startswith("=") else {v: k for k, v in self.names.items()}[name]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's pieces and whether each counts for the loss; only a text of a loss role does."""
        return [(self.open + self.name(role) + self.close, False), (self.escaped(text), role in self.loss), (self.end + self.after, False)]

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Reads role and text of each turn back from formatted text, by its control strings alone."""
        controls, at = self._controls(), 0
        while at < len(formatted):
            if not formatted.startswith(self.open, at):
                raise ValueError(f"no turn at {at}")
            name = at + len(self.open)
            text = self._until(self.close, controls, formatted, name)
            end = self._until(self.end, controls, formatted, text + len(self.close))
            if not formatted.startswith(self.end + self.after, end):
                raise ValueError(f"no turn at {at}")
            yield self.role(formatted[name:text]), self.unescaped(formatted[text + len(self.close) : end])
            at = end + len(self.end + self.after)

    def _until(self, wanted: str, controls: re.Pattern, formatted: str, at: int) -> int:
        """Where the next control string stands that no escape character is before; it has to be the wanted one."""
        while m := controls.search(formatted, at):
            if m[0] == wanted:
                return m.start()
            if m[0] != self.escape:
                break
            at = m.end() + 1
        raise ValueError(f"no {wanted!r} after {at}")


#: Pieces of a text that are held before they are joined.
PIECES = 1 << 16


def _replaced(pattern: re.Pattern, new: Callable[[re.Match], str], text: str) -> str:
    """As re.sub(), but what it holds beside the text is bounded, however many matches there are."""
    done, held, at = [], [], 0
    for m in pattern.finditer(text):
        held += (text[at : m.start()], new(m))
        at = m.end()
        if len(held) >= PIECES:
            done.append("".join(held))
            held = []
    if not at:
        return text
    return "".join([*done, *held, text[at:]])


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Text segments of all conversations with their loss flags.

    turns: conv_id, turn, role, text.  Returns conv_id, position (of the turn, from 0), segment (0 to 2), text, loss,
    in_order (this turn may follow the last, by the state machine) and complete (null but in the last segment of a
    conversation: whether all its turns were in order and it ends in a final state).

    Rows go in order of turn, then role and text, nulls first.  Null roles and texts are empty; an empty or unlisted
    role is never in order and is formatted all the same.  Null conv_ids are one conversation.  Repeated rows are turns
    of their own.  Each conversation is one run of sorted rows in one task, which holds two turns however long it is.
    """
    cells = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = cells.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, position long, segment int, text string, loss boolean, in_order boolean, complete boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        conv, begun, position, state, good = None, False, 0, "", True

        def close() -> None:
            if out:
                out[-1][-1] = good and state in template.final

        for batch in batches:
            ids, roles, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for conv_id, role, text in zip(ids, roles, texts, strict=True):
                if not begun or conv_id != conv:
                    close()
                    conv, begun, position, state, good = conv_id, True, 0, "", True
                in_order = role in template.order.get(state, ())
                good = good and in_order
                out += [[conv_id, position, k, piece, loss, in_order, None] for k, (piece, loss) in enumerate(template.segments(role, text.as_py()))]
                state, position = role, position + 1
            if len(out) > 1:  # the last segment waits: the conversation may end with it
                yield _segments(out[:-1])
                out = out[-1:]
        close()
        if out:
            yield _segments(out)

    return rows.mapInArrow(run, schema)


def _segments(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    names = ["conv_id", "position", "segment", "text", "loss", "in_order", "complete"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of conversations, read from the formatted text and its loss flags.

    segments: what format_chats() returns, each conversation's segments in order in one partition, as it leaves them.
    Returns conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars, loss_sha256 (the
    unescaped text under the loss flags), formatted_chars and complete.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, complete boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, all_turns, lossy, n, chars, loss_chars, piece = None, None, None, 0, 0, 0, ""
        for batch in batches:
            ids, numbers, texts, losses, completes = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 6))
            for conv_id, segment, text, loss, complete in zip(ids, numbers, texts, losses, completes, strict=True):
                if all_turns is None:
                    conv, all_turns, lossy, n, chars, loss_chars, piece = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
                piece += text
                chars += len(text)
                if loss:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    lossy.update(plain.encode())
                if segment == 2:
                    for role, body in template.turns(piece):
                        all_turns.update(f"{role}\n{body}\n".encode())
                        n += 1
                    piece = ""
                if complete is not None:
                    done.append((conv, n, all_turns.hexdigest(), loss_chars, lossy.hexdigest(), chars, complete))
                    all_turns = None
            if done:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "complete"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []

    return segments.mapInArrow(run, schema)
