"""Chat formatting with a template that is only known as a function from turns to text.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what the
longer one adds is the turn's part, and a second rendering with a mark in place of the text
tells where in that part the text lies. A template whose longer output does not begin with the
shorter one rewrites history; such turns are flagged.

Prefixes are whole ones, however long the conversation is, so a template that changes early turns late
is caught. A template may declare its ``reach``, the number of preceding turns its part of a turn can
depend on (0: the turn alone); prefixes are then rendered over a bounded history, and a very long
conversation needs no more memory and time a turn than a short one. The default template declares it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, END, MARK = "<|im_start|>", "<|im_end|>", "\ue000"


def escaped(text: str) -> str:
    """Without any control string; ``plain`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def plain(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn."""
    return "".join(
        START + escaped(role).replace("\n", "\\n") + "\n" + escaped(text) + END + "\n" for role, text in turns)


marked_turns.reach = 0


class Renderer:
    """Parts and text spans of successive turns of one conversation."""

    def __init__(self, template: Template, reach: int | None = None):
        self.template = template
        self.reach = getattr(template, "reach", None) if reach is None else reach
        self.history: list[Turn] = []
        self.before = template([])

    def _part(self, turn: Turn) -> tuple[str | None, str]:
        out = self.template([*self.history, turn])
        return (out[len(self.before):] if out.startswith(self.before) else None), out

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """(part, where the text begins and ends in it, whether history was rewritten).

        Of a rewritten turn the part is what follows the common beginning of both outputs.
        """
        part, out = self._part((role, text))
        probe, _ = self._part((role, MARK))
        rewritten = part is None or probe is None or probe.count(MARK) != 1
        if rewritten:
            same = next((k for k, (a, b) in enumerate(zip(self.before, out, strict=False)) if a != b),
                        min(len(self.before), len(out)))
            part, begin, end = out[same:], 0, 0
        else:
            begin = probe.index(MARK)
            end = len(part) - (len(probe) - begin - 1)
        self.history.append((role, text))
        self.before = out
        if self.reach is not None and len(self.history) > 2 * self.reach + 8:
            self.history = self.history[len(self.history) - self.reach:]
            self.before = self.template(self.history)
        return part, begin, end, rewritten


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def _with_id(kind, schema: pa.Schema) -> pa.Schema:
    return pa.schema([("conv_id", to_arrow_type(kind)), *schema])


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


PARTS = pa.schema([
    ("n", pa.int64()), ("part", pa.string()), ("text_start", pa.int64()),
    ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewritten", pa.bool_()),
])


def format_turns(
    turns: DataFrame, template: Template = marked_turns, trained: tuple[str, ...] = ("assistant",),
    reach: int | None = None,
) -> DataFrame:
    """One row per turn: its part of the formatted conversation and where its text lies there.

    ``turns`` has conv_id, turn, role, text; more columns are ignored. Turns are taken in order
    of (turn, role, text), nulls first; null roles and texts count as empty, a null conv_id is a
    conversation of its own; ids are of any type that can be ordered. ``reach`` overrides what the template
    declares. ``text_start`` and ``text_end`` are code points in the formatted
    conversation, ``loss`` marks texts a model is trained on. Rows of a conversation are in
    order in one partition.
    """
    order = ["conv_id", "turn", "role", "text"]
    placed = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)

    kind = placed.schema["conv_id"].dataType

    def run(batches):
        def parts():
            current, state = object(), None
            for conv, role, text in _rows(batches):
                if state is None or conv != current:
                    current, state, n, at = conv, Renderer(template, reach), 0, 0
                role, text = role or "", text or ""
                part, begin, end, rewritten = state.add(role, text)
                yield conv, n, part, at + begin, at + end, role in trained and not rewritten, rewritten
                n, at = n + 1, at + len(part)

        yield from _batched(parts(), _with_id(kind, PARTS))

    return placed.select("conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind.simpleString()}, n long, part string, text_start long, text_end long, loss boolean, rewritten boolean")


class Reader:
    """Reads turns back from formatted text that comes in parts."""

    def __init__(self):
        self.rest, self.turns, self.digest = "", 0, hashlib.sha256()

    def feed(self, part: str) -> None:
        text = self.rest + part
        at = 0
        while (stop := text.find(END + "\n", at)) >= 0:
            role, _, body = text[at + len(START):stop].partition("\n")
            self.digest.update(f"{plain(role)}\n{plain(body)}\n".encode())
            self.turns += 1
            at = stop + len(END) + 1
        self.rest = text[at:]


DIGEST = pa.schema([
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewritten", pa.int64()),
])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of ``format_turns`` holds, per conversation: its turns, and the texts under the loss."""

    kind = formatted.schema["conv_id"].dataType

    def run(batches):
        def found():
            current, state = object(), None
            for conv, _, part, begin, end, loss, rewritten in _rows(batches):
                if state is None or conv != current:
                    if state is not None:
                        yield current, state.turns, state.digest.hexdigest(), chars, trained.hexdigest(), at, changed
                    current, state, trained, chars, at, changed = conv, Reader(), hashlib.sha256(), 0, 0, 0
                state.feed(part)
                if loss:
                    text = plain(part[begin - at:end - at])
                    trained.update(text.encode())
                    chars += len(text)
                at, changed = at + len(part), changed + rewritten
            if state is not None:
                yield current, state.turns, state.digest.hexdigest(), chars, trained.hexdigest(), at, changed

        yield from _batched(found(), _with_id(kind, DIGEST))

    return formatted.mapInArrow(
        run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, n_rewritten long")
