"""Chat formatting: a finite-state machine over roles, segments with loss flags, a declarative template.

A template names, per role, the strings before and after a turn's text and whether the text is learned.
``format_turns`` gives one row per turn with its segments (text, loss): header, escaped text, footer. The
machine over roles (template ``order``) judges every turn by the role before it: ``valid``; turns out of
order are formatted like others, so nothing is lost, and can be filtered by the flag.

Control strings inside a text are escaped reversibly: a backslash is doubled, and one is put after the first
character of every place where a control string starts, so none remains; ``unescape`` undoes both.

Null text counts as empty, null role as the empty role; unknown roles use the template's default. Turns are
ordered by turn, then role, then text, so repeated turns are all formatted. Rows without conv_id form one
conversation. ``read_turns`` parses formatted turns again. Each task streams sorted rows and holds one turn at
a time, so a conversation of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``start`` and ``end`` mark a turn; ``head`` parts role from text. ``order``: roles that may follow a role."""

    start: str = "<turn "
    head: str = ">\n"
    end: str = "</turn>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    order: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    #: Further strings that must not appear in a text, as other templates mark turns by them.
    reserved: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "<|im_start|>", "<|im_end|>")

    def controls(self) -> tuple[str, ...]:
        return (self.start.strip(), self.end.strip(), *self.reserved)


DEFAULT = Template()


def _escaper(template: Template) -> re.Pattern:
    return re.compile(r"\\|(?=" + "|".join(re.escape(c) for c in template.controls()) + ").", re.S)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + "\\", text)


_UNESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] if m[1] == "\\" else m[1], text)


def _role(role: str, pattern: re.Pattern) -> str:
    """A role as it stands in a header: escaped, and on one line."""
    return escape(role, pattern).replace("\n", "\\n").replace(">", "\\>")


SEGMENTS = "array<struct<text: string, loss: boolean>>"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, at, before, number = _escaper(template), object(), "", 0
        for b in batches:
            convs, numbers, segments, valid = [], [], [], []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if conv != at:
                    at, before, number = conv, "", 0
                role, text = role or "", text or ""
                convs.append(conv)
                numbers.append(number)
                valid.append(role in template.order.get(before, ()))
                segments.append([
                    {"text": template.start + _role(role, pattern) + template.head, "loss": False},
                    {"text": escape(text, pattern), "loss": role in template.learned},
                    {"text": template.end, "loss": False},
                ])
                before, number = role, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(segments, _SEGMENT), pa.array(valid, pa.bool_())], ["conv_id", "position", "segments", "valid"])

    return run


def format_turns(turns: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, position (from 0), segments, valid; sorted by both inside its partition."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(_formatter(template), f"conv_id long, position long, segments {SEGMENTS}, valid boolean")


def parse_turn(segments: list[dict], template: Template) -> tuple[str, str, list[str]]:
    """Role, text and the texts under the loss mask of one formatted turn."""
    whole = "".join(s["text"] for s in segments)
    if not (whole.startswith(template.start) and whole.endswith(template.end)):
        raise ValueError("a formatted turn must begin and end with the template's marks")
    head, found, body = whole[len(template.start) : len(whole) - len(template.end)].partition(template.head)
    if not found:
        raise ValueError("a formatted turn must have a header")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return role, unescape(body), [unescape(s["text"]) for s in segments if s["loss"]]


def _reader(template: Template):
    """Digests of whole conversations from their formatted turns, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def close():
            conv, n, turns, chars, loss, formatted, valid = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, valid))

        for b in batches:
            for conv, segments, valid in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != at:
                    if state is not None:
                        close()
                    at, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                role, text, learned = parse_turn(segments, template)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                for x in learned:
                    state[3] += len(x)
                    state[4].update(x.encode())
                state[5] += sum(len(s["text"]) for s in segments)
                state[6] &= valid
            if done:
                yield _digests(done)
                done.clear()
        if state is not None:
            close()
            yield _digests(done)

    return run


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def conversation_digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation, read back from the formatted turns: turns, text under the loss mask, sizes, and whether all turns are in order."""
    rows = formatted.select("conv_id", "position", "segments", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return rows.mapInArrow(_reader(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
