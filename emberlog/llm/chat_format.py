"""Operator 7, chat formatting with a grammar round trip.

A turn is written as ``### role: text </turn>`` and a newline. Each rendered turn is read back
by the deterministic parser; when what it recovers is not the source, the control strings in the
content are escaped with a backslash and the turn is rendered again until both are identical.
Turns are independent, so all of this is row work; the text of a conversation is its turns in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import require

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
# What the parser looks for in a role and in a text; a backslash before anything else is content.
IN_ROLE = re.compile(r"\\[\\:0]|:")
IN_TEXT = re.compile(r"\\(?:\\|###|</turn>)|###|</turn>")
NO_ROLE = "\\0"


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:")


def escape_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def parse(rendered: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn, start and end being the text's place in ``rendered``.

    One pass from left to right; raises ValueError where the text is not of the grammar.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        begin = at + len(OPEN)
        role, colon = read(rendered, begin, IN_ROLE, ":")
        start = colon + len(AFTER_ROLE)
        text, end = read(rendered, start, IN_TEXT, "</turn>")
        at = end + len(CLOSE) - 1
        if rendered[colon:start] != AFTER_ROLE or not text.endswith(" ") or rendered[end - 1:at] != CLOSE:
            raise ValueError(f"the turn at {begin} is not well formed")
        turns.append((None if rendered[begin:colon] == NO_ROLE else role, text[:-1], start, end - 1))
    return turns


def read(rendered: str, at: int, tokens: re.Pattern, stop: str) -> tuple[str, int]:
    """Unescaped content up to the control string ``stop``, and where that stands."""
    out = []
    for token in tokens.finditer(rendered, at):
        what = token.group()
        out.append(rendered[at:token.start()])
        if what[0] == "\\":
            out.append(what[1:])
            at = token.end()
        elif what == stop:
            return "".join(out), token.start()
        else:
            raise ValueError(f"{what!r} inside content")
    raise ValueError(f"no {stop!r}")


def render(role: str | None, text: str) -> str:
    """One turn, escaped only as far as the round trip asks for."""
    plain, safe = (NO_ROLE, NO_ROLE) if role is None else (role, escape_role(role))
    for shown_role, shown in ((plain, text), (plain, escape_text(text)), (safe, escape_text(text))):
        out = f"{OPEN}{shown_role}{AFTER_ROLE}{shown}{CLOSE}"
        try:
            back = parse(out)
        except ValueError:
            continue
        if [(r, t) for r, t, _, _ in back] == [(role, text)]:
            return out
    raise AssertionError(f"no round trip for {role!r}, {text!r}")


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, segment (the rendered turn), loss_start and loss_end (code points of the segment
    under the loss mask; both null for other roles).

    A null text is empty; a null role is rendered apart from an empty one and comes back as null; null
    conversation ids and turns are kept. Repeated rows are turns of their own. Very long texts cost memory for
    one row. An empty table gives an empty result; other columns are not read. Narrow: no shuffle.
    """
    require(df, conv_col, turn_col, role_col, text_col)
    df = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                   F.col(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, ends = [], [], []
            for role, text in zip(batch.column(2), batch.column(3), strict=True):
                role = role.as_py()
                segment = render(role, text.as_py() or "")
                (_, _, start, end), = parse(segment)
                segments.append(segment)
                starts.append(start if role == trained_role else None)
                ends.append(end if role == trained_role else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end"])

    return df.mapInArrow(run, f"{kinds}, segment string, loss_start bigint, loss_end bigint")


def unmasked(segment: str, start: int, end: int) -> str:
    """The text under a mask, unescaped."""
    return read(segment[start:end] + " </turn>", 0, IN_TEXT, "</turn>")[0][:-1]


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered turns: n_turns, turns_sha256 (role, newline, text, newline per
    turn), loss_chars, loss_sha256 (all text under the loss mask) and formatted_chars.

    Turns go in order of turn, then role and text (nulls first). The rendered turns are sorted within
    partitions and streamed past running digests, so a conversation of any length needs no memory; a digest is
    sequential by nature, so one conversation is read by one task, after the per-turn work was done in parallel.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in
                                                   ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{text}\n".encode())
                if start is not None:
                    loss = unmasked(segment, start, end)
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(segment)
            yield _finished(done, batch.schema.field("conv_id").type)
            last = batch.schema.field("conv_id").type
        if state:
            yield _finished([state], last)

    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _finished(states: list, kind: pa.DataType) -> pa.RecordBatch:
    rows = [(c, n, turns.hexdigest(), chars, loss.hexdigest(), total) for c, n, turns, chars, loss, total in states]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
