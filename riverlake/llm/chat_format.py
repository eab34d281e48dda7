"""Chat formatting with a grammar that reads back what was written.

A turn is rendered as

    ### Role: <role>
    <text>
    </turn>

and a conversation is the concatenation of its turns. Inside texts a control string (a turn's
opening or its end) is marked by backslashes: with k of them before it, one more is written,
and the parser takes one away; a control string without a backslash is the grammar's own. A
rendered turn is parsed again, and texts that do not come back as they were are escaped, until
they do; texts that hold no control string stay as they are. A turn holds no control string of
the grammar other than its own, so that parsing a concatenation is parsing each of its turns.

The loss mask covers what assistants say, without headers, ends and escapes.

Defined results: turns go by ``turn`` (nulls first), then role, then text; repeated rows are
turns of their own. A null role or text is empty. A null conversation id is a conversation. A
conversation is streamed through one task in order, as its digests are sequential; what is
held at a time is one batch of turns. A text of any length, or a run of any number of backslashes,
is read in time in proportion to it. An empty table gives no rows. Extra columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, END = "### Role: ", "</turn>"
LEARNED_ROLE = "assistant"

# Control strings are found first and the backslashes before them looked at after, so that a long
# run of backslashes costs no more than other text.
_CONTROL = re.compile(f"{re.escape(OPEN)}|{re.escape(END)}")
_ESCAPED = re.compile(rf"\\({_CONTROL.pattern})")
_ROLE_SIGNS = {"\\": "\\\\", "\n": "\\n"}


def escape(text: str) -> str:
    """One more backslash before every control string."""
    return _CONTROL.sub(lambda m: f"\\{m[0]}", text)


def render(role: str, text: str) -> str:
    """A turn, with its text as it is if the parser reads it back, else escaped until so."""
    name = re.sub(r"[\\\n]", lambda m: _ROLE_SIGNS[m[0]], escape(role))
    body = text
    while True:
        turn = f"{OPEN}{name}\n{body}\n{END}\n"
        if list(parse(turn)) == [(role, text)]:
            return turn
        if body != text:
            raise ValueError("the grammar does not read back a turn")
        body = escape(text)


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(line: str) -> str:
    plain = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)
    return _unescaped(plain)


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """Turns of a rendered conversation; stops at text that is none."""
    place = 0
    while rendered.startswith(OPEN, place):
        line_end = rendered.find("\n", place)
        found = _CONTROL.finditer(rendered, line_end + 1)
        end = next((m for m in found if rendered[m.start() - 1] != "\\"), None)
        if line_end < 0 or end is None or end[0] != END:
            return
        if rendered[end.start() - 1 : end.start()] != "\n" or end.start() - 1 <= line_end:
            return
        if rendered[end.end() : end.end() + 1] != "\n":
            return
        yield _role(rendered[place + len(OPEN) : line_end]), _unescaped(
            rendered[line_end + 1 : end.start() - 1]
        )
        place = end.end() + 1


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per row: conversation, turn, and the rendered turn; a conversation is their join in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    narrow = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        text(role_col).alias("role"),
        text(text_col).alias("text"),
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            rendered = pa.array([render(role, said) for role, said in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, rendered], [*batch.schema.names, "rendered"]
            )

    return narrow.mapInArrow(
        step, "conv_id long, turn long, role string, text string, rendered string"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of its turns and of the text under the loss mask.

    Everything is read from the rendered turns, streamed in order.
    """
    ordered = formatted.select("conv_id", "turn", "role", "text", "rendered").repartition(
        "conv_id"
    ).sortWithinPartitions("conv_id", "turn", "role", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
        ]
        done: list[tuple] = []
        current: tuple | None = None

        def close() -> None:
            if current is not None:
                conv, n, said, chars, loss, size = current
                done.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size))

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*done) if done else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names
            )

        for batch in batches:
            for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if current is None or conv != current[0]:
                    close()
                    current = (conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                _, n, said, chars, loss, size = current
                for role, text in parse(rendered):
                    n += 1
                    said.update(f"{role}\n{text}\n".encode("utf-8"))
                    if role == LEARNED_ROLE:
                        chars += len(text)
                        loss.update(text.encode("utf-8"))
                current = (conv, n, said, chars, loss, size + len(rendered))
            if len(done) >= 5000:
                yield rows()
                done.clear()
        close()
        yield rows()

    return ordered.select("conv_id", "turn", "role", "text", "rendered").mapInArrow(
        step,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )
