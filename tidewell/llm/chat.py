"""Chat formatting with a grammar that reads back what was written.

A turn is written as ``### role:\n``, its text and ``</turn>\n``. A backslash before a control string or another
backslash takes away its meaning. Text is written as it is where the parser then recovers it; otherwise control strings
are escaped, and where that isn't enough, backslashes too. Every turn is parsed before it counts as written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import Scratch, let_workers_import

OPEN, CLOSE = "### ", "</turn>"
#: What a turn of the template looks like: the first unescaped colon and line end close the role, the first unescaped mark the text.
_TURN = re.compile(r"### ((?:[^\\:]+|\\.|:(?!\n))*+):\n((?:[^\\<]+|\\.|<(?!/turn>\n))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\|### |</turn>|:\n)")
_CONTROL = re.compile(r"### |</turn>|:\n")
_ANY = re.compile(r"\\|### |</turn>|:\n")
LEVELS = 3
#: Characters of a conversation that one row or one task's memory holds at once.
PIECE_BYTES = 1 << 20


def escape(text: str, level: int) -> str:
    """0: as it is; 1: control strings; 2: backslashes as well, which always reads back."""
    if level == 0:
        return text
    return (_CONTROL if level == 1 else _ANY).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the written text) of each turn; raises if the grammar doesn't cover the whole string."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """One turn that parses to (role, text), and the level of escaping that it took."""
    for level in range(LEVELS):
        out = f"{OPEN}{escape(role, level)}:\n{escape(text, level)}{CLOSE}\n"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out, level
        except ValueError:
            pass
    raise ValueError("a turn doesn't read back")


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with ``rendered`` and, in code points of it, the span of its text in the loss mask.

    Returns conv_id, turn, role, text, rendered, level, loss_start, loss_end; the span is null except in an assistant's
    turn. The rendered turns of a conversation, in order, are its training text. A null text or role counts as empty.
    """

    let_workers_import(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [parse(m[0])[0][2:] if r == "assistant" else (None, None) for r, m in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int32()), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()),
                ],
                ["conv_id", "turn", "role", "text", "rendered", "level", "loss_start", "loss_end"],
            )

    cols = turns.select(F.col("conv_id"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, turn long, role string, text string, rendered string, level int, loss_start int, loss_end int")


class _Digest:
    """What is read back from a conversation's training text, turn by turn."""

    def __init__(self) -> None:
        self.n = self.loss = self.chars = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        for role, text, _, _ in parse(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())
        self.chars += len(rendered)

    def row(self, conv) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


_DIGEST = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted text read back through the parser.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are ordered by turn, role and
    text, nulls first; repeated rows are turns like any other. A null text or role counts as empty, and null
    conv_ids are one conversation. An empty table gives an empty result. Other columns are ignored.

    Rows are dealt by ranges of conv_id, turn and role, so formatting a conversation of any length is spread over tasks.
    Short ones that lie within one task are finished there. The first and the last of a task may go on
    elsewhere; their text and that of long ones goes in large pieces to a task that reads them as a stream, as a
    digest of a whole can only be made in order.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    keys = ["conv_id", "turn", "role"]
    ordered = format_turns(turns).select(*keys, "text", "rendered").repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    digest_kinds = [("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)), *_DIGEST]
    digest_names = [n for n, _ in digest_kinds]
    kinds = [*digest_kinds, ("part", pa.int32()), ("piece", pa.int32()), ("body", pa.string())]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conv, texts, size, piece, first, begun = None, [], 0, 0, True, False
        found: list[tuple] = []

        def flush(last: bool) -> None:
            if first or last or piece:
                found.append((conv, None, None, None, None, None, part, piece, "".join(texts)))
            else:
                digest = _Digest()
                for t in texts:
                    digest.add(t)
                found.append((*digest.row(conv), None, None, None))

        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and c != conv:
                    flush(False)
                    texts, size, piece, first = [], 0, 0, False
                conv, begun = c, True
                if size + len(text) > PIECE_BYTES and texts:
                    found.append((conv, None, None, None, None, None, part, piece, "".join(texts)))
                    texts, size, piece = [], 0, piece + 1
                texts.append(text)
                size += len(text)
            if found:
                yield rows(found)
                found.clear()
        if begun:
            flush(True)
            yield rows(found)

    kind = f"conv_id {dict(turns.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    made = scratch.keep(ordered.select("conv_id", "rendered").mapInArrow(finish, kind + ", part int, piece int, body string"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            found: list[tuple] = []
            for c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and c != conv:
                    found.append((*digest.row(conv), None, None, None))
                    digest = None
                conv, digest = c, digest or _Digest()
                digest.add(body)
            if found:
                yield rows(found).select(digest_names)
        if digest is not None:
            yield rows([(*digest.row(conv), None, None, None)]).select(digest_names)

    open_ = made.where("part is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    whole = made.where("part is null").select(digest_names)
    return whole.unionByName(open_.select("conv_id", "body").mapInArrow(join_up, kind))
