"""Chat formatting: typed content parts to one marked text, with a loss mask and attachment records."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TURN_END, PART = "<turn:", "</turn>", "<part:"
_CONTROL = re.compile(r"\\|<turn:|</turn>|<part:")
_ROLE = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_READ = re.compile(r"\\.|<turn:((?:\\.|[^\\>])*)>|</turn>\n|<part:(\w*):(\d+)>", re.S)

PART_TYPE = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENTS = "array<struct<number: int, kind: string, ref: string, at: bigint, tokens: bigint>>"
SPANS = "array<struct<start: bigint, length: bigint>>"
SEGMENTS = f"conv_id long, position long, role string, segment string, start long, loss {SPANS}, attachments {ATTACHMENTS}, attachment_tokens long"


def escape(text: str) -> str:
    """A backslash before every backslash and control string; ``unescape`` takes them away again."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class PartCosts:
    """How many tokens a model spends on an attachment in place of its placeholder."""

    image_tile: int = 512
    tokens_per_tile: int = 170
    image_base: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 1024


class PartVisitor:
    """Visits the parts of one turn in order; collects the flattened text, the text spans and the attachments.

    Unknown part types become placeholders of their name that cost nothing; a part without a type is text.
    """

    def __init__(self, at: int, first: int, costs: PartCosts):
        self.at, self.number, self.costs = at, first, costs
        self.out: list[str] = []
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if text:
            self.texts.append((self.at, len(text)))
        self._put(text)

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.costs.image_tile) * math.ceil((part.get("height") or 0) / self.costs.image_tile)
        self._attach("image", part, self.costs.image_base + self.costs.tokens_per_tile * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.costs.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.costs.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._attach(re.sub(r"\W", "_", part["type"]), part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"number": self.number, "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": int(tokens)})
        self._put(f"{PART}{kind}:{self.number}>")
        self.number += 1

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _segments(costs: PartCosts, learned: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, start, number = object(), 0, 0, 0  # of the conversation that is being read
        for batch in batches:
            rows = []
            for conv_id, role, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != current:
                    current, position, start, number = conv_id, 0, 0, 0
                head = f"{TURN}{_ROLE.sub(r'\\\g<0>', role)}>"
                visitor = PartVisitor(start + len(head), number, costs)
                for part in parts:
                    visitor.visit(part)
                segment = f"{head}{''.join(visitor.out)}{TURN_END}\n"
                loss = [{"start": a, "length": n} for a, n in visitor.texts] if role in learned else []
                tokens = sum(a["tokens"] for a in visitor.attachments)
                rows.append((conv_id, position, role, segment, start, loss, visitor.attachments, tokens))
                position, start, number = position + 1, start + len(segment), visitor.number
            yield _batch(rows, _SEGMENT_SCHEMA)

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_ATTACHMENT = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
_SEGMENT_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("role", pa.string()),
        ("segment", pa.string()),
        ("start", pa.int64()),
        ("loss", _SPAN),
        ("attachments", _ATTACHMENT),
        ("attachment_tokens", pa.int64()),
    ]
)


def format_turns(turns: DataFrame, content: Column | None = None, costs: PartCosts = PartCosts(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted text of every conversation, one segment per turn in order; the segments joined are the whole text.

    ``turns`` has conv_id, turn, role and text, or ``content`` gives typed parts (``PART_TYPE`` arrays) instead of the text.
    ``segment`` holds the turn mark with the role, the flattened parts and the end mark; ``start`` is its code point offset
    in the conversation; ``loss`` the spans of learned text (turns of the roles in ``learned``); ``attachments`` each
    placeholder's number, kind, reference, offset and the tokens it expands to.

    Turns are ordered by turn (null first), then role and text; null roles and texts count as empty; rows without a
    conv_id are one conversation; repeated rows are turns of their own; an empty table gives no rows. A task holds the
    counters of one conversation and a batch of rows, however long the conversation is.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if content is None else F.lit("")
    if content is None:
        empty = "cast(null as {0}) as {1}".format
        parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.expr(empty(*p)) for p in (("string", "ref"), ("int", "width"), ("int", "height"), ("double", "seconds"), ("int", "pages")))))
    else:
        parts = F.coalesce(content, F.array().cast(f"array<{PART_TYPE}>"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts").drop("turn")
    return ordered.mapInArrow(_segments(costs, frozenset(learned)), SEGMENTS)


def read_formatted(text: str) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """Turns of a formatted text as (role, unescaped text, placeholders); anything outside a turn is an error."""
    turns, at, begun = [], 0, None
    body: list[str] = []
    marks: list[tuple[str, int]] = []
    for m in _READ.finditer(text):
        if begun is not None:
            body.append(text[at : m.start()])
        elif m.start() != at:
            raise ValueError(f"text between turns at {at}")
        at, found = m.end(), m[0]
        if found[0] == "\\":
            if begun is None:
                raise ValueError(f"text between turns at {m.start()}")
            body.append(found[1])
        elif found.startswith(TURN):
            if begun is not None:
                raise ValueError(f"a turn inside a turn at {m.start()}")
            begun = unescape(m[1])
        elif found.startswith(PART):
            marks.append((m[2], int(m[3])))
        else:
            if begun is None:
                raise ValueError(f"the end of no turn at {m.start()}")
            turns.append((begun, "".join(body), marks))
            begun, body, marks = None, [], []
    if begun is not None or at != len(text):
        raise ValueError("the last turn does not end")
    return turns


_DIGEST_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, loss: list[dict]) -> None:
        for role, text, _ in read_formatted(segment):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(segment[span["start"] - start : span["start"] - start + span["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None

    for incoming in batches:
        done = []
        for conv_id, segment, start, loss in zip(*(c.to_pylist() for c in incoming.columns)):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(segment, start, loss)
        if done:
            yield _batch(done, _DIGEST_SCHEMA)
    if current is not None:
        yield _batch([current.row()], _DIGEST_SCHEMA)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What reading the formatted text back gives per conversation: turns, learned text and lengths, as digests."""
    ordered = segments.select("conv_id", "position", "segment", "start", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.drop("position").mapInArrow(_digests, schema)
