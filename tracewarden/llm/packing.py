"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import stored
from tracewarden.llm.tokens import ByteBpe, tokenizer_path

TIERS = (2048, 1024, 512, 256)
END = 1
#: Rests of documents held back while a task looks for good fits.
POOL = 1024
#: Tokens of a step group; every group of a tier has as many sequences.
STEP_TOKENS = 131_072


@dataclass(slots=True)
class Piece:
    """Consecutive ids of one document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class TierPacker:
    """Packs pieces into full sequences, longest tier first; holds at most a pool of short pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.tiers, self.pool = tiers, pool
        self.waiting: list[tuple[int, int, Piece]] = []  # by length, then order of arrival
        self.arrivals = self.tokens = 0

    def _wait(self, piece: Piece) -> None:
        self.arrivals += 1
        self.tokens += len(piece.ids)
        insort(self.waiting, (len(piece.ids), self.arrivals, piece), key=lambda x: x[:2])

    def _take(self, at: int) -> Piece:
        length, _, piece = self.waiting.pop(at)
        self.tokens -= length
        return piece

    def _window(self, size: int) -> list[Piece]:
        """One full sequence: the longest waiting pieces that fit, of this tier first, then of shorter ones.

        A gap that no whole piece fits is filled by the front of the shortest longer piece, whose rest goes back.
        """
        window, gap = [], size
        while gap and (fits := bisect_right(self.waiting, gap, key=lambda x: x[0])):
            window.append(self._take(fits - 1))
            gap -= len(window[-1].ids)
        if gap:
            piece = self._take(0)
            window.append(Piece(piece.doc_id, piece.start, piece.ids[:gap], piece.doc_tokens))
            self._wait(Piece(piece.doc_id, piece.start + gap, piece.ids[gap:], piece.doc_tokens))
        return window

    def _pack(self, until: int) -> Iterator[tuple[int, list[Piece]]]:
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while len(self.waiting) > until and self.waiting[-1][0] > below and self.tokens >= tier:
                yield tier, self._window(tier)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        """Sequences (tier, pieces) that a document completes."""
        longest, n = self.tiers[0], len(ids)
        cut = n - n % longest
        for start in range(0, cut, longest):
            yield longest, [Piece(doc_id, start, ids[start : start + longest], n)]
        if cut < n:
            self._wait(Piece(doc_id, cut, ids[cut:].copy(), n))
        if len(self.waiting) >= self.pool:
            yield from self._pack(self.pool // 2)

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """All that waits: full sequences of ever shorter tiers, then at most one that is not full."""
        yield from self._pack(0)
        if self.waiting:
            yield self.tiers[-1], [x[2] for x in self.waiting]
            self.waiting, self.tokens = [], 0


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part int, tier_sequence long"


def _packed(files: tuple[str, str], tiers: tuple[int, ...], with_ids: bool):
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, part = ByteBpe(*files), TierPacker(tiers), TaskContext.get().partitionId()
        made, in_tier, rows = 0, dict.fromkeys(tiers, 0), []

        def note(sequences) -> None:
            nonlocal made
            for tier, pieces in sequences:
                offset = 0
                for p in pieces:
                    data = p.ids.tobytes()
                    row = (p.doc_id, p.start, len(p.ids), zlib.crc32(data), p.doc_tokens, (part << 40) + made, offset, tier, part, in_tier[tier])
                    rows.append((*row, data) if with_ids else row)
                    offset += len(p.ids)
                made += 1
                in_tier[tier] += 1

        def batch() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * with_ids
            columns = zip(*rows) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            rows.clear()
            return out

        for incoming in batches:
            for doc_id, text in zip(*incoming.columns):
                note(packer.add(doc_id.as_py(), np.append(bpe.encode(text.as_py()), np.uint32(END))))
                if len(rows) >= 4096:
                    yield batch()
        note(packer.finish())
        yield batch()

    return run


def pack_documents(docs: DataFrame, files: tuple[str, str] | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence, with its step group; ``with_ids`` adds the ids as 32-bit bytes.

    ``files``: a tokenizer file and the same vocabulary as ranks.

    Every document's ids and an end id are routed by length: full longest windows leave at once, the rest waits in the
    shortest tier that holds it. Each task packs its own rows, longest tier first, fills gaps from shorter tiers, and cuts
    a piece only where no whole one fits, so all sequences but the last of a task are exactly as long as their tier. No
    text is shuffled and no task holds more than a pool of rests. ``docs`` should be a stored table: the order of its rows
    in a split decides the sequences.

    Sequences of a tier are numbered over all tasks and dealt to step groups of STEP_TOKENS tokens each.
    Null texts count as empty (one end id), null ids are kept, repeated rows are documents of their own, an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = PIECES + ", ids binary" * with_ids
    pieces = stored(rows.mapInArrow(_packed(files or (tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")), tuple(tiers), with_ids), schema), "packed")
    per_task = pieces.groupBy("tier", "part").agg((F.max("tier_sequence") + 1).alias("_n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    group = F.expr(f"(_before + tier_sequence) div ({STEP_TOKENS} div tier)").alias("step_group")
    kept = [c for c in pieces.columns if c not in ("part", "tier_sequence")]
    return pieces.join(per_task, ["tier", "part"]).select(*kept, group)
