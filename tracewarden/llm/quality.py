"""Document quality: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewarden.llm.common import text_or_empty, with_own_names
from tracewarden.session import bounded_rows

#: Filters see WIDTH bytes; chunks of two blocks overlap by one block and cover the whole text.
WIDTH, EMBED, FILTERS, BLOCK = 8, 8, 24, 32
#: Labelled documents learned from, and bytes of each: pieces of PIECE bytes spread evenly over its whole length.
MOST_LABELLED, PIECES, PIECE = 3000, 6, 256
EPOCHS, BATCH, RATE = 8, 24, 5e-3
THRESHOLD = 0.3


@dataclass
class Padded:
    """Texts as one byte array: each starts a block, is filled up with zeros, and is followed by a block of zeros, so that
    no filter reaches from one text into the next."""

    data: np.ndarray
    own: np.ndarray  # the blocks that belong to texts
    first_block: np.ndarray  # of each text, among those
    blocks: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Padded:
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-(sizes + 1) // BLOCK)
        data = b"".join([t.ljust(int(n + 1) * BLOCK, b"\0") for t, n in zip(texts, blocks)]) + b"\0" * WIDTH
        first = np.cumsum(blocks) - blocks
        own = np.arange(blocks.sum()) + np.repeat(np.arange(len(texts)), blocks)
        return cls(np.frombuffer(data, np.uint8), own, first, blocks)


@dataclass
class ByteConvNet:
    """Bytes are embedded, filters slide over them, each chunk keeps every filter's maximum, and the mean and the maximum of
    the chunks of a text are combined by a logistic layer into one probability."""

    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    combine: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 5) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        small = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(small(0.5, 256, EMBED), small(0.2, WIDTH, EMBED, FILTERS), np.zeros(FILTERS, np.float32), small(0.1, 2 * FILTERS), np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.combine, self.offset]

    def _pair_tables(self) -> np.ndarray:
        """Sums of filter outputs for every pair of bytes at offsets 0-1, 2-3, ...: the convolution by look-up."""
        single = np.einsum("be,wef->wbf", self.embed, self.filters)
        pairs = single[0::2, :, None, :] + single[1::2, None, :, :]
        return pairs.reshape(WIDTH // 2, 65_536, FILTERS).astype(np.float32)

    def scores(self, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
        """One probability per text, from all of its bytes."""
        tables = self._pair_tables() if tables is None else tables
        padded = Padded.of(texts)
        pairs = padded.data[:-1].astype(np.int32) * 256 + padded.data[1:]
        total, step = len(padded.data) // BLOCK, 256
        peaks = np.empty((total, FILTERS), np.float32)
        for at in range(0, total, step):  # a few thousand positions at a time stay in cache
            low, high = at * BLOCK, min(at + step, total) * BLOCK
            out = tables[0].take(pairs[low:high], axis=0)
            for k in range(1, WIDTH // 2):
                out += tables[k].take(pairs[low + 2 * k : high + 2 * k], axis=0)
            peaks[at : at + step] = out.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return _sigmoid(self._pooled(peaks[padded.own], padded) @ self.combine + self.offset[0])

    def _pooled(self, peaks: np.ndarray, padded: Padded) -> np.ndarray:
        chunks = np.maximum(_chunk_peaks(peaks, padded) + self.bias, 0)
        mean = np.add.reduceat(chunks, padded.first_block, axis=0) / padded.blocks[:, None].astype(np.float32)
        return np.concatenate([mean, np.maximum.reduceat(chunks, padded.first_block, axis=0)], axis=1)

    def learn(self, texts: list[bytes], labels: np.ndarray, seed: int = 9) -> ByteConvNet:
        """Adam steps on the logistic loss, back through the maxima."""
        rng = np.random.default_rng(seed)
        first, second, steps = [np.zeros_like(a) for a in self.arrays()], [np.zeros_like(a) for a in self.arrays()], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some, steps = order[at : at + BATCH], steps + 1
                for a, m, v, g in zip(self.arrays(), first, second, self._slopes([texts[i] for i in some], labels[some])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    a -= np.float32(RATE) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        return self

    def _slopes(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        padded = Padded.of(texts)
        n = len(padded.data) // BLOCK * BLOCK
        embedded = self.embed[padded.data]
        windows = np.concatenate([embedded[k : n + k] for k in range(WIDTH)], axis=1)  # n x (WIDTH * EMBED)
        weights = self.filters.reshape(WIDTH * EMBED, FILTERS)
        out = (windows @ weights).reshape(-1, BLOCK, FILTERS)[padded.own]
        inside = out.argmax(axis=1)
        peaks = np.take_along_axis(out, inside[:, None, :], axis=1)[:, 0, :]
        block = np.arange(len(peaks))
        last = np.zeros(len(peaks), bool)
        last[padded.first_block + padded.blocks - 1] = True
        following = np.where(last, block, block + 1)
        source = np.where(peaks[following] > peaks, following[:, None], block[:, None])  # the block a chunk's maximum is in
        chunks = np.maximum(np.take_along_axis(peaks, source, axis=0) + self.bias, 0)
        mean = np.add.reduceat(chunks, padded.first_block, axis=0) / padded.blocks[:, None]
        most = np.maximum.reduceat(chunks, padded.first_block, axis=0)
        pooled = np.concatenate([mean, most], axis=1).astype(np.float32)

        wrong = (_sigmoid(pooled @ self.combine + self.offset[0]) - labels).astype(np.float32) / len(texts)
        text = np.repeat(np.arange(len(texts)), padded.blocks)
        is_most = chunks == most[text]
        share = is_most / np.maximum(np.add.reduceat(is_most, padded.first_block, axis=0, dtype=np.float32), 1)[text]
        to_chunk = wrong[text, None] * (self.combine[:FILTERS] / padded.blocks[text, None] + self.combine[FILTERS:] * share)
        to_chunk = np.where(chunks > 0, to_chunk, 0).astype(np.float32)

        # a window's slope reaches filters and embedding through its bytes: sum slopes by (offset, filter, byte) first
        position = padded.own[source] * BLOCK + np.take_along_axis(inside, source, axis=0)
        chunk, f = np.nonzero(to_chunk)
        seen = padded.data[position[chunk, f] + np.arange(WIDTH)[:, None]]
        places = (np.arange(WIDTH)[:, None] * FILTERS + f) * 256 + seen
        sums = np.bincount(places.ravel(), np.tile(to_chunk[chunk, f], WIDTH), WIDTH * FILTERS * 256).reshape(WIDTH, FILTERS, 256).astype(np.float32)
        to_filters, to_embed = np.einsum("wfb,be->wef", sums, self.embed, optimize=True), np.einsum("wfb,wef->be", sums, self.filters, optimize=True)
        return [to_embed, to_filters, to_chunk.sum(axis=0), wrong @ pooled, wrong.sum(keepdims=True)]


def _chunk_peaks(peaks: np.ndarray, padded: Padded) -> np.ndarray:
    """Maxima of each block and the one after it, within a text."""
    out = peaks.copy()
    np.maximum(out[:-1], peaks[1:], out=out[:-1])
    last = padded.first_block + padded.blocks - 1
    out[last] = peaks[last]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def _pieces(text: Column) -> Column:
    """Bytes of a text for learning: all of it, or pieces spread from its start to its end."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    starts = [(F.lit(i) * (size - PIECE) / (PIECES - 1)).cast("int") + 1 for i in range(PIECES)]
    return F.when(size <= PIECES * PIECE, raw).otherwise(F.concat(*(F.substring(raw, s, F.lit(PIECE)) for s in starts)))


def fit_quality(docs: DataFrame, labels: DataFrame) -> ByteConvNet | None:
    """The network, learned from at most MOST_LABELLED labelled rows that are not held out (the lowest by a hash).

    A label counts once per doc_id (the lowest if they differ); null labels and rows without a label are not used. Without
    rows of both labels there is nothing to learn, and the result is None.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.where(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED)
    texts = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "_id")
    picked = texts.select(_pieces(F.col("text")).alias("piece"), "_label", F.xxhash64("_id").alias("h")).orderBy("h", "piece").limit(MOST_LABELLED)
    rows = bounded_rows(picked, MOST_LABELLED, "labelled rows")
    targets = np.array([r["_label"] for r in rows], np.float32)
    if not len(rows) or targets.min() == targets.max():
        return None
    return ByteConvNet.fresh().learn([bytes(r["piece"]) for r in rows], targets)


def _scored(net: ByteConvNet | None, name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net._pair_tables() if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                if net:
                    values = net.scores([t.encode("utf-8", "replace") for t in some.column(some.num_columns - 1).to_pylist()], tables)
                else:
                    values = np.full(some.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], name])

    return run


def score_quality(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, from the whole text and nothing else.

    Null texts count as empty and have a score as well; repeated rows are scored each; without a network all scores are
    0.5; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_scored(net), "doc_id long, score double")


def quality_decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches THRESHOLD) of every row."""
    scores = score_quality(docs, fit_quality(docs, labels))
    return scores.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@with_own_names
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with all their columns, whatever their names; texts do not shuffle.

    Null and empty texts are scored like any other, repeated rows each; an empty table stays empty.
    """
    net = fit_quality(docs, labels)
    schema = StructType([*docs.schema.fields, StructField("_quality_score", DoubleType())])
    scored = docs.select("*", text_or_empty().alias("_quality_text")).mapInArrow(_scored(net, "_quality_score"), schema)
    return scored.where(F.col("_quality_score") >= THRESHOLD).drop("_quality_score")
