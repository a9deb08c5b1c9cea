"""Document fingerprints: a homomorphic multiset hash over paragraphs, with a likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.session import bounded_rows

#: A fingerprint is two vectors of sums: one decides equality (modulo 2^32), the other likeness (64-bit counts, which do not wrap).
EQUAL_LANES, LIKE_LANES = 32, 128
WINDOW = 8
#: Documents of one bucket of neighbours, and the most buckets (their bounds are kept on the driver).
BUCKET, MOST_BUCKETS = 2000, 4096

_TAILS = np.array([(1 << 8 * n) - 1 for n in range(WINDOW)] + [2**64 - 1], dtype=np.uint64)


class MultisetHash:
    """Sums of vectors hashed from paragraphs (lines): equal for equal multisets of paragraphs, whatever their order.

    The first vector of a paragraph is the output of an extendable hash of all its bytes, so that different multisets
    differ in the sums but by chance of 1 in 2^1024. The second adds, for each window of eight bytes, one up or down in a
    lane, so that texts with common passages have sums pointing the same way. Sums of both are additive: paragraphs can be
    inserted or deleted without the rest of the text, and two fingerprints add up to that of both texts together.
    """

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint32) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, np.int64) if like is None else like

    @classmethod
    def of(cls, text: str) -> MultisetHash:
        return cls.of_many([text])[0]

    @classmethod
    def of_many(cls, texts: list[str]) -> list[MultisetHash]:
        data = [t.encode("utf-8", "replace") for t in texts]
        return [cls(e, s) for e, s in zip(map(_equal_sums, data), _like_sums(data))]

    @classmethod
    def from_hex(cls, digits: str) -> MultisetHash:
        raw = bytes.fromhex(digits)
        width = (len(raw) - 4 * EQUAL_LANES) // LIKE_LANES
        return cls(np.frombuffer(raw, "<u4", EQUAL_LANES).copy(), np.frombuffer(raw, f"<i{width}", LIKE_LANES, 4 * EQUAL_LANES).astype(np.int64))

    def hex(self) -> str:
        """Both vectors; the counts take the fewest bytes (1, 2, 4 or 8 each) that hold all of them."""
        width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(self.like).max() < 1 << 8 * w - 1)
        return self.equal.astype("<u4").tobytes().hex() + self.like.astype(f"<i{width}").tobytes().hex()

    def insert(self, paragraphs: str) -> MultisetHash:
        more = MultisetHash.of(paragraphs)
        return MultisetHash(self.equal + more.equal, self.like + more.like)

    def delete(self, paragraphs: str) -> MultisetHash:
        less = MultisetHash.of(paragraphs)
        return MultisetHash(self.equal - less.equal, self.like - less.like)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and bool((self.equal == other.equal).all())

    def likeness(self, other: MultisetHash) -> float:
        """1 for equal multisets, else the cosine of the second vectors, at least 0."""
        if self == other:
            return 1.0
        a, b = (x.like.astype(np.float64) for x in (self, other))
        norm = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


def _equal_sums(data: bytes) -> np.ndarray:
    vectors = b"".join([hashlib.shake_128(p).digest(4 * EQUAL_LANES) for p in data.split(b"\n")])
    return np.frombuffer(vectors, "<u4").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint32)


def _like_sums(data: list[bytes]) -> np.ndarray:
    """Per text, the signed counts of its windows: every eight bytes within a paragraph, or a shorter paragraph whole."""
    joined = b"\n".join(data) + b"\n" * (WINDOW + 1)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(d) + 1 for d in data])
    total = int(sizes.sum())
    windows = np.ndarray((total,), "<u8", buffer=joined, strides=(1,))  # eight bytes from each position
    breaks = np.flatnonzero(raw[:total] == 10)
    whole = np.ones(total, bool)
    for back in range(WINDOW):  # a window that would reach over a line end
        whole[np.maximum(breaks - back, 0)] = False
    begins = np.concatenate([[0], breaks[:-1] + 1])
    lengths = breaks - begins
    short = (lengths > 0) & (lengths < WINDOW)
    whole[0] = lengths[0] >= WINDOW if len(lengths) else False
    at = np.concatenate([np.flatnonzero(whole), begins[short]])
    values = np.concatenate([windows[whole], windows[begins[short]] & _TAILS[lengths[short]]])
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    slot = (mixed >> np.uint64(56)).astype(np.int64)  # seven bits of lane, one of sign
    text = np.repeat(np.arange(len(data)), sizes)[at]
    counts = np.bincount(text * 2 * LIKE_LANES + slot, minlength=len(data) * 2 * LIKE_LANES).reshape(len(data), LIKE_LANES, 2)
    return counts[:, :, 0] - counts[:, :, 1]


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of another text, or all it has."""
    changed = len(text) // 3
    return text[: len(text) - changed] + following[:changed]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, borrowed, doc_id, text), each bucket followed by the document after its last; one row per own document."""
    waiting: tuple | None = None  # the last document, whose neighbour is still to come
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = [c.to_pylist() for c in batch.slice(at, 64).columns]
            own = MultisetHash.of_many(some[3])
            pairs = []
            for bucket, borrowed, doc_id, text, print_ in zip(*some, own):
                if waiting is not None and waiting[0] == bucket:
                    pairs.append((waiting, text, print_))
                waiting = None if borrowed else (bucket, doc_id, text, print_)
            edited = [edited_text(w[2], following) for w, following, _ in pairs]
            rows = []
            for (w, _, next_print), text, print_ in zip(pairs, edited, MultisetHash.of_many(edited)):
                mine = w[3]
                sha = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
                rows.append((w[1], len(w[2]), sha, mine.hex(), print_.hex(), mine.likeness(print_), mine.likeness(next_print)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document in descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. After the last document
    comes the first. Documents with the same id follow each other by their texts; a null id is the smallest; a null text
    counts as empty; a single document is its own neighbour; an empty table gives no rows. Texts are taken whole, whatever
    their length: likeness counts do not wrap. Repeated rows follow each other. Other columns are not read.

    Documents are dealt to buckets of neighbouring ids; each bucket borrows the first document of the next one, so a task
    streams through its buckets and texts shuffle once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id").agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    parts = min(MOST_BUCKETS, max(1, -(-ids["n"] // BUCKET)))
    bounds: list[int] = []
    if ids["known"]:
        shares = [i / parts for i in range(1, parts)]
        bounds = rows.agg(F.approx_percentile("doc_id", shares, 20 * parts)).first()[0] if shares else []
    limits = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def bounds_passed(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, doc_id.to_numpy(), side="right").astype(np.int32))

    # larger ids come first, null ids last
    bucket = F.lit(len(limits)) - bounds_passed(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")))
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(limits) + 1).otherwise(bucket))
    firsts = bounded_rows(dealt.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket"), MOST_BUCKETS + 1, "buckets")
    lends = [(r["bucket"], r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    lends = docs.sparkSession.createDataFrame(lends, "bucket int, first long, lend_to int")  # at most MOST_BUCKETS + 1 rows
    dealt = dealt.join(F.broadcast(lends), "bucket")
    lent = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("lend_to").alias("bucket"), F.lit(True).alias("borrowed"))))
    places = F.concat(F.array(F.struct("bucket", F.lit(False).alias("borrowed"))), F.coalesce(lent, F.array().cast("array<struct<bucket: int, borrowed: boolean>>")))
    placed = dealt.select(F.inline(places), "doc_id", "text")
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compared, schema)
