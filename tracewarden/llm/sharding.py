"""Shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import stored, text_or_empty

#: Row numbers are dealt from this many hash buckets, each numbered by a task of its own.
BUCKETS = 4096
#: Equal rows are counted before the shuffle and written out again in runs of at most this many.
RUN = 65_536
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _round_keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, ROUNDS)]


def permute(numbers: np.ndarray, size: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..size-1: a Feistel network on the next even number of bits, walked until it lands inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    low, keys = np.uint64((1 << int(half)) - 1), _round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & low), left
            else:
                left, right = right, left ^ (_mix(right, key) & low)
        return (left << half) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def row_of(shard: np.ndarray, slot: np.ndarray, size: int, shards: int, seed: int) -> np.ndarray:
    """The global row number found at a shard and slot."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), size, seed, inverse=True)


def number_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The named columns with ``row_number`` 0..n-1 (a function of the rows' values alone), and n.

    Equal rows are counted first, so no bucket grows with copies of one row; a bucket's running totals start where the
    buckets before it end (at most BUCKETS numbers are broadcast). Nulls are values like any other.
    """
    counted = df.select(columns).groupBy(columns).agg(F.count("*").alias("_n"))
    counted = stored(counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")), "shard-rows")
    totals = counted.groupBy("_bucket").agg(F.sum("_n").alias("_in")).orderBy("_bucket").collect()  # at most BUCKETS rows
    starts, at = [], 0
    for row in totals:
        starts.append((row["_bucket"], at))
        at += row["_in"]
    offsets = df.sparkSession.createDataFrame(starts, "_bucket int, _offset long")
    within = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = counted.withColumn("_end", F.sum("_n").over(within)).join(F.broadcast(offsets), "_bucket")
    runs = runs.select(*columns, "_n", (F.col("_offset") + F.col("_end") - F.col("_n")).alias("_start"))
    few = runs.where(F.col("_n") <= RUN).withColumn("_at", F.col("_start"))
    many = runs.where(F.col("_n") > RUN).withColumn("_at", F.explode(F.expr(f"sequence(_start, _start + _n - 1, {RUN}L)"))).repartition("_at")
    numbers = F.explode(F.expr(f"sequence(_at, least(_start + _n, _at + {RUN}) - 1)"))
    return few.unionByName(many).select(*columns, numbers.alias("row_number")), at


def shard_rows(df: DataFrame, columns: list[str], shards: int, seed: int = 2024) -> DataFrame:
    """The named columns with ``row_number``, ``shard`` and ``slot``: a reproducible shuffle into equal shards.

    The position of a row is its number sent through the permutation; shard = position mod shards, slot = position div
    shards, so shard sizes differ by one at most, slots have no gaps, and both can be computed for any row, or the row for
    any slot (``row_of``), without a sort. Same rows, same seed: same result, whatever the partitioning.
    """
    numbered, size = number_rows(df, columns)

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), size, seed))

    placed = numbered.withColumn("_position", position("row_number"))
    return placed.select(
        *columns,
        "row_number",
        F.pmod("_position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_position div {shards}").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 2024) -> DataFrame:
    """Documents by id, size and checksum into shards. A null text counts as empty, a null id as a value."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
