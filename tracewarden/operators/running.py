"""Order statistics of everything up to each moment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import stored

#: A task holds the counts of this many seconds by this many parts of the values.
BLOCK_SECONDS, PARTS = 3600, 256


def _numbered(values: DataFrame) -> DataFrame:
    """(``value``, ``code``): distinct values numbered in their order, by range partitions and their offsets."""
    ranged = stored(
        values.distinct().repartitionByRange("value").sortWithinPartitions("value").select("value", F.monotonically_increasing_id().alias("at")), "value-ranges"
    )
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select("value", (F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("code"))


def _looked_up(share: float):
    """For each moment asked for, the part of the values that holds its rank, and the rank within that part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["kind"].to_numpy()
        events, asked, earlier = (rows[kind == k] for k in (1, 2, 0))
        times = np.unique(np.concatenate([events["time"].to_numpy(), asked["time"].to_numpy()]))
        counts = np.zeros((len(times), PARTS), np.int64)
        np.add.at(counts, (np.searchsorted(times, events["time"]), events["digit"].to_numpy()), events["n"].to_numpy())
        counts[0] += np.bincount(earlier["digit"], earlier["n"], PARTS).astype(np.int64) if len(earlier) else 0
        # up to each moment, and up to each part
        upto = counts.cumsum(axis=0)[np.searchsorted(times, asked["time"])].cumsum(axis=1)
        rank = asked["n"].to_numpy()
        rank = np.where(rank > 0, rank, np.maximum(1, np.ceil(share * upto[:, -1]).astype(np.int64)))
        digit = (upto < rank[:, None]).sum(axis=1)
        below = np.where(digit > 0, upto[np.arange(len(upto)), digit - 1], 0)
        return pd.DataFrame({"time": asked["time"], "block": asked["block"], "prefix": asked["prefix"] * PARTS + digit, "n": rank - below})

    return run


def running_quantile(counts: DataFrame, share: float = 0.5) -> DataFrame:
    """(``time``, ``value``) for every time in ``counts`` (``time`` in seconds, ``value``, ``n``): the quantile of all rows up to it.

    The quantile is the smallest value that at least ``share`` of the rows do not exceed. Values are numbered in order; a
    moment finds its value digit by digit, PARTS to a digit. For each digit, counts by block of time and part of the values, summed
    over the blocks before, give every block a start of its own, so blocks are looked into side by side, and only in the
    part that their moments ask for. Rows without a value do not count; a time with none so far has no row.
    """
    known = counts.where("value is not null and n > 0")
    numbered = stored(_numbered(known.select("value")), "running-values")
    total = numbered.count()
    block = F.floor(F.col("time") / BLOCK_SECONDS).cast("long")
    coded = known.join(numbered, "value").groupBy("time", "code").agg(F.sum("n").alias("n")).withColumn("block", block)
    coded = stored(coded, "running-counts")
    wanted = counts.select("time").distinct().select("time", block.alias("block"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("n"))
    levels = max(1, math.ceil(math.log(max(total, 2), PARTS) - 1e-9))
    for level in reversed(range(levels)):
        size = PARTS**level
        parts = coded.withColumn("prefix", F.expr(f"code div {size * PARTS}")).withColumn("digit", F.expr(f"cast(code div {size} % {PARTS} as int)"))
        here = wanted.select("block", "prefix").distinct()
        per_block = parts.groupBy("prefix", "digit", "block").agg(F.sum("n").alias("n"))
        asked = here.select("prefix", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("digit"), "block", F.lit(0).cast("long").alias("n"))
        sums = per_block.unionByName(asked).groupBy("prefix", "digit", "block").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("prefix", "digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        earlier = sums.withColumn("n", F.sum("n").over(before)).where("n > 0").join(here, ["block", "prefix"], "left_semi")
        events = parts.join(here, ["block", "prefix"], "left_semi").groupBy("block", "prefix", "time", "digit").agg(F.sum("n").alias("n"))
        nothing = F.lit(0)
        columns = ["kind", "block", "prefix", "time", "digit", "n"]
        rows = earlier.select(nothing.alias("kind"), "block", "prefix", nothing.cast("long").alias("time"), "digit", "n")
        rows = rows.unionByName(events.withColumn("kind", F.lit(1)).select(columns))
        rows = rows.unionByName(wanted.select(F.lit(2).alias("kind"), "block", "prefix", "time", nothing.alias("digit"), "n"))
        found = rows.groupBy("block", "prefix").applyInPandas(_looked_up(share), "time long, block long, prefix long, n long")
        # the last digit of a moment before the first value runs off the numbers
        wanted = stored(found, "running-ranks")
    return wanted.select("time", F.col("prefix").alias("code")).join(numbered, "code").select("time", "value")
