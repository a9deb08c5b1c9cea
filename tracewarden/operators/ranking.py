"""Exact ranks and percentiles without bringing a group into one task.

Rows are counted by bucket of the order key, offsets of the buckets follow from the counts (a small table), and rows are
numbered within their bucket only. A label or name that holds most of the rows is thus ranked by many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int) -> Column:
    """Order key of a reproducible shuffle: sha1 of id and seed."""
    return F.sha1(F.concat(key.cast("string"), F.lit(f":{seed}")))


def rank_by_hash(df: DataFrame, group: str, order: str, hex_digits: int = 4) -> DataFrame:
    """Add ``rank`` (1…) and ``group_size`` within ``group`` by a hex text ``order``; buckets are its first digits."""
    df = df.withColumn("__bucket", F.coalesce(F.substring(order, 1, hex_digits), F.lit("")))
    counts = df.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    in_group = Window.partitionBy(group)
    earlier = in_group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__group"),
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(in_group).alias("group_size"),
    )
    within = Window.partitionBy(group, "__bucket").orderBy(order)
    numbered = df.withColumn("__in_bucket", F.row_number().over(within))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__b"))
    return (
        numbered.join(offsets, same)
        .withColumn("rank", (F.col("__before") + F.col("__in_bucket")).cast("long"))
        .drop("__bucket", "__before", "__in_bucket", "__group", "__b")
    )


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: of every label the first ``round(n * test_size)`` rows in shuffled order."""
    ranked = rank_by_hash(df.withColumn("__order", shuffle_key(F.col(key), seed)), label, "__order")
    held_out = F.round(F.col("group_size") * F.lit(test_size))
    return ranked.withColumn("is_test", F.col("rank") <= held_out).drop("__order", "rank", "group_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0…k-1), balanced within every label."""
    ranked = rank_by_hash(df.withColumn("__order", shuffle_key(F.col(key), seed)), label, "__order")
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("__order", "rank", "group_size")


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))


def exact_percentiles(counts: DataFrame, groups: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Discrete percentiles per group from value counts (``__value``, ``__n``).

    Percentile p is the smallest value with at least ``ceil(p * n)`` values at or below it. A histogram over logarithmic
    bins (4096 per octave) tells which bin holds each rank; only those bins are looked at value by value.
    """
    value = F.col("__value")
    bin_of = F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 4096).cast("long")
    binned = counts.withColumn("__bin", bin_of)
    hist = binned.groupBy(*groups, "__bin").agg(F.sum("__n").alias("__bin_n"))
    by_bin = Window.partitionBy(*groups).orderBy("__bin")
    upto = F.sum("__bin_n").over(by_bin.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__bin_n").over(Window.partitionBy(*groups))
    placed = hist.select(*groups, "__bin", (upto - F.col("__bin_n")).alias("__before"), upto.alias("__upto"), total.alias("__total"))
    ranks = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.greatest(F.lit(1), F.ceil(F.lit(round(p, 6)).cast("decimal(8,6)") * F.col("__total"))).cast("long").alias("rank"),
            )
            for name, p in probabilities.items()
        ]
    )
    inside = lambda r: (r["rank"] > F.col("__before")) & (r["rank"] <= F.col("__upto"))
    needed = placed.withColumn("__ranks", F.filter(ranks, inside)).filter(F.size("__ranks") > 0).drop("__upto", "__total")
    in_bin = Window.partitionBy(*groups, "__bin").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    null_safe = reduce(
        lambda a, b: a & b, [F.col(f"b.{g}").eqNullSafe(F.col(f"w.{g}")) for g in groups], F.col("b.__bin") == F.col("w.__bin")
    )
    candidates = (
        binned.alias("b").join(needed.alias("w"), null_safe).select("b.*", "w.__before", "w.__ranks")
        .withColumn("__cum", F.col("__before") + F.sum("__n").over(in_bin))
    )
    hit = F.explode(F.filter("__ranks", lambda r: (r["rank"] <= F.col("__cum")) & (r["rank"] > F.col("__cum") - F.col("__n"))))
    found = candidates.select(*groups, hit.alias("r"), "__value")
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("r.name") == name, F.col("__value"))).alias(name) for name in probabilities]
    )


def block_count(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
