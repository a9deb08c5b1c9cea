"""Robustness augmentation: encode attack texts in one or two ways and measure what is still detected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.encoders import ENCODERS

NAMES = list(ENCODERS)


def _digit(key: Column, seed: int, salt: str) -> Column:
    """Number from the first seven hex digits of a sha1."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", key.cast("string"), F.lit(f"{seed}{salt}"))), 1, 7), 16, 10).cast("long")


def choices(key: Column, seed: int) -> tuple[Column, Column]:
    """Two distinct encoder numbers."""
    first = (_digit(key, seed, "a") % len(NAMES)).cast("int")
    step = (_digit(key, seed, "b") % (len(NAMES) - 1)).cast("int") + 1
    return first, (first + step) % len(NAMES)


def _encode(text: Column, number: Column, key: Column, seed: int) -> Column:
    out = F.when(F.lit(False), text)
    for i, name in enumerate(NAMES):
        out = out.when(number == i, ENCODERS[name](text, key, seed))
    return out.otherwise(text)


def augment(df: DataFrame, columns: list[str], mode: str = "single", key: str = "req_id", seed: int = 42) -> DataFrame:
    """Encode text columns with one encoder (``single``), two distinct ones in turn (``double``) or not at all (``none``).

    The choice follows from id and seed, so a rerun gives the same rows. ``encoding`` names what was applied.
    """
    if mode == "none":
        return df.withColumn("encoding", F.lit("none"))
    if mode not in ("single", "double"):
        raise ValueError(f"unknown mode: {mode}")
    first, second = choices(F.col(key), seed)
    names = F.array(*[F.lit(n) for n in NAMES])
    marked = df.withColumns({"__a": first, "__b": second})
    out = marked.withColumns({c: _encode(F.col(c), F.col("__a"), F.col(key), seed) for c in columns})
    label = F.get(names, F.col("__a"))
    if mode == "double":
        out = out.withColumns({c: _encode(F.col(c), F.col("__b"), F.col(key), seed) for c in columns})
        label = F.concat(label, F.lit("+"), F.get(names, F.col("__b")))
    return out.withColumn("encoding", label).drop("__a", "__b")


def robustness_report(encoded: DataFrame, matches: DataFrame, key: str = "req_id") -> DataFrame:
    """Share of the augmented requests that at least one rule matched, by encoding."""
    hit = matches.select(key).distinct().withColumn("hit", F.lit(1.0))
    joined = encoded.select(key, "encoding").join(hit, key, "left")
    return joined.groupBy("encoding").agg(
        F.count("*").alias("requests"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("detection_rate")
    )
