"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import WORD, join_groups, repeat_rows, row_key, stored, text_or_empty, with_own_names
from tracewarden.session import bounded_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: The dual has one variable per source, kept on the driver; beyond this many the job stops with an error.
MOST_SOURCES = 1_000_000
TOLERANCE, MOST_STEPS = 1e-7, 60
#: Documents of one source and size are ranked in buckets of about this many.
BUCKET = 20_000


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times the source.

    Weights repeat over the sources in code point order, null last. What a source cannot give is shared by weight among
    those below their limit, until none is above: all of these end at one common multiple of their weights.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: float(most * sizes[s]) for s in order}
    left, rest, targets = share * sum(sizes.values()), set(order), {}
    while rest:
        each = left / sum(weight[s] for s in rest)
        full = {s for s in rest if limit[s] <= weight[s] * each}
        if not full:
            targets |= {s: weight[s] * each for s in rest}
            break
        targets |= {s: limit[s] for s in full}
        left, rest = left - sum(limit[s] for s in full), rest - full
    return targets


def _tilts(cells: DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """The dual variable of every source, by Newton steps whose sums Spark takes over all cells.

    Rates exp(tilt * size / scale), at most MOST_COPIES, are the closest to one copy each (in relative entropy) that meet
    the token constraint; the dual is convex and separates by source. A step that leaves the bracket of the root so far
    is replaced by halving the bracket. A source whose target is its limit takes all it has.
    """
    state = sources.assign(tilt=0.0, low=-np.inf, high=np.inf)
    full = state["target"] >= MOST_COPIES * state["source_size"] * (1 - 1e-12)
    state.loc[full, "tilt"] = np.inf
    open_ = ~full & (state["target"] > 0)
    spark = cells.sparkSession
    for _ in range(MOST_STEPS):
        if not open_.any():
            break
        now = spark.createDataFrame(state.loc[open_, ["place", "tilt", "scale"]])
        x = F.col("size") / F.col("scale")
        raw, tokens = F.exp(F.least(F.col("tilt") * x, F.lit(50.0))), F.col("n") * F.col("size")
        sums = (
            cells.join(now, "place")
            .groupBy("place")
            .agg(
                F.sum(tokens * F.least(raw, F.lit(float(MOST_COPIES)))).alias("taken"),
                F.sum(F.when(raw < MOST_COPIES, tokens * x * raw).otherwise(0.0)).alias("slope"),
            )
            .toPandas()  # a row per open source
            .set_index("place")
        )
        for place, (taken, slope) in zip(sums.index, sums.to_numpy()):
            row = state.loc[place]
            off = taken - row["target"]
            if abs(off) <= TOLERANCE * row["target"]:
                open_[place] = False
                continue
            state.loc[place, "high" if off > 0 else "low"] = row["tilt"]
            low, high = state.loc[place, "low"], state.loc[place, "high"]
            step = row["tilt"] - off / slope if slope > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if np.isfinite(low + high) else row["tilt"] + (1.0 if off < 0 else -1.0) * (1 + abs(row["tilt"]))
            state.loc[place, "tilt"] = step
    return state


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the cells of one source: every document of a cell has ``base`` copies and ``extra`` of them one more.

    From long to short, each cell takes the number nearest to what is due, and carries the words over or short to the next.
    """
    cells = cells.sort_values("size", ascending=False)
    due, extra = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"]):
        due += n * (rate - math.floor(rate)) * size
        k = min(max(round(due / size), 0), n) if size else 0
        due -= k * size
        extra.append(k)
    return cells.assign(base=np.floor(cells["rate"]).astype(np.int64), extra=np.array(extra, np.int64))[["place", "size", "n", "base", "extra"]]


def _planned(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` by key, with its size, its source's size and target, and its copies."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), *row_key(docs),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = stored(rows, "mix-rows")
    totals = bounded_rows(rows.groupBy("source").agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size").cast("double")).alias("q")), MOST_SOURCES, "sources")
    targets = source_targets({r["source"]: r["s"] for r in totals})
    order = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = pd.DataFrame(
        [(i, r["s"], targets[r["source"]], max(1.0, r["q"] / max(r["s"], 1))) for i, r in enumerate(order)], columns=["place", "source_size", "target", "scale"]
    ).astype({"place": "int64", "source_size": "int64", "target": "float64", "scale": "float64"})
    spark = docs.sparkSession
    named = spark.createDataFrame([(i, r["source"], r["s"], targets[r["source"]]) for i, r in enumerate(order)], "place long, source string, source_size long, target double")
    total = rows.count()
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = stored(counts.join(named, counts["source"].eqNullSafe(named["source"])).select("place", "size", "n"), "mix-cells")
    state = _tilts(cells, sources)
    tilts = spark.createDataFrame(state[["place", "tilt", "scale"]]) if len(state) else spark.createDataFrame([], "place long, tilt double, scale double")
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(MOST_COPIES)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt") == float("inf"), float(MOST_COPIES)).otherwise(rate)
    copies = cells.join(tilts, "place").withColumn("rate", rate).groupBy("place").applyInPandas(_rounded, "place long, size long, n long, base long, extra long")
    copies = copies.join(named, "place").withColumn("cell", F.xxhash64("place", "size"))
    copies = stored(copies, "mix-copies")

    # the documents of a cell in a reproducible order, in buckets where a cell has many
    keyed = rows.join(named.select("place", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("cell", F.xxhash64("place", "size")).drop("source", "size", "place")
    found = join_groups(keyed, copies, "cell", "n", total).withColumn("order", F.xxhash64(F.lit(17), "_k1", "_k2"))
    found = found.withColumn("bucket", F.expr(f"cast(pmod(order, cast(ceil(n / {BUCKET}) as long)) as int)"))
    large = found.where(F.col("n") > BUCKET).groupBy("cell", "bucket").agg(F.count("*").alias("in_bucket"))
    ahead = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    large = large.select("cell", "bucket", F.sum("in_bucket").over(ahead).alias("ahead"))
    within = Window.partitionBy("cell", "bucket").orderBy("order", "_k1", "_k2")
    ranked = found.withColumn("rank", F.row_number().over(within)).join(large, ["cell", "bucket"], "left")
    chosen = F.col("rank") + F.coalesce("ahead", F.lit(0)) <= F.col("extra")
    return ranked.withColumn("copies", F.col("base") + F.when(chosen, 1).otherwise(0))


def mixing_plan(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    A document's size is its number of words; ``taken`` is copies times size. Null texts and texts without words have size
    0 and one copy; a null source is a source of its own, ordered last; null ids and repeated rows are rows like others; an
    empty table gives none. The result depends on the rows alone, not on their order or partitions.
    """
    return _planned(docs).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@with_own_names
def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan says; other columns may have any name.

    Rows repeated as a whole count together; nulls, empty texts and an empty table as in ``mixing_plan``.
    """
    counts = _planned(docs).groupBy("_k1", "_k2").agg(F.count("*").alias("_repeats"), F.sum("copies").alias("_copies"))
    return repeat_rows(docs, stored(counts, "mix-counts"))
