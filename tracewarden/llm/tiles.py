"""Links within groups of any size, compared in tiles of bounded size; tasks return spanning forests, never all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import components, discard, join_groups, stored

#: About this many members of a large group are shown to every tile of the group.
CENTRES = 16


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the sets of paired places; ``parent`` leads from every place straight to the smallest of its set."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def forest(ids: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    """One edge for every member that is not the first of its set."""
    moved = np.flatnonzero(ids != ids[parent])
    return pd.DataFrame({"a": ids[moved], "b": ids[parent[moved]]})


def _compared(tiles: DataFrame, linked: Callable[[pd.DataFrame], pd.DataFrame], name: str) -> DataFrame:
    return stored(tiles.groupBy("cell", "tile").applyInPandas(linked, "a long, b long"), name)


def group_links(members: DataFrame, linked: Callable[[pd.DataFrame], pd.DataFrame], tile: int, cell: int, name: str) -> DataFrame:
    """Edges (``a``, ``b``) that connect the ids of every group as all its links do.

    ``members``: ``group``, ``id``, ``weight``, the group's ``size`` (sum of weights) and ``rows``, and what ``linked`` needs; a
    stored table. ``linked`` gets the rows of one or more whole groups and returns a spanning forest of each group's links. Groups
    of up to ``tile`` weight are compared whole, as many in one task as ``cell`` weight holds. Of a larger group each tile has some
    members and the group's centres, so that most links are found at one copy a member; then only members outside the
    group's main component meet all the others. No pair of members in different components stays uncompared.
    """
    total = members.agg(F.sum("weight")).first()[0]
    if not total:
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    cells = int(-(-total // cell))
    none = F.lit(-1).cast("long")
    small = members.where(F.col("size") <= tile).select("*", F.pmod(F.xxhash64("group"), F.lit(cells)).alias("cell"), none.alias("tile"))
    large = members.where(F.col("size") > tile).withColumn("cell", F.col("group")).withColumn("blocks", F.expr(f"size div {tile} + 1"))
    large = large.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    centres = large.where(F.pmod(F.xxhash64("id", F.lit(2)), F.expr(f"rows div {CENTRES} + 1")) == 0)
    centres = centres.withColumn("tile", F.explode(F.expr("sequence(0L, blocks - 1)")))
    edges = _compared(small.unionByName(large.drop("blocks")).unionByName(centres.drop("blocks")), linked, name)
    if large.isEmpty():
        return edges

    joined = components(edges, name)
    placed = large.select("group", "id", "rows", "weight").join(joined.withColumnRenamed("node", "id"), "id", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "id")), f"{name}-placed")
    main = placed.groupBy("group", "root").agg(F.count("*").alias("n"), F.max("rows").alias("rows"))
    main = stored(main.groupBy("group").agg(F.max(F.struct("n", "root")).alias("m"), F.max("rows").alias("rows")), f"{name}-mains")
    apart = join_groups(placed.drop("rows"), main.where("m.n < rows"), "group", "rows", placed.count()).where("root != m.root")
    apart = stored(apart.select("group", "id", "weight"), f"{name}-apart")
    rest = apart.groupBy("group").agg(F.expr(f"sum(weight) div {tile} + 1").alias("apart"))
    # every tile of members apart meets every tile of the group
    both = join_groups(large, rest.join(main.select("group", F.col("rows").alias("group_rows")), "group"), "group", "group_rows", members.count())
    both = both.join(apart.select("group", "id", F.lit(True).alias("is_apart")), ["group", "id"], "left")
    visits = both.withColumn("other", F.explode(F.expr("sequence(0L, apart - 1)"))).withColumn("tile", F.expr("tile * apart + other"))
    homes = both.where("is_apart").withColumn("other", F.pmod(F.xxhash64("id", F.lit(3)), F.col("apart")))
    homes = homes.withColumn("tile", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("tile", F.expr("tile * apart + other"))
    extra = ("blocks", "apart", "is_apart", "other", "group_rows")
    more = _compared(visits.drop(*extra).unionByName(homes.drop(*extra)), linked, name)
    discard(placed, apart, main)
    return edges.unionByName(more)
