"""Exact k nearest neighbours through pivots and triangle bounds, without a pair table.

References are dealt into blocks: the cell of their nearest pivot, cut into rings by the distance to it. In a first round
every query meets one block and learns a radius within which its k nearest must lie. In a second round it visits only the
blocks that the triangle inequality does not rule out for that radius. Pivots and block bounds are tables of bounded size;
vectors meet in tasks of bounded size, and only the k best of a visit leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import bounded_rows, stored

#: References in a block and queries that meet them in one task; both are exceeded only by chance of hashing.
BLOCK_ROWS, QUERY_ROWS = 8192, 16_384
#: Queries of a task whose distances are taken by one matrix product.
AT_ONCE = 128
#: Pivots (a block each, the root of the references and this number at most) and rings of a cell: their bounds travel to every task.
MOST_PIVOTS, MOST_RINGS = 1024, 64

_FOUND = "q_id bigint, neighbour bigint, distance double, label int"


def _distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, a column per point."""
    out = np.empty((len(vectors), len(points)))
    for i, point in enumerate(points):
        out[:, i] = np.sqrt(((vectors - point) ** 2).sum(axis=1))
    return out


def _placed(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                distance = _distances(np.stack(rows["r_vec"].to_numpy()), pivots)
                cell = distance.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), far=distance[np.arange(len(rows)), cell])

    return run


class _Bounds:
    """Pivots, and of every block its pivot, its smallest and largest distance to it and its number of parts."""

    def __init__(self, pivots: np.ndarray, blocks: pd.DataFrame):
        self.pivots, self.pivot = pivots, blocks["cell"].to_numpy()
        self.low, self.high, self.salts = (blocks[c].to_numpy() for c in ("low", "high", "salts"))

    def least(self, vectors: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of each vector to all members of each block.

        A member lies within low to high of its pivot, and it is no nearer to any other pivot than to its own.
        """
        distance = _distances(vectors, self.pivots)
        own = distance[:, self.pivot]
        ring = np.maximum(own - self.high, self.low - own)
        return np.maximum(np.maximum(ring, (own - distance.min(axis=1, keepdims=True)) / 2), 0)

    def home(self, ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = least.argmin(axis=1)
        return block, ids % self.salts[block]


def _homes(bounds: _Bounds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                block, salt = bounds.home(rows["q_id"].to_numpy(), bounds.least(np.stack(rows["q_vec"].to_numpy())))
                yield rows.assign(block=block.astype(np.int32), salt=salt.astype(np.int64))

    return run


def _visits(bounds: _Bounds):
    """A row for each query and block (but its home) that may hold something within the query's radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                some = rows.iloc[at : at + 256]
                ids, radius = some["q_id"].to_numpy(), some["radius"].to_numpy()
                least = bounds.least(np.stack(some["q_vec"].to_numpy()))
                home, home_salt = bounds.home(ids, least)
                # the bounds are sums of rounded numbers: leave them room
                query, block = np.nonzero(least <= (radius * (1 + 1e-9) + 1e-9)[:, None])
                parts = bounds.salts[block]
                query, block = np.repeat(query, parts), np.repeat(block, parts)
                salt = np.arange(len(query)) - np.repeat(np.cumsum(parts) - parts, parts)
                new = (block != home[query]) | (salt != home_salt[query])
                query, block, salt = query[new], block[new], salt[new]
                yield some.iloc[query].assign(block=block.astype(np.int32), salt=salt.astype(np.int64))

    return run


def _near(vectors: np.ndarray, radius: np.ndarray, own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, reference) that hold the k nearest of each query, its ties and little else.

    Squared distances come from one matrix product; ``room`` is far more than it rounds off. Where squares overflow, all stay.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        squares, norms = (matrix**2).sum(axis=1), (vectors**2).sum(axis=1)
        most = np.nan_to_num(squares, nan=0, posinf=np.inf).max() + norms
        room = np.where(np.isfinite(most), most * (1e-15 * (matrix.shape[1] + 16)), np.inf)
        square = norms[:, None] + squares - 2 * (vectors @ matrix.T)
        square[np.isnan(square)] = np.inf
        square[ids == own[:, None]] = np.inf
        limit = (radius * (1 + 1e-9)) ** 2
        if square.shape[1] > k:
            limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1])
        return np.nonzero((square <= (limit + 2 * room)[:, None]) & (ids != own[:, None]))


def _best(k: int):
    """The k nearest references of each query of a task, within the query's radius; ties go to the smaller id."""

    def run(queries: pd.DataFrame, references: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q_id": [], "neighbour": [], "distance": [], "label": []})]
        if len(queries) and len(references):
            ids, labels = references["r_id"].to_numpy(), references["r_label"].to_numpy()
            matrix = np.stack(references["r_vec"].to_numpy())
            for at in range(0, len(queries), AT_ONCE):
                some = queries.iloc[at : at + AT_ONCE]
                vectors, own, radius = np.stack(some["q_vec"].to_numpy()), some["q_id"].to_numpy(), some["radius"].to_numpy()
                query, ref = _near(vectors, radius, own, matrix, ids, k)
                distance = np.sqrt(((matrix[ref] - vectors[query]) ** 2).sum(axis=1))
                inside = distance <= radius[query]
                query, ref, distance = query[inside], ref[inside], distance[inside]
                order = np.lexsort((ids[ref], distance, query))
                query, ref, distance = query[order], ref[order], distance[order]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, ref, distance = query[best], ref[best], distance[best]
                out.append(pd.DataFrame({"q_id": own[query], "neighbour": ids[ref], "distance": distance, "label": labels[ref]}))
        return pd.concat(out)

    return run


def _compared(visits: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """Queries meet the references of their block; a block with many visits is copied to several tasks."""
    place = ["block", "salt"]
    tasks = visits.groupBy(*place).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("tasks"))
    left = visits.join(tasks, place).withColumn("task", F.pmod(F.xxhash64("q_id"), F.col("tasks"))).drop("tasks")
    right = references.join(tasks, place).withColumn("task", F.explode(F.expr("sequence(0L, tasks - 1)"))).drop("tasks")
    keys = [*place, "task"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), _FOUND)


def _blocks(references: DataFrame, block_rows: int) -> tuple[np.ndarray, DataFrame, list]:
    """Pivots, the references with their cell and ring, and the bounds of all blocks."""
    total = references.count()
    # where bounds rule nothing out each query is copied to each block, so blocks are not smaller than they may be
    wanted = min(MOST_PIVOTS, int(np.ceil(np.sqrt(total))), -(-total // block_rows))
    few = references.orderBy(F.xxhash64("r_id"), "r_id").limit(wanted).select("r_vec").collect()
    pivots = np.array([r["r_vec"] for r in few], np.float64)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in references.schema.fields)
    placed = stored(references.mapInPandas(_placed(pivots), f"{kinds}, cell int, far double"), "neighbour-cells")
    cells = placed.groupBy("cell").agg(
        F.least(F.ceil(F.count("*") / block_rows), F.lit(MOST_RINGS)).cast("int").alias("rings"), F.min("far").alias("near"), F.max("far").alias("reach")
    )
    ring = F.expr("least(rings - 1, cast(if(reach > near, (far - near) / (reach - near) * rings, 0) as int))")
    placed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("rings", "near", "reach")
    found = placed.groupBy("cell", "ring").agg(
        F.min("far").alias("low"), F.max("far").alias("high"), F.ceil(F.count("*") / block_rows).cast("long").alias("salts")
    )
    return pivots, placed, bounded_rows(found.orderBy("cell", "ring"), MOST_PIVOTS * MOST_RINGS, "blocks of neighbours")


def nearest(
    queries: DataFrame, references: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    label: str = "label", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(key, neighbour, distance, label, rank)``; a vector is never its own neighbour; ties go to the smaller id.

    Rows without a key or a vector take no part. With fewer than k references a query gets those there are.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(key).cast("long").alias("q_id"), F.col(vector).cast("array<double>").alias("q_vec")).dropna()
    r = references.select(F.col(key).cast("long").alias("r_id"), F.col(vector).cast("array<double>").alias("r_vec"), F.col(label).cast("int").alias("r_label"))
    r = r.dropna(subset=["r_id", "r_vec"])
    if r.isEmpty():
        return spark.createDataFrame([], f"{key} bigint, neighbour bigint, distance double, label int, rank int")
    pivots, placed, blocks = _blocks(r, block_rows)
    table = pd.DataFrame([b.asDict() for b in blocks]).assign(block=range(len(blocks)))
    bounds = _Bounds(pivots, table)
    numbered = spark.createDataFrame(table[["cell", "ring", "block", "salts"]], "cell int, ring int, block int, salts bigint")
    dealt = placed.join(F.broadcast(numbered), ["cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64("r_id"), F.col("salts")))
    dealt = dealt.select("block", "salt", "r_id", "r_vec", "r_label")

    kinds = "q_id bigint, q_vec array<double>, radius double, block int, salt bigint"
    first = stored(_compared(q.withColumn("radius", F.lit(float("inf"))).mapInPandas(_homes(bounds), kinds), dealt, k), "neighbours-at-home")
    radius = first.groupBy("q_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("radius"))
    known = q.join(radius, "q_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    more = _compared(stored(known.mapInPandas(_visits(bounds), kinds), "neighbour-visits"), dealt, k)
    order = Window.partitionBy("q_id").orderBy("distance", "neighbour")
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("q_id", key)


def knn_classify(queries: DataFrame, references: DataFrame, k: int = 5, key: str = "vec_id", **options) -> DataFrame:
    """Majority label of the k nearest; a tie goes to the smaller label."""
    votes = nearest(queries, references, k, key, **options).groupBy(key, "label").agg(F.count("*").alias("votes"))
    return votes.groupBy(key).agg(
        F.max_by(F.col("label"), F.struct(F.col("votes"), -F.col("label"))).alias("prediction")
    )
