"""What several corpus operators need: stored intermediate tables, joins that survive hot keys, connected components."""

from __future__ import annotations

import functools
import string
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
#: Heavy groups are those with at least this share of all rows, so there are at most as many as its inverse.
HEAVY_SHARE = 1e-3
#: Lets Spark delete the shuffle files of a query as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The columns of documents that operators read by name.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_STORED: dict[int, tuple[weakref.ref, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: lineage ends, a lost executor costs no rework.

    What was shuffled for it is not read again and leaves the disk at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more (what was made from them has been stored as well)."""
    for df in tables:
        known, path = _STORED.pop(id(df), (None, None))
        if known is not None and known() is df:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_own_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let ``work`` (documents to documents) see other columns under names of their own, so that none clashes with its own."""

    @functools.wraps(work)
    def renamed(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        inner = docs.toDF(*(c if c in DOCUMENT_COLUMNS else f"__column_{i}" for i, c in enumerate(names)))
        return work(inner, *args, **kwargs).toDF(*names)

    return renamed


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, safe when one key holds a large share of all rows.

    ``size`` names the column of ``groups`` with the key's row count. Groups of at least ``total * HEAVY_SHARE`` rows are
    at most ``1 / HEAVY_SHARE`` in number: that bound, whatever the input, makes them safe to broadcast, so their rows
    never meet in one task. All other keys join by shuffle.
    """
    least = max(1000.0, total * HEAVY_SHARE)
    heavy, light = F.broadcast(groups.where(F.col(size) >= least)), groups.where(F.col(size) < least)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def row_key(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns, nulls included: rows with the same key are the same row repeated."""
    columns = [F.col(c) for c in docs.columns]
    values = [*columns, *(c.isNull() for c in columns)]
    return [F.xxhash64(*values).alias("_k1"), F.xxhash64(F.lit(1), *values).alias("_k2")]


def repeat_rows(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``counts`` (``_k1``, ``_k2``, ``_repeats``, ``_copies``) says for their ``row_key``.

    ``_repeats`` is how often the row occurs in ``docs``, ``_copies`` how often all its occurrences together shall occur.
    Texts shuffle once; only rows that occur more than once are reduced to one first.
    """
    keyed, columns = docs.select("*", *row_key(docs)), docs.columns
    found = keyed.join(counts.where("_copies > 0"), ["_k1", "_k2"])
    found = found.where("_repeats = 1").unionByName(found.where("_repeats > 1").dropDuplicates(["_k1", "_k2"]))
    once = found.where("_copies = 1").select(columns)
    more = found.where("_copies > 1").select(*columns, F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"))
    return once.unionByName(more.select(columns))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (``a``, ``b``): rows (``node``, ``root``), root the smallest node reached.

    Alternates large-star and small-star steps until every node has one edge, to a node that has none; the number of rounds
    grows with the logarithm of a component's size. Every step is a map-side combined minimum and one join whose hot nodes
    are broadcast by the bound of ``join_groups``. Nodes without an edge to another node do not appear. Nulls are not allowed.
    """
    edges = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), name)
    while not _are_stars(edges):
        large = stored(_large_star(edges), name)
        discard(edges)
        edges = stored(_small_star(large), name)
        discard(large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge down to the centre of its star."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre"), (F.col("a") < F.col("b")).alias("wrong"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("centre"), F.lit(False).alias("wrong")))
    found = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"), F.max("wrong").alias("wrong"))
    return found.where((F.col("up") + F.col("centre") > 1) | F.col("wrong")).isEmpty()


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest v of u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    total = pairs.count()
    return join_groups(pairs, least, "u", "degree", total)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = _nearest(both).withColumn("m", F.least("m", "u"))
    return near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = _nearest(down)
    moved = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()
