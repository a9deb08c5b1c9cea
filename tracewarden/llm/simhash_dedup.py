"""Near-duplicate documents: SimHash fingerprints joined exactly through a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import components, discard, join_groups, repeat_rows, row_key, stored, with_own_names

SEED = 42
#: The tree's balls are fitted on at most this many fingerprints; every fingerprint is then routed through it.
SAMPLE = 8192
MAX_DEPTH = 10
#: Aim for this many fingerprints in a leaf; and most rows of either side that one task compares.
LEAF = 2048
HOME_BLOCK, VISIT_BLOCK = 4096, 65_536

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> bytes:
    """XXH64 (UTF-8, seed 42) of every word shingle as 8 big-endian bytes, repeats included; no words: nothing."""
    found = text.encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not found:
        return b""
    shingles = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    return b"".join([xxhash.xxh64_digest(s, SEED) for s in map(b" ".join, shingles)])


def fingerprints(texts: list[str], words: int) -> np.ndarray:
    """A bit is set when over half of a text's shingle hashes have it set; a text without words gets 0."""
    out, hashed = np.zeros(len(texts), np.uint64), [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(h) // 8 for h in hashed])
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    values = np.frombuffer(b"".join(hashed), ">u8").astype(np.uint64)
    sizes = sizes[filled]
    # eight bit counters of 8 bits in a word overflow after 255 hashes, so count in runs of that length
    runs = -(-sizes // 255)
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
    counts = np.empty((len(filled), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((values >> np.uint64(shift)) & _LANES, starts)
        counts[:, shift::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint64)
    out[filled] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                values = fingerprints(some.column(3).to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(values)], names=["doc_id", "_k1", "_k2", "fp"])

    return run


@dataclass
class VantageTree:
    """A full binary tree of balls over 64-bit fingerprints: left within the radius of the vantage point, right beyond."""

    depth: int
    vantage: np.ndarray
    radius: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> VantageTree:
        rng, nodes = np.random.default_rng(7), 2**depth - 1
        vantage, radius = np.zeros(nodes, np.uint64), np.full(nodes, 32, np.int16)
        parts = {0: np.sort(sample)}
        for node in range(nodes):
            points = parts.pop(node)
            if len(points):
                tried = rng.choice(points, min(8, len(points)), replace=False)
                distances = np.bitwise_count(tried[:, None] ^ points[None, :]).astype(np.int16)
                best = int(distances.std(axis=1).argmax())  # the widest spread prunes most
                vantage[node], radius[node] = tried[best], np.median(distances[best])
                inside = distances[best] <= radius[node]
            else:
                inside = np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = points[inside], points[~inside]
        return cls(depth, vantage, radius)

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, point's index, whether the leaf is its home) for every leaf that may hold a point within ``reach``.

        By the triangle inequality, what lies within ``reach`` of a point at distance d from the vantage point is itself at
        a distance of d - reach to d + reach; a branch outside that range is pruned.
        """
        index, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            distance = np.bitwise_count(points[index] ^ self.vantage[node]).astype(np.int16)
            radius = self.radius[node]
            inside = distance <= radius
            left, right = np.flatnonzero(distance <= radius + reach), np.flatnonzero(distance > radius - reach)
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            home = np.concatenate([home[left] & inside[left], home[right] & ~inside[right]])
            index = np.concatenate([index[left], index[right]])
        return node - (2**self.depth - 1), index, home


def _routed_rows(tree: VantageTree, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(points), 4096):
                some = points[at : at + 4096]
                leaf, index, home = tree.route(some, reach)
                columns = [pa.array(leaf.astype(np.int32)), pa.array(some[index].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "fp", "home"])

    return run


def link(homes: np.ndarray, visits: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (point, root) of the links of ``homes`` to ``visits``; never more rows than points.

    Points are ordered by their distance to one more vantage point, and only rings at most ``reach`` apart are compared.
    """
    points = np.unique(np.concatenate([homes, visits]))
    parent = np.arange(len(points))
    pivot = homes[0]
    home_ring, visit_ring = (np.bitwise_count(x ^ pivot).astype(np.int64) for x in (homes, visits))
    home_order, visit_order = np.argsort(home_ring, kind="stable"), np.argsort(visit_ring, kind="stable")
    homes, home_ring, visits, visit_ring = homes[home_order], home_ring[home_order], visits[visit_order], visit_ring[visit_order]
    home_at, visit_at = np.searchsorted(points, homes), np.searchsorted(points, visits)
    for ring in np.unique(home_ring):
        low, high = np.searchsorted(home_ring, [ring, ring + 1])
        first, last = np.searchsorted(visit_ring, [ring - reach, ring + reach + 1])
        step = max(1, 4_000_000 // max(1, last - first))
        for at in range(low, high, step):
            block = homes[at : min(at + step, high)]
            h, v = np.nonzero(np.bitwise_count(block[:, None] ^ visits[None, first:last]) <= reach)
            _unite(parent, home_at[at + h], visit_at[first + v])
    moved = np.flatnonzero(parent != np.arange(len(points)))
    return points[moved], points[parent[moved]]


def _unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the sets of paired points; ``parent`` leads from every point straight to its set's smallest."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def _linked_cells(reach: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        fp, home = cell["fp"].to_numpy().view(np.uint64), cell["home"].to_numpy()
        homes, visits = fp[home], fp[~home]
        if not len(homes) or not len(visits):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = link(homes, visits, reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def near_fingerprints(distinct: DataFrame, reach: int) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct fingerprints ``fp`` linked at ``reach`` or fewer differing bits.

    Each fingerprint has a home leaf and visits the leaves whose bounds overlap its reach. A leaf is compared in cells of
    at most HOME_BLOCK homes and VISIT_BLOCK visits (a dense leaf has more cells, not a larger one), and a cell returns
    a spanning forest, never all its pairs. No pair is lost: the tree only decides where two fingerprints meet.
    """
    total = distinct.count()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(total, 1) / LEAF)))))
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()] if depth else []
    tree = VantageTree.fit(np.array(sample, np.int64).view(np.uint64), depth)
    routed = stored(distinct.select("fp").mapInArrow(_routed_rows(tree, reach), "leaf int, fp long, home boolean"), "vantage-routed")
    # at most 2^MAX_DEPTH leaves
    leaves = routed.groupBy("leaf").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / HOME_BLOCK).cast("int").alias("home_blocks"), F.ceil(F.count("*") / VISIT_BLOCK).cast("int").alias("visit_blocks")
    )
    rows = routed.join(F.broadcast(leaves.where("home_blocks > 0")), "leaf").withColumn("h", F.xxhash64("fp", F.lit(1)))
    every = "sequence(0, {0}_blocks - 1)"
    homes = rows.where("home").select(
        "leaf", "fp", "home", F.expr("cast(pmod(h, home_blocks) as int)").alias("hb"), F.explode(F.expr(every.format("visit"))).alias("vb")
    )
    visits = rows.select(
        "leaf", "fp", F.lit(False).alias("home"), F.explode(F.expr(every.format("home"))).alias("hb"), F.expr("cast(pmod(h, visit_blocks) as int)").alias("vb")
    )
    edges = stored(homes.unionByName(visits).groupBy("leaf", "hb", "vb").applyInPandas(_linked_cells(reach), "a long, b long"), "vantage-links")
    discard(routed)
    return edges


def _row_components(docs: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(doc_id, _k1, _k2, fp, root, component_id, component_size) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), text.alias("text"))
    prints = stored(rows.mapInArrow(_fingerprint_rows(words), "doc_id long, _k1 long, _k2 long, fp long"), "fingerprints")
    total = prints.count()
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = near_fingerprints(distinct, max_bits)
    found = components(edges, "near-duplicates")
    discard(edges)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted-fingerprints")
    sets = stored(
        rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("members")), "components"
    )
    by_print = join_groups(rooted, sets, "root", "members", total).select("fp", "n", "component_id", "component_size", "root")
    by_print = stored(by_print, "print-components")
    discard(distinct, rooted, sets)
    return join_groups(prints, by_print, "fp", "n", total).drop("n")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``component_size`` (rows).

    Fingerprints link at ``max_bits`` or fewer differing bits; a component's id is the smallest doc_id reachable through
    links. Null and empty texts, and texts without words, have fingerprint zero and link like any other; a null id takes no
    part in the smallest id (null only if no row of the component has one); repeated rows each give a row; an empty table
    gives none.
    """
    found = _row_components(docs, words, max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


@with_own_names
def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """The documents that stay, with all their columns: of each component the row with the smallest id (nulls last).

    Rows that share that id count by a hash of all their columns; of a row repeated as a whole one stays. Null, empty and very long
    texts count as ``near_duplicates`` says; other columns may have any name; an empty table stays empty.
    """
    found = _row_components(docs, words, max_bits)
    rows = found.groupBy("root", "doc_id", "_k1", "_k2").agg(F.count("*").alias("_repeats"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_k1", "_k2", "_repeats")).alias("best"))
    best = best.select(*(F.col(f"best.{c}").alias(c) for c in ("_k1", "_k2", "_repeats")), F.lit(1).cast("long").alias("_copies"))
    return repeat_rows(docs, stored(best, "near-duplicates-kept"))
