"""Near-duplicate documents: fast similarity sketches of word shingles, bands, and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.chunks import text_chunks
from tracewarden.llm.common import components, discard, join_groups, stored
from tracewarden.llm.tiles import forest, group_links, unite

#: Two texts with a share j of common shingles agree in a whole band with probability j^BAND, in none of the bands with
#: (1 - j^BAND)^BANDS: at 0.8 that is 1.3e-7.
BAND, BANDS = 5, 40
BINS = BAND * BANDS
#: Texts that share a band go on when at most this many of BINS one-bit samples differ. At a similarity of 0.8 20 are expected,
#: with a standard deviation of 4.3, so 46 lie six deviations above.
MOST_APART = 46
#: Members of a band compared in one tile, and rows in one task; shingles in one tile and task (a text counts LEAST at least).
BAND_TILE, BAND_CELL = 2048, 50_000
SET_TILE, SET_CELL, SET_LEAST = 1_000_000, 4_000_000, 1000
#: Wanted texts are found by broadcast of their keys (24 bytes each) up to this many, beyond it by shuffle.
BROADCAST_KEYS = 1_000_000
COLUMNS = 8192

SKETCHES = "doc_id long, row long, n long, id long, bits array<long>, bands array<long>"
_MULTIPLIER, _GOLDEN = np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of ``words`` words; of fewer words, one of them all; of none, none."""
    known: dict[bytes, int] = {}
    codes = []
    for text in texts:
        own = text.encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    every = hashes[np.concatenate(codes)] if codes else hashes
    rolled = every[: max(0, len(every) - words + 1)].copy()
    for i in range(1, words):
        rolled = mix(rolled * _MULTIPLIER + every[i : i + len(rolled)])
    sets, at = [], 0
    for own in codes:
        if len(own) >= words:
            found = np.sort(rolled[at : at + len(own) - words + 1])
            first = np.ones(len(found), bool)
            first[1:] = found[1:] != found[:-1]
            sets.append(found[first])
        elif len(own):
            short = mix(np.array([len(own)], np.uint64))  # another start than that of a full shingle
            for i in range(len(own)):
                short = mix(short * _MULTIPLIER + every[at + i : at + i + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += len(own)
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: in every column two sets agree with the share of elements they have in common.

    In round r each element is thrown into a bin with a value; a bin keeps the smallest value of the first round that hits it.
    After ``bins`` rounds at random, round bins + b throws every element into bin b, so each column is filled. Only
    sets with an empty bin go into the next round, mostly a few rounds for sets about as large as the sketch.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out, filled = np.full(len(sets) * bins, np.iinfo(np.uint64).max, np.uint64), np.zeros(len(sets) * bins, bool)
    values, owner = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    for turn in range(2 * bins):
        free = ~filled.reshape(-1, bins)
        open_sets = free.any(axis=1) if turn < bins else free[:, turn - bins]
        if not open_sets.all():
            keep = open_sets[owner]
            if turn < bins:
                values, owner = values[keep], owner[keep]  # a full set stays full
                thrown, whose = values, owner
            else:
                thrown, whose = values[keep], owner[keep]
        else:
            thrown, whose = values, owner
        if not len(values):
            break
        hashed = mix(thrown ^ mix(np.array([turn + 1], np.uint64) * _GOLDEN))
        if turn < bins:
            cell = whose * bins + (((hashed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
            hits = ~filled[cell]
            cell, hashed = cell[hits], hashed[hits]
        else:
            cell = whose * bins + (turn - bins)
        # the lower half orders, as the upper half has chosen the bin
        np.minimum.at(out, cell, (hashed << np.uint64(32)) | (hashed >> np.uint64(32)))
        new = np.zeros(len(out), bool)
        new[cell] = True
        out[new] = mix(out[new] + np.uint64(turn))
        filled |= new
    return out.reshape(len(sets), bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch, different between bands."""
    parts = sketch.reshape(len(sketch), BANDS, BAND)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, parts.shape[:2]).copy()
    for i in range(BAND):
        keys = mix(keys * _MULTIPLIER + parts[:, :, i])
    return keys


def sample_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of every column, as 64-bit words."""
    bits = np.zeros((len(sketch), -(-BINS // 64) * 64), np.uint8)
    bits[:, :BINS] = (sketch & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_chunks(batch, "text"):
                sets = shingle_sets(some.column("text").to_pylist(), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                sketch = np.zeros((len(sets), BINS), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    sketch[full] = sketches([sets[i] for i in full])
                columns = [some.column("doc_id"), some.column("row"), pa.array(sizes), pa.array(keys), _lists(sample_bits(sketch)), _lists(band_keys(sketch))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "id", "bits", "bands"])

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_chunks(batch, "text"):
                found = [s.tobytes() for s in shingle_sets(some.column("text").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    return run


def _close(n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes of two sets allow the similarity."""
    return 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])


def band_links(percent: int):
    """Compares all members of each band by size and bits; a spanning forest of those near enough."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group", kind="stable")
        group, ids, n = (rows[c].to_numpy() for c in ("group", "id", "n"))
        bits = np.stack(rows["bits"].to_numpy()).view(np.uint64)
        end, parent, first = np.searchsorted(group, group, "right"), np.arange(len(rows)), np.arange(len(rows))
        for step in range(1, int((end - first).max())):
            first = first[first + step < end[first]]
            near = first[_close(n, first, first + step, percent)]
            near = near[np.bitwise_count(bits[near] ^ bits[near + step]).sum(axis=1, dtype=np.int64) <= MOST_APART]
            unite(parent, near, near + step)
        return forest(ids, parent)

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, as products of 0/1 matrices over the elements of two sets or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[name] > 1
    owner, name = owner[shared], (np.cumsum(count > 1) - 1)[name[shared]]
    common = np.zeros((len(sets), len(sets)))
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    for low in range(0, int((count > 1).sum()), COLUMNS):
        first, last = np.searchsorted(name, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[first:last], name[first:last] - low] = 1
        common += held @ held.T
    return common.astype(np.int64)


def set_links(percent: int):
    """Compares the full sets of all members of each group; a spanning forest of those with a similarity of ``percent``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, some in rows.drop_duplicates(["group", "id"]).groupby("group"):
            sets = [np.frombuffer(s, np.uint64) for s in some["shingles"]]
            n, parent, common = np.array([len(s) for s in sets]), np.arange(len(sets)), common_counts(sets)
            a, b = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1))
            unite(parent, a, b)
            out.append(forest(some["id"].to_numpy(), parent))
        return pd.concat(out)

    return run


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(``id``, ``group``) of the sets that a band and the sampled bits bring together, by connected group."""
    banded = classes.select("id", "n", "bits", F.explode("bands").alias("group"))
    shared = stored(banded.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1"), "shared-bands")
    members = banded.join(_few(shared), "group").withColumn("weight", F.lit(1).cast("long")).withColumn("size", F.col("rows"))
    members = stored(members, "band-members")
    edges = group_links(members, band_links(percent), BAND_TILE, BAND_CELL, "band-links")
    found = stored(components(edges, "candidates").withColumnsRenamed({"node": "id", "root": "group"}), "candidates")
    discard(shared, members)
    return found


def _links(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges between sets of at least ``percent`` similarity, confirmed on the full sets, which connect all that are linked."""
    found = _candidates(classes, percent)
    wanted = stored(found.join(classes.select("id", "row", F.greatest("n", F.lit(SET_LEAST)).alias("weight")), "id"), "candidate-rows")
    total = wanted.count()
    read = texts.join(_few(wanted.select("row", "id")), "row").dropDuplicates(["row"])
    sets = stored(read.select("id", "text").mapInArrow(_set_rows(words), "id long, shingles binary"), "candidate-sets")
    sizes = stored(wanted.groupBy("group").agg(F.sum("weight").alias("size"), F.count("*").alias("rows")), "candidate-groups")
    members = join_groups(wanted.drop("row"), sizes, "group", "rows", total).join(sets, "id")
    members = stored(members, "candidate-members")
    edges = group_links(members, set_links(percent), SET_TILE, SET_CELL, "set-links")
    discard(found, wanted, sets, sizes)
    return edges


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` (doc_id is component_id), ``component_size``.

    Texts are lower-cased (A-Z only) and split at blanks (\\x20, \\x09 to \\x0D); the set of a text has its distinct shingles of
    ``words`` words, or all its words as one when it has fewer. Texts are linked when the sets have at least ``percent`` per cent
    of their union in common; a component's id is the smallest doc_id reachable through links. Equal sets are one class
    throughout, so copies are never compared. Null and empty texts and texts without words have no shingles and link with nothing. A null id
    takes no part in the smallest id (null only if no row of the component has one). Repeated rows each give a row; texts
    are taken whole, however long; an empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    rows = stored(texts.mapInArrow(_sketched(words), SKETCHES), "sketches")
    some = rows.where("n > 0").groupBy("id").agg(
        F.min("doc_id").alias("first"), F.min("row").alias("row"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bits", "bands"))
    )
    classes = stored(some, "shingle-sets")
    edges = _links(texts.select("row", "text"), classes, words, percent)
    roots = components(edges, "near-duplicates").withColumnRenamed("node", "id")
    rooted = classes.select("id", "first", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = stored(rooted, "rooted-sets")
    whole = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("copies").alias("component_size"), F.count("*").alias("sets")
    )
    by_set = stored(join_groups(rooted, stored(whole, "set-components"), "root", "sets", classes.count()), "components-by-set")
    filled = join_groups(rows.where("n > 0").select("doc_id", "n", "id"), by_set, "id", "copies", rows.count())
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("component_size"))
    both = filled.select("doc_id", "n", "component_id", "component_size").unionByName(empty)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "component_size")
