"""Periodic runs of words: a dictionary of basic factors proposes periods; runs are extended, checked and de-duplicated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.chunks import text_chunks

#: A run has at least this many words and repeats its period at least this often.
LEAST_WORDS, LEAST_REPEATS = 6, 4

RUNS = "array<struct<start:long,length:long,period:long>>"


def basic_factors(codes: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of length 1, 2, 4, … that start at each position, up to the longest that occurs twice.

    Factors that occur twice or more have a name of 0 or more, equal for equal factors. A factor that occurs once is named
    -1 - its position: it equals no other, nor does anything longer that holds it, so only repeated factors are looked at
    again for twice the length.
    """
    alone = -1 - np.arange(len(codes))
    _, name, count = np.unique(codes, return_inverse=True, return_counts=True)
    names = [np.where(count[name] > 1, name, alone)]
    while (names[-1] >= 0).any():
        last, half = names[-1], 1 << (len(names) - 1)
        alive = np.flatnonzero((last[:-half] >= 0) & (last[half:] >= 0))
        _, name, count = np.unique(last[alive] * (last.max() + 1) + last[alive + half], return_inverse=True, return_counts=True)
        again, longer = count[name] > 1, alone.copy()
        longer[alive[again]] = name[again]
        names.append(longer)
    return names[:-1]


def proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the progressions at one length: neighbouring factors that all recur next after the same distance.

    Distances of up to twice the length count. In a run of smallest period p, factors of a length from p to 2p recur next
    after exactly p words, so every run is proposed at one length at least.
    """
    repeated = np.flatnonzero(names >= 0)
    order = repeated[np.argsort(names[repeated], kind="stable")]
    distance = np.diff(order)
    near = (names[order[1:]] == names[order[:-1]]) & (distance <= 2 * size)
    at, distance = order[:-1][near], distance[near]
    by_place = np.argsort(at)
    at, distance = at[by_place], distance[by_place]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (distance[1:] != distance[:-1])
    return at[first], distance[first]


def _common(names: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from ``left`` and ``right`` (left < right) on, forwards (step 1) or before them, backwards (-1).

    Goes down the lengths: no factor longer than the longest name occurs twice, so each length fits once at most.
    """
    n, done = len(names[0]), np.zeros(len(left), np.int64)
    for level in reversed(range(len(names))):
        size = 1 << level
        a, b = (left + done, right + done) if step > 0 else (left - done - size, right - done - size)
        inside = (b + size <= n) & (a >= 0)
        same = inside & (names[level][np.where(inside, a, 0)] == names[level][np.where(inside, b, 1)])
        done += np.where(same, size, 0)
    return done


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs in a sequence of codes, by start, then period."""
    none = np.zeros(0, np.int64)
    names = basic_factors(codes) if len(codes) else []
    found = [proposals(level, 1 << k) for k, level in enumerate(names)]
    start, period = (np.concatenate([f[i] for f in found]) if found else none for i in (0, 1))
    if not len(start):
        return none, none, none
    before = _common(names, start, start + period, -1)
    length = before + period + _common(names, start, start + period, 1)
    start = start - before
    long = (length >= LEAST_WORDS) & (length >= LEAST_REPEATS * period)
    start, length, period = start[long], length[long], period[long]
    # the same stretch proposed again, by another length or with a multiple of its period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _rows(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_chunks(batch, "text"):
                yield _chunk_runs(some, keep)

    return run


def _chunk_runs(batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """Words of all texts of a chunk stand in one sequence; their codes differ between texts, so no factor spans two."""
    words, codes, sizes, known = [], [], [], {}
    for number, text in enumerate(batch.column("text").to_pylist()):
        own = text.encode("utf-8", "replace").split()  # bytes: splits at \x20 and \x09-\x0D only
        sizes.append(len(own))
        words.append(own)
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes)
    offsets = ends - sizes
    every = np.concatenate(codes)
    start, length, period = find_runs(np.repeat(np.arange(len(sizes)), sizes) * (len(known) + 1) + every)
    owner = np.searchsorted(ends, start, "right")
    per_text = np.bincount(owner, minlength=len(sizes))
    change = np.zeros(len(every) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = []
    for number, own in enumerate(words):
        if per_text[number]:
            own = [own[i] for i in np.flatnonzero(kept[offsets[number] : ends[number]])]
        collapsed.append(b" ".join(own).decode())
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - offsets[owner], length, period)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), runs)
    columns = [batch.column(c) for c in keep] + [pa.array(sizes), lists, pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed``.

    Words are what lies between blanks (\\x20, \\x09 to \\x0D). A run is a stretch of words with smallest period p and at least
    LEAST_WORDS and LEAST_REPEATS * p words that no neighbouring word extends with that period. ``collapsed`` has the words
    that no run holds after its first p words, joined by one space. Null and empty texts have no words and no runs; a text is
    taken whole, however long (about 100 bytes of memory a word); repeated rows and null ids each give a row; an empty table
    gives none. Columns beside ``doc_id`` and ``text`` are not read. There is no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_rows(["doc_id"]), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: str = "runs"):
    """The run of greatest length (ties: smallest start, then period) of a column of runs; null when there is none."""
    ordered = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ordered)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; every tenth text by the CRC-32 of its id goes on in a cycle from a place on.

    With h the CRC-32 of the decimal id, g = h // 10 and n words: if h % 10 = 0, word i from a = g % n on becomes the original word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8), and words are joined by single spaces. Rows without an id, and texts
    without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), h.alias("h"))
    words = F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
