"""Character n-grams counted where the texts lie: a batch of texts leaves its task as one row per distinct term.

N-grams of a batch are numbered by length: the number of an n-gram follows from that of its first n-1 characters and its
last character, so a sort of integers counts all of one length. A batch holds at most ``MOST_CHARS`` bytes; a longer text is
counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a batch fit PLACE_BITS, as do the numbers of its n-grams and of its characters: three of them fit 63 bits.
PLACE_BITS = 20
MOST_CHARS = 1 << PLACE_BITS

_COUNTS = "term string, tf long, df long"


def squeezed(text: Column) -> Column:
    """Lower case, runs of two or more blanks as one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s{2,}", " ")


def character_starts(data: np.ndarray) -> np.ndarray:
    """Where characters start in UTF-8 bytes, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def character_codes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bytes of each character as one number."""
    width, char = np.diff(start), np.zeros(len(start) - 1, np.int64)
    for k in range(min(4, width.max(initial=0))):
        has = width > k
        char[has] = char[has] << 8 | data[start[:-1][has] + k]
    return char


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    places = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places]))


def _counts(data: np.ndarray, start: np.ndarray, row: np.ndarray, low: int, high: int, own: int) -> list[pa.RecordBatch]:
    """Terms that start at the first ``own`` characters, with their occurrences and the rows that hold them.

    ``row`` is the row of each character, in rising order.
    """
    alphabet, char = np.unique(character_codes(data, start), return_inverse=True)
    number, out = char, []
    for n in range(1, high + 1):
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
        if not len(at):
            break
        key = char[at] if n == 1 else number[at] * len(alphabet) + char[at + n - 1]
        key = np.sort(key << PLACE_BITS | at)
        key, at = key >> PLACE_BITS, key & (MOST_CHARS - 1)
        new = np.append(True, key[1:] != key[:-1])
        number = np.zeros(len(row), np.int64)
        number[at] = np.cumsum(new) - 1
        if n >= low:
            first, holder = np.flatnonzero(new), row[at]
            other = new.copy()
            other[1:] |= holder[1:] != holder[:-1]
            tf = np.add.reduceat((at < own).astype(np.int64), first)
            df = np.add.reduceat(other.astype(np.int64), first)
            first, tf, df = at[first][tf > 0], tf[tf > 0], df[tf > 0]
            out.append(pa.record_batch([_texts(data, start[first], start[first + n]), pa.array(tf), pa.array(df)], ["term", "tf", "df"]))
    return out


def _of_long_text(data: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """A text of more than MOST_CHARS bytes: pieces overlap by the longest n-gram; the text counts once as a holder."""
    start, step, found = character_starts(data), MOST_CHARS - high, []
    for at in range(0, len(start) - 1, step):
        piece = start[at : at + step + high]
        own = min(step, len(start) - 1 - at)
        found += _counts(data[piece[0] : piece[-1]], piece - piece[0], np.zeros(len(piece) - 1, np.int64), low, high, own)
    if found:
        total = pa.Table.from_batches(found).group_by("term").aggregate([("tf", "sum"), ("df", "max")])
        yield from total.select(["term", "tf_sum", "df_max"]).rename_columns(["term", "tf", "df"]).to_batches()


def _of_texts(texts: pa.Array, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Counts of the texts, as many at once as fit a batch."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST_CHARS, "right")) - 1)
        data = every[offsets[at] : offsets[to]]
        if len(data) > MOST_CHARS:
            yield from _of_long_text(data, low, high)
        elif len(data):
            start = character_starts(data)
            row = np.searchsorted(offsets[at : to + 1] - offsets[at], start[:-1], "right")
            yield from _counts(data, start, row, low, high, len(row))
        at = to


def _counted(low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += batch.column(0).nbytes
            if size >= MOST_CHARS:
                yield from _of_texts(pa.concat_arrays(held), low, high)
                held, size = [], 0
        if held:
            yield from _of_texts(pa.concat_arrays(held), low, high)

    return run


def ngram_statistics(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """``(term, tf, df)`` of the character n-grams of a text column without nulls: occurrences, and rows that hold the term."""
    counted = df.select(F.col(text).alias("text")).mapInArrow(_counted(low, high), _COUNTS)
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _characters(order: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each character of the texts with its occurrences and the first of them: by ``order``, nulls first, then by place."""
    table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending")], null_placement="at_start")).combine_chunks()
    if not len(table):
        return
    texts, keys = table["text"].combine_chunks().cast(pa.large_binary()), table[order].combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, start = offsets - offsets[0], character_starts(data)
    if not len(data):
        return
    char = character_codes(data, start)
    row = np.searchsorted(offsets, start[:-1], "right") - 1
    place = np.arange(len(char)) - np.searchsorted(start[:-1], offsets[:-1])[row]
    # rows of one key are one row: the smallest place counts, in whichever of them it is
    null = keys.is_null().to_numpy(zero_copy_only=False)
    differs = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False) & ~(null[1:] & null[:-1])
    key = np.append(0, np.cumsum(differs))[row]
    by = np.argsort(char, kind="stable")
    begin = np.flatnonzero(np.append(True, char[by][1:] != char[by][:-1]))
    first = np.minimum.reduceat(key[by] << 32 | place[by], begin)
    n = np.diff(np.append(begin, len(by)))
    some = by[begin]
    owner = pa.array(np.flatnonzero(np.append(True, differs))[first >> 32])
    yield pa.record_batch(
        [_texts(data, start[some], start[some + 1]), pa.array(n), keys.take(owner), pa.array((first & 0xFFFFFFFF).astype(np.int32))], ["ch", "n", "o", "p"]
    )


def _counted_characters(order: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= MOST_CHARS:
                yield from _characters(order, pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from _characters(order, pa.Table.from_batches(held))

    return run


def character_statistics(df: DataFrame, text: str, order: str) -> DataFrame:
    """``(ch, n, first)`` of the characters of a text column without nulls: occurrences, and the least (order, place from 0).

    A batch of texts leaves its task as one row per distinct character.
    """
    kind = df.schema[order].dataType.simpleString()
    counted = df.select(F.col(text).alias("text"), F.col(order).alias("o")).mapInArrow(_counted_characters("o"), f"ch string, n long, o {kind}, p int")
    return counted.groupBy("ch").agg(F.sum("n").alias("n"), F.min(F.struct("o", "p")).alias("first"))
