"""TF-IDF vectors of character n-grams, made where the texts lie: batches of texts walk a table of the vocabulary's prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.ngram_counts import MOST_CHARS, character_codes, character_starts, squeezed

#: Prefixes times characters up to which the step from a prefix to the next is looked up by place, beyond it by search.
TABLE_CELLS = 1 << 22


class Prefixes:
    """The prefixes of a vocabulary, numbered, and the step from one to the next by a character."""

    def __init__(self, terms: list[str], low: int, high: int):
        number, steps = {"": 0}, {}
        for term in terms:
            for n in range(1, len(term) + 1 if low <= len(term) <= high else 0):
                if term[:n] not in number:
                    number[term[:n]] = len(number)
                    steps[number[term[: n - 1]], term[n - 1]] = number[term[:n]]
        self.high, self.width = high, len(terms)
        self.term = np.full(len(number), -1, np.int32)
        for i, term in enumerate(terms):
            if low <= len(term) <= high:
                self.term[number[term]] = i
        self.alphabet = np.unique(np.array([int.from_bytes(c.encode(), "big") for _, c in steps], np.int64))
        self.size = len(self.alphabet) + 1  # the last code stands for every other character
        key = np.array([p * self.size + np.searchsorted(self.alphabet, int.from_bytes(c.encode(), "big")) for p, c in steps], np.int64)
        by = np.argsort(key)
        self.key, self.next = key[by], np.array(list(steps.values()), np.int32)[by]
        self.table = None
        if len(number) * self.size <= TABLE_CELLS:
            self.table = np.full(len(number) * self.size, -1, np.int32)
            self.table[self.key] = self.next

    def codes(self, char: np.ndarray) -> np.ndarray:
        if not self.size - 1:
            return np.zeros(len(char), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, char), self.size - 2)
        return np.where(self.alphabet[at] == char, at, self.size - 1)

    def _step(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        if not len(self.key):
            return np.full(len(key), -1, np.int32)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.next[at], -1)

    def found(self, char: np.ndarray, end: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places among the first ``own`` characters and the terms that start there; no term goes beyond ``end`` of its place."""
        code, at, prefix = self.codes(char), np.arange(own), np.zeros(own, np.int32)
        for n in range(1, self.high + 1):
            inside = at + n <= end[at]
            at, prefix = at[inside], prefix[inside]
            prefix = self._step(prefix.astype(np.int64) * self.size + code[at + n - 1])
            at, prefix = at[prefix >= 0], prefix[prefix >= 0]
            if not len(at):
                return
            term = self.term[prefix]
            yield at[term >= 0], term[term >= 0]


def _of_long_text(data: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of one text of more than MOST_CHARS bytes; pieces overlap by the longest term."""
    start, step, total = character_starts(data), MOST_CHARS - prefixes.high, np.zeros(prefixes.width, np.int64)
    for at in range(0, len(start) - 1, step):
        piece = start[at : at + step + prefixes.high]
        char = character_codes(data[piece[0] : piece[-1]], piece - piece[0])
        for _, term in prefixes.found(char, np.full(len(char), len(char)), min(step, len(char))):
            total += np.bincount(term, minlength=prefixes.width)
    term = np.flatnonzero(total)
    return np.zeros(len(term), np.int64), term, total[term]


def _of_texts(data: np.ndarray, offsets: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences, in this order, of texts that lie one after the other."""
    start = character_starts(data)
    row = np.searchsorted(offsets, start[:-1], "right") - 1
    end = np.searchsorted(start, offsets)[row + 1]
    keys = [row[at] * prefixes.width + term for at, term in prefixes.found(character_codes(data, start), end, len(row))]
    key = np.sort(np.concatenate([np.empty(0, np.int64), *keys]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first] // max(prefixes.width, 1), key[first] % max(prefixes.width, 1), np.diff(np.append(first, len(key)))


def _vectors(texts: pa.Array, prefixes: Prefixes, idf: np.ndarray) -> pa.Array:
    """Sparse vectors, in the form in which Spark ML stores them: counts times idf, of length one."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST_CHARS, "right")) - 1)
        data = every[offsets[at] : offsets[to]]
        if len(data) > MOST_CHARS:
            row, term, n = _of_long_text(data, prefixes)
        else:
            row, term, n = _of_texts(data, offsets[at : to + 1] - offsets[at], prefixes)
        weight = n * idf[term]
        length = np.sqrt(np.bincount(row, weight * weight, to - at))
        parts.append((np.bincount(row, minlength=to - at), term, weight / length[row]))
        at = to
    filled, term, weight = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
    ends = pa.array(np.append(0, np.cumsum(filled)).astype(np.int32))
    rows = len(texts)
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, prefixes.width, np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float64))),
        ],
        ["type", "size", "indices", "values"],
    )


class CharTfIdf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """L2-normalised TF-IDF of the n-grams of a text column, ``squeezed``, over a fitted vocabulary."""

    terms = Param(Params._dummy(), "terms", "vocabulary", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight of each term", TypeConverters.toListFloat)
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, terms=None, idf=None, low=1, high=1):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms, weights = self.getOrDefault(self.terms), self.getOrDefault(self.idf)
        low, high, out = self.getOrDefault(self.low), self.getOrDefault(self.high), self.getOutputCol()

        @F.arrow_udf(VectorUDT())
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            prefixes, idf = Prefixes(terms, low, high), np.array(weights, np.float64)
            for texts in batches:
                yield _vectors(texts, prefixes, idf)

        size = {"ml_attr": {"num_attrs": len(terms)}}
        return dataset.withColumn(out, vectors(squeezed(F.col(self.getInputCol()))).alias(out, metadata=size))
