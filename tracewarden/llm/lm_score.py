"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation over the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import WORD, lower_ascii, stored, text_or_empty
from tracewarden.session import bounded_rows

END = "\n"  # the end of a text as a token; no word holds white space
#: The model predicts this many classes: the most frequent tokens, and class 0 for all others.
CLASSES, WIDTH = 512, 16
#: Counts of this many tokens travel to every task; those of all others are joined.
FREQUENT = 65_536
ROUNDS, BATCH, NOISE, RATE = 2, 1024, 64, 0.3


@dataclass
class LogBilinear:
    """Scores of a next class: (c1 * r[w1] + c2 * r[w2]) . q[w] + b[w], with w1 and w2 the two classes before it."""

    context: np.ndarray  # r, a row per class
    target: np.ndarray  # q
    position: np.ndarray  # c1 and c2
    bias: np.ndarray

    @classmethod
    def fresh(cls, share: np.ndarray, width: int = WIDTH, seed: int = 11) -> LogBilinear:
        rng, n = np.random.default_rng(seed), len(share)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(small(n, width), small(n, width), np.ones((2, width), np.float32), np.log(share).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.position, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def with_flat(self, values: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for a in self.arrays():
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return LogBilinear(*out)

    def log_probabilities(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of every class after each context: one matrix product for the batch."""
        scores = (self.position[0] * self.context[w1] + self.position[1] * self.context[w2]) @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 scores by (w1, w), by (w2, w) with the bias, and log10 normalisers by (w2, w1).

        The score is linear in each context class, so two matrix products and the normalisers of all contexts, taken a
        block of contexts at a time, give the normalised probability of any token by three look-ups.
        """
        n, ten = len(self.bias), np.float32(math.log(10))
        first = (self.position[0] * self.context) @ self.target.T
        second = (self.position[1] * self.context) @ self.target.T + self.bias
        norm = np.empty((n, n), np.float32)
        for w2 in range(n):
            scores = first + second[w2]
            top = scores.max(axis=1, keepdims=True)
            norm[w2] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        return first / ten, second / ten, norm / ten


class NoiseContrast:
    """Adagrad steps that tell corpus tokens from noise drawn by their frequency; a batch shares its noise."""

    def __init__(self, model: LogBilinear, share: np.ndarray, seed: int, draws: int = NOISE, rate: float = RATE):
        self.model, self.rng, self.draws, self.rate = model, np.random.default_rng(seed), draws, np.float32(rate)
        self.cumulative, self.log_noise = np.cumsum(share), np.log(draws * share).astype(np.float32)
        self.squares = [np.full(a.shape, 1e-2, np.float32) for a in model.arrays()]

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> None:
        m, (n, d), size = self.model, self.model.context.shape, np.float32(len(w))
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.draws)), n - 1)
        r1, r2, q, qn = m.context[w1], m.context[w2], m.target[w], m.target[noise]
        predicted = m.position[0] * r1 + m.position[1] * r2
        # derivative of the loss by each score: probability of being a corpus token, less the truth
        true = _sigmoid((predicted * q).sum(axis=1) + m.bias[w] - self.log_noise[w]) - np.float32(1)
        false = _sigmoid(predicted @ qn.T + m.bias[noise] - self.log_noise[noise])
        back = true[:, None] * q + false @ qn
        to_target = _rows_summed(w, true[:, None] * predicted, n)
        np.add.at(to_target, noise, false.T @ predicted)
        to_bias = np.bincount(w, true, n).astype(np.float32)
        np.add.at(to_bias, noise, false.sum(axis=0))
        to_context = _rows_summed(w1, back * m.position[0], n) + _rows_summed(w2, back * m.position[1], n)
        to_position = np.stack([(back * r1).sum(axis=0), (back * r2).sum(axis=0)])
        for value, square, slope in zip(m.arrays(), self.squares, (to_context, to_target, to_position, to_bias)):
            slope /= size
            square += slope * slope
            value -= self.rate * slope / np.sqrt(square)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


def _rows_summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    d = values.shape[1]
    places = (rows[:, None] * d + np.arange(d)).ravel()
    return np.bincount(places, values.ravel(), n * d).reshape(n, d).astype(np.float32)


def contexts(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w2, w1, w) of every token of a text; what precedes the text counts as ``start``."""
    padded = np.concatenate([np.full(2, start, np.int64), ids])
    return padded[:-2], padded[1:-1], padded[2:]


@dataclass
class Counted:
    """Training counts: the distributed table of all tokens, its totals, and the most frequent tokens."""

    counts: DataFrame
    tokens: int
    distinct: int
    frequent: list[tuple[str, int]]

    @property
    def class_share(self) -> np.ndarray:
        """Unigram probabilities of the classes, add-one smoothed."""
        top = [c for _, c in self.frequent[: CLASSES - 1]]
        values = np.array([self.tokens - sum(top), *top], np.float64) + 1
        return values / values.sum()

    @property
    def end_class(self) -> int:
        top = [w for w, _ in self.frequent[: CLASSES - 1]]
        return top.index(END) + 1 if END in top else 0

    def rest_log_total(self) -> float:
        """log10 of the smoothed mass within class 0: its training tokens, its distinct tokens, and one unseen."""
        top = [c for _, c in self.frequent[: CLASSES - 1]]
        return math.log10(self.tokens - sum(top) + self.distinct - len(top) + 1)


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def count_tokens(docs: DataFrame) -> Counted:
    """Counts of all tokens of the rows that are not held out.

    Frequent are the tokens counted at least so often that no more than FREQUENT are.
    """
    train = docs.where(~is_held_out(F.col("doc_id")))
    words = F.concat(F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(WORD), F.lit(0)), F.array(F.lit(END)))
    counts = stored(train.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    # the counts in steps of an eighth of a power of two: at most some hundred rows, and no sort of the vocabulary
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for step in steps:
        taken += step["words"]
        if taken > FREQUENT:
            break
        least = step["least"]
    rows = bounded_rows(counts.where(F.col("n") >= least), FREQUENT, "frequent tokens") if least else []
    frequent = sorted(rows, key=lambda r: (-r["n"], r["token"]))
    return Counted(counts, totals["tokens"], totals["distinct"], [(r["token"], r["n"]) for r in frequent])


_TOKENS = "doc_id long, held_out boolean, n_tokens long, n_frequent long, log_sum double, rest_log_sum double, n_rest long, classes binary, rare array<string>"


def _tokenised(frequent: list[tuple[str, int]]):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("log_sum", pa.float64())]
        + [("rest_log_sum", pa.float64()), ("n_rest", pa.int64()), ("classes", pa.binary()), ("rare", pa.list_(pa.string()))]
    )

    class Places(dict):
        def __missing__(self, word: bytes) -> int:
            return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places((w.encode(), i + 1) for i, (w, _) in enumerate(frequent))
        logs = np.log10(np.array([0, *(n for _, n in frequent)], np.float64) + 1)
        end = END.encode()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, \x20 and \x09-\x0D only
                    words.append(end)
                    ids = np.array(list(map(places.__getitem__, words)), np.int64)
                    known, rest = ids > 0, ids >= CLASSES
                    rare = [words[i].decode("utf-8", "replace") for i in np.flatnonzero(~known)]
                    classes = np.where(rest, 0, ids).astype("<u2").tobytes()
                    rows.append((doc_id, held_out, len(ids), int(known.sum()), float(logs[ids].sum()), float(logs[ids[rest]].sum()), int(rest.sum()) + len(rare), classes, rare))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _trained(model: LogBilinear, share: np.ndarray, start: int, turn: int):
    """One pass of a task over its texts; returns its parameters times its tokens, to be averaged over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = model.with_flat(model.flat())
        contrast = NoiseContrast(local, share, 1000 * turn + TaskContext.get().partitionId(), NOISE, RATE)
        waiting, held, seen = [], 0, 0

        def learn(least: int) -> None:
            nonlocal waiting, held, seen
            if held < max(least, 1):
                return
            w2, w1, w = (np.concatenate(c) for c in zip(*waiting))
            full = held if least <= 1 else held - held % least
            for at in range(0, full, BATCH):
                part = slice(at, min(at + BATCH, full))
                contrast.step(w2[part], w1[part], w[part])
            seen += full
            waiting, held = ([(w2[full:], w1[full:], w[full:])] if full < held else []), held - full

        for batch in batches:
            for classes in batch.column(0):
                ids = np.frombuffer(classes.as_py(), "<u2").astype(np.int64)
                for at in range(0, len(ids), 65_536):
                    part = ids[max(0, at - 2) : at + 65_536]
                    triple = contexts(part, start)
                    waiting.append(triple if at == 0 else tuple(c[2:] for c in triple))
                    held += len(waiting[-1][2])
                    if held >= 16 * BATCH:
                        learn(BATCH)
        learn(1)
        if seen:
            values = local.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(np.full(len(values), seen))], names=["place", "value", "seen"])

    return run


def train(tokens: DataFrame, counted: Counted) -> LogBilinear:
    """ROUNDS passes of all tasks over all training texts; after each, the parameters are averaged by tokens seen.

    What reaches the driver is one row per parameter, whatever the corpus.
    """
    share, start = counted.class_share, counted.end_class
    model = LogBilinear.fresh(share)
    for turn in range(ROUNDS if counted.tokens else 0):
        passes = tokens.where(~F.col("held_out")).select("classes").mapInArrow(_trained(model, share, start, turn), "place int, value double, seen long")
        rows = passes.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).collect()
        flat = np.empty(len(rows))
        for place, value in rows:
            flat[place] = value
        model = model.with_flat(flat)
    return model


def _scored(model: LogBilinear, start: int):
    parts = model.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, norm = parts
        for batch in batches:
            sums = []
            for classes in batch.column(1):
                ids = np.frombuffer(classes.as_py(), "<u2").astype(np.int64)
                w2, w1, w = contexts(ids, start)
                sums.append(float((first[w1, w].astype(np.float64) + second[w2, w] - norm[w2, w1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["row", "class_score"])

    return run


def tokenise(docs: DataFrame, counted: Counted) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    tokens = rows.mapInArrow(_tokenised(counted.frequent), _TOKENS)
    return stored(tokens.withColumn("row", F.monotonically_increasing_id()), "lm-tokens")


def score_documents(docs: DataFrame) -> DataFrame:
    """log10 probabilities of every whole text under add-one unigrams (``base_score``) and under the model (``score``).

    Tokens are the words of the text, A-Z lower-cased, and one end. Counts are taken over all rows not held out; the model
    learns from all of them too, in passes over partitions whose parameters are averaged. It predicts the class of a token
    from the two before it; a token of class 0 then has its share of that class, by add-one counts with one unseen token,
    so the probabilities of all tokens sum to one. Null texts count as empty (one end), a null id is not held out, repeated
    rows are scored each, an empty table gives no rows.
    """
    counted = count_tokens(docs)
    tokens = tokenise(docs, counted)
    model = train(tokens, counted)
    class_scores = tokens.select("row", "classes").mapInArrow(_scored(model, counted.end_class), "row long, class_score double")
    rare = tokens.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    rare = rare.join(counted.counts, "token").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log_sum"), F.sum("times").alias("n_rare_known"))
    numbers = tokens.drop("classes", "rare")
    joined = numbers.join(class_scores, "row").join(rare, "row", "left").na.fill(0, ["rare_log_sum", "n_rare_known"])
    total = math.log10(counted.tokens + counted.distinct + 1)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.col("n_rare_known")).alias("n_known"),
        F.lit(counted.tokens).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.col("rare_log_sum") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("class_score") + F.col("rest_log_sum") + F.col("rare_log_sum") - F.col("n_rest") * counted.rest_log_total()).alias("score"),
    )
