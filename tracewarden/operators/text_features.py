"""Model inputs: character n-grams, TF-IDF, one-hot, scaling, label codes, padded character sequences.

Fitting counts on the cluster and keeps a bounded vocabulary or a few statistics on the driver, as any fitted model does;
transforming is a narrow projection with Spark ML stages and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.config import FeatureConfig
from tracewarden.operators import codes
from tracewarden.operators.cleaning import fill_defaults
from tracewarden.operators.ngram_counts import character_statistics, ngram_statistics, squeezed
from tracewarden.operators.ranking import block_count
from tracewarden.operators.term_vectors import CharTfIdf
from tracewarden.session import bounded_rows

MAX_CATEGORIES = 100_000
MAX_CHARS = 200_000
#: Characters of the texts whose n-grams a task counts by row.
TASK_CHARS = 1 << 20


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams_of(char_array: Column, low: int, high: int) -> Column:
    """All n-grams of a character array; each is put together from array positions, so the cost is linear."""

    def of_size(cs: Column, n: int) -> Column:
        starts = F.slice(cs, F.lit(1), F.greatest(F.size(cs) - (n - 1), F.lit(0)))
        if n == 1:
            return starts
        return F.transform(starts, lambda c, i: F.concat(c, *[F.get(cs, i + offset) for offset in range(1, n)]))

    return bind(char_array, lambda cs: F.flatten(F.array(*[of_size(cs, n) for n in range(low, high + 1)])))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    return ngrams_of(chars(squeezed(text)), low, high)


def words(text: Column) -> Column:
    """Word tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def with_terms(df: DataFrame, text: str, out: str, low: int, high: int, analyzer: str = "char") -> DataFrame:
    """Add the term array of a text column."""
    return df.withColumn(out, words(F.col(text)) if analyzer == "word" else char_ngrams(F.col(text), low, high))


def each_term(terms: str) -> Column:
    """A row per term. The array is no plain column here: of one, Spark infers a filter on its size, which it moves below the
    step that deals rows to tasks, with all the work that makes the array, to be done a second time by the few tasks that read."""
    return F.explode(F.coalesce(F.col(terms), F.array().cast("array<string>")))


def term_counts(df: DataFrame, text: str, terms: str, low: int, high: int) -> DataFrame:
    """``df`` with the terms of a text column, for counts by row: rows with the same columns but ``text`` meet before the terms
    are made, TASK_CHARS characters a task, so a task holds the counts of few texts and terms need no shuffle of their own."""
    keys = [c for c in df.columns if c != text]
    chars_in = df.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, block_count(chars_in, TASK_CHARS))
    dealt = with_terms(df.repartition(tasks, *keys), text, terms, low, high)
    return dealt.select(*keys, each_term(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, terms: str, k: int) -> DataFrame:
    """The k most frequent terms ``(term, tf)``, ties by term. Counts are formed before the shuffle; the order is a top-k."""
    counted = df.select(each_term(terms).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    return counted.orderBy(F.desc("tf"), "term").limit(k)


def term_statistics(df: DataFrame, terms: str) -> DataFrame:
    """``(term, tf, df)`` in one pass: occurrences, and rows that hold the term. Sums are formed before the shuffle."""
    every = F.transform(F.col(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return df.select(F.inline(F.concat(every, once))).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


@dataclass
class TfIdf:
    """Vocabulary in term order and its weights."""

    terms: list[str]
    idf: list[float]

    def stages(self, out: str) -> list:
        """ML stages from the term column ``<out>_terms`` to an L2-normalised sparse vector."""
        tokens = f"{out}_terms"
        counts = CountVectorizerModel.from_vocabulary(self.terms, tokens, f"{out}_counts")
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=f"{out}_counts", outputCol=f"{out}_raw")
        return [counts, weighted, Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out)]


def char_statistics(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """``term_statistics`` of the n-grams of a text column, without an array of them: batches of texts are counted as a whole."""
    return ngram_statistics(df.select(squeezed(F.col(text)).alias("text")), "text", low, high)


def tfidf_fit(df: DataFrame, terms: str, max_terms: int = 5000, n: int | None = None) -> TfIdf:
    """``tfidf_of`` the terms of an array column."""
    return tfidf_of(term_statistics(df, terms), max_terms, df.count() if n is None else n)


def tfidf_of(statistics: DataFrame, max_terms: int, n: int) -> TfIdf:
    """Vocabulary of the most frequent terms and smooth idf ``ln((1 + n) / (1 + df)) + 1`` over ``n`` rows."""
    top = statistics.orderBy(F.desc("tf"), "term").limit(max_terms)
    freq = {r["term"]: r["df"] for r in bounded_rows(top, max_terms, "vocabulary")}
    ordered = sorted(freq)
    return TfIdf(ordered, [float(np.log((1 + n) / (1 + freq[t])) + 1) for t in ordered])


def tfidf_transform(df: DataFrame, model: TfIdf, terms: str, out: str = "tfidf") -> DataFrame:
    counts = CountVectorizerModel.from_vocabulary(model.terms, terms, f"__{out}_counts")
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(model.idf), inputCol=f"__{out}_counts", outputCol=f"__{out}_raw"
    )
    stages = [counts, weighted, Normalizer(p=2.0, inputCol=f"__{out}_raw", outputCol=out)]
    return PipelineModel(stages).transform(df).drop(f"__{out}_counts", f"__{out}_raw")


def sparse_entries(df: DataFrame, vector: str, key: str, terms: list[str]) -> DataFrame:
    """Non-zero entries of a sparse vector column as ``(key, term, weight)``."""
    v = F.unwrap_udt(F.col(vector))
    zipped = F.arrays_zip(v["indices"].alias("i"), v["values"].alias("w"))
    rows = df.select(key, F.explode(zipped).alias("e")).select(key, F.col("e.i").alias("i"), F.col("e.w").alias("weight"))
    lookup = df.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")  # the fitted vocabulary
    return rows.join(F.broadcast(lookup), "i").select(key, "term", "weight")


def categories(df: DataFrame, column: str) -> list[str]:
    rows = bounded_rows(df.select(F.col(column).alias("v")).filter("v is not null").distinct(), MAX_CATEGORIES, column)
    return sorted(r["v"] for r in rows)


def one_hot_stages(df: DataFrame, column: str, out: str) -> list:
    """Known categories become unit vectors in sorted order, an unknown one all zeros.

    The indexer keeps one extra index for unknown values; as the last one the encoder drops it.
    """
    indexer = StringIndexerModel.from_labels(categories(df, column), column, f"{out}_index", handleInvalid="keep")
    indexes = df.sparkSession.createDataFrame([(float(i),) for i in range(len(indexer.labels) + 1)], f"{out}_index double")
    encoder = OneHotEncoder(inputCols=[f"{out}_index"], outputCols=[out], dropLast=True)
    return [indexer, encoder.fit(indexes)]


def one_hot_model(df: DataFrame, column: str, out: str) -> PipelineModel:
    return PipelineModel(one_hot_stages(df, column, out))


@dataclass
class Scaler:
    """Mean and population deviation per column; a deviation of zero counts as one."""

    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, column: str) -> Column:
        return (F.col(column).cast("double") - F.lit(self.mean[column])) / F.lit(self.std[column])

    def statement(self, columns: list[str], suffix: str = "_z") -> str:
        exprs = ", ".join(
            f"(CAST(coalesce({c}, 0) AS DOUBLE) - CAST('{self.mean[c]!r}' AS DOUBLE)) / CAST('{self.std[c]!r}' AS DOUBLE) AS {c}{suffix}" for c in columns
        )
        return f"SELECT *, {exprs} FROM __THIS__"


def standardise_fit(df: DataFrame, columns: list[str], passthrough: bool = False) -> Scaler:
    """One aggregation for all columns."""
    if passthrough:
        return Scaler(dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 1.0))
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_m") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_s") for c in columns],
    ).first()
    return Scaler({c: row[f"{c}_m"] or 0.0 for c in columns}, {c: row[f"{c}_s"] or 1.0 for c in columns})


def standardise(df: DataFrame, scaler: Scaler, suffix: str = "_z") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": scaler.apply(c) for c in scaler.mean})


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Code (long) of a category in sorted order, from zero, for any number of categories; null has none."""
    return codes.with_codes(df, column, codes.code_table(df, column), out or f"{column}_code")


def char_vocabulary(df: DataFrame, text: str, order: str) -> DataFrame:
    """``(ch, n, id)`` by falling frequency, ties by first appearance; ids start at 2 (0 padding, 1 unknown)."""
    counted = character_statistics(df.select(F.lower(F.coalesce(text, F.lit(""))).alias("text"), order), "text", order)
    ranked = Window.orderBy(F.desc("n"), "first")  # one row per distinct character
    return counted.select("ch", "n", (F.row_number().over(ranked) + 1).cast("int").alias("id"))


def tokenise_pad(df: DataFrame, text: str, vocabulary: dict[str, int], max_len: int, out: str) -> DataFrame:
    """Fixed-length id array: characters beyond the length are cut, missing ones padded with zero at the end."""
    head = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, max_len)
    table = F.str_to_map(
        F.lit(",".join(f"{ord(ch):x}:{i}" for ch, i in vocabulary.items())), F.lit(","), F.lit(":")
    )

    def code(ch: Column) -> Column:
        point = F.lower(F.ltrim(F.hex(F.encode(ch, "UTF-32")), F.lit("0")))
        return F.coalesce(F.try_element_at(table, point).cast("int"), F.lit(1))

    ids = F.transform(chars(head), code)
    return df.withColumn(out, F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(ids))))


def vocabulary_of(df: DataFrame, text: str, order: str) -> dict[str, int]:
    return {r["ch"]: r["id"] for r in bounded_rows(char_vocabulary(df, text, order), MAX_CHARS, "characters")}


def feature_pipeline(train: DataFrame, config: FeatureConfig, out: str = "features") -> PipelineModel:
    """The fitted sparse preprocessor: TF-IDF per text column, one-hot categories, scaled numbers, one vector."""
    filled = fill_defaults(train, list(config.numeric), list(config.text), list(config.categorical))
    stages, parts = [SQLTransformer(statement=_fill_statement(config))], []
    n = filled.count()
    for column in config.text:
        low, high = config.ngrams_for(column)
        analyzer = config.analyzer_for(column)
        if analyzer == "word":
            counted = term_statistics(with_terms(filled, column, "__terms", low, high, analyzer).select("__terms"), "__terms")
        else:
            counted = char_statistics(filled, column, low, high)
        model = tfidf_of(counted, config.terms_for(column), n)
        if not model.terms:
            continue
        terms = f"{column}_vec_terms"
        if analyzer == "word":
            stages += [SQLTransformer(statement=_word_statement(column, terms)), *model.stages(f"{column}_vec")]
        else:
            vectors = CharTfIdf(inputCol=column, outputCol=f"{column}_vec", terms=model.terms, idf=model.idf, low=low, high=high)
            stages += [SQLTransformer(statement=_ngram_statement(column, terms, low, high)), vectors]
        parts.append(f"{column}_vec")
    for column in config.categorical:
        stages += one_hot_stages(filled, column, f"{column}_vec")
        parts.append(f"{column}_vec")
    if config.numeric:
        scaler = standardise_fit(filled, list(config.numeric), passthrough=not config.scale_numeric)
        stages.append(SQLTransformer(statement=scaler.statement(list(config.numeric))))
        parts += [f"{c}_z" for c in config.numeric]
    stages.append(VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return PipelineModel(stages)


def _fill_statement(config: FeatureConfig) -> str:
    texts = [*config.text, *config.categorical]
    filled = [f"coalesce({c}, '') AS {c}" for c in texts] + [f"coalesce({c}, 0) AS {c}" for c in config.numeric]
    return f"SELECT * EXCEPT ({', '.join([*texts, *config.numeric])}), {', '.join(filled)} FROM __THIS__"


def _ngram_statement(column: str, out: str, low: int, high: int) -> str:
    """SQL form of ``char_ngrams``, so that the fitted pipeline can be stored and loaded."""
    blanks = "[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]{2,}"
    cs = f"filter(split(regexp_replace(lower({column}), '{blanks}', ' '), ''), c -> c <> '')"
    arrays = []
    for n in range(low, high + 1):
        starts = f"slice(cs, 1, greatest(size(cs) - {n - 1}, 0))"
        tail = "".join(f", get(cs, i + {o})" for o in range(1, n))
        arrays.append(starts if n == 1 else f"transform({starts}, (c, i) -> concat(c{tail}))")
    return f"SELECT *, get(transform(array({cs}), cs -> flatten(array({', '.join(arrays)}))), 0) AS {out} FROM __THIS__"


def _word_statement(column: str, out: str) -> str:
    """SQL form of ``words``."""
    return f"SELECT *, regexp_extract_all(lower({column}), '(?U)\\\\b\\\\w\\\\w+\\\\b', 0) AS {out} FROM __THIS__"


def assemble(df: DataFrame, config: FeatureConfig, key: str) -> tuple[DataFrame, object]:
    """Model input of the configured mode: ``sparse`` vector, ``dense`` integer sequences, or ``raw`` columns."""
    if config.mode == "raw":
        return df.select(key, *config.categorical, *config.text, *config.numeric), None
    if config.mode == "sparse":
        model = feature_pipeline(df, config)
        return model.transform(df).select(key, "features"), model
    if config.mode != "dense":
        raise ValueError(f"unknown mode: {config.mode}")
    filled = fill_defaults(df, list(config.numeric), list(config.text), list(config.categorical))
    scaler = standardise_fit(filled, list(config.numeric))
    fitted: dict = {"scaler": scaler, "vocab_size": {}, "cardinality": {}}
    out = standardise(filled, scaler)
    for column in config.categorical:
        out = label_encode(out, column)
        fitted["cardinality"][column] = len(categories(filled, column))
    for column in config.text:
        vocabulary = vocabulary_of(filled, column, key)
        fitted["vocab_size"][column] = len(vocabulary) + 2
        out = tokenise_pad(out, column, vocabulary, config.len_for(column), f"{column}_seq")
    names = [f"{c}_z" for c in config.numeric] + [f"{c}_code" for c in config.categorical] + [f"{c}_seq" for c in config.text]
    return out.select(key, *names), fitted
