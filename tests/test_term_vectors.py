"""Vectors of character n-grams beside the same by Spark's stages on arrays of n-grams."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tracewarden.config import FeatureConfig
from tracewarden.functions.features import KEYWORDS, num_keywords
from tracewarden.operators import term_vectors, text_features
from tracewarden.operators.models import load_model


def _texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcAé日😀 \t/=&%") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return ["", " ", "a", "ab  cd", "\U0001f600é日本 x", *made, *made[:20]]


@pytest.mark.parametrize("low, high, most", [(1, 3, 50), (1, 6, 800), (2, 4, 300), (3, 3, 1)])
def test_same_vectors_as_by_arrays(spark, low, high, most):
    df = spark.createDataFrame(list(enumerate(_texts())), "id int, t string")
    model = text_features.tfidf_of(text_features.char_statistics(df, "t", low, high), most, df.count())
    by_arrays = text_features.tfidf_transform(text_features.with_terms(df, "t", "terms", low, high), model, "terms", "v")
    stage = term_vectors.CharTfIdf(inputCol="t", outputCol="v", terms=model.terms, idf=model.idf, low=low, high=high)
    want = {r["id"]: r["v"] for r in by_arrays.select("id", "v").collect()}
    got = {r["id"]: r["v"] for r in stage.transform(df).select("id", "v").collect()}
    assert len(got) == len(want)
    for i, v in want.items():
        assert (got[i].size, list(got[i].indices), list(got[i].values)) == (v.size, list(v.indices), list(v.values))


@pytest.mark.parametrize("cells, chars", [(0, 1 << 20), (1 << 22, 64), (0, 64)])
def test_by_search_and_in_pieces(monkeypatch, cells, chars):
    monkeypatch.setattr(term_vectors, "TABLE_CELLS", cells)
    monkeypatch.setattr(term_vectors, "MOST_CHARS", chars)
    texts = [*_texts(), None, "abc日" * 100]
    counts = [Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)) for t in (t or "" for t in texts)]
    terms = sorted(t for t, _ in sum(counts, Counter()).most_common(300))
    got = term_vectors._vectors(pa.array(texts), term_vectors.Prefixes(terms, 1, 4), np.ones(len(terms))).to_pylist()
    for count, v in zip(counts, got, strict=True):
        kept = [(i, count[t]) for i, t in enumerate(terms) if count[t]]
        norm = sum(n * n for _, n in kept) ** 0.5
        assert v["indices"] == [i for i, _ in kept] and v["values"] == [n / norm for _, n in kept]


def test_fitted_pipeline_needs_no_array_of_ngrams_and_can_be_stored(spark, tmp_path):
    rows = [(1, "/a/b  c", "GET", 3), (2, "/a/é", "POST", 5), (3, None, "GET", None)]
    df = spark.createDataFrame(rows, "id long, path string, method string, n int")
    model = text_features.feature_pipeline(df, FeatureConfig(text=("path",), categorical=("method",), numeric=("n",)))
    assert any(isinstance(s, term_vectors.CharTfIdf) for s in model.stages)
    plan = model.transform(df).select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m")).transform(df)
    assert [r["features"] for r in loaded.orderBy("id").collect()] == [r["features"] for r in model.transform(df).orderBy("id").collect()]


def test_no_texts_no_terms():
    none = term_vectors.Prefixes([], 1, 3)
    assert term_vectors._vectors(pa.array([], pa.string()), none, np.ones(0)).to_pylist() == []
    assert term_vectors._vectors(pa.array(["ab"]), none, np.ones(0)).to_pylist() == [{"type": 0, "size": 0, "indices": [], "values": []}]


def test_keywords_behind_marks(spark):
    texts = ["", "/", "<script>alert(1)</script> union  select union all", *KEYWORDS, " ".join(KEYWORDS), "@@version cast( onload= a.b/c:d_e-f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["n"] for r in df.select("id", num_keywords(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [sum(t.count(k) for k in KEYWORDS) for t in texts]
