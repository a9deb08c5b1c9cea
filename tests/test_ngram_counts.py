"""N-grams counted in batches against counts of the term arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import ngram_counts
from tracewarden.operators import text_features as tf

TEXTS = ["aaa", "", None, "ab  ab", "Ünï çødé ünï", "x", "日本語日本", "😀a😀a😀", "a,b\n\tc", "aaa", "Mozilla/5.0 (X11)", "é" * 40]


@pytest.mark.parametrize(("low", "high", "bits"), [(1, 6, 20), (1, 2, 5), (3, 4, 6), (2, 2, 20)])
def test_batches_count_as_arrays_do(spark, monkeypatch, low, high, bits):
    """Texts longer than a batch (32 or 64 bytes) are counted in pieces, and once as holders."""
    monkeypatch.setattr(ngram_counts, "PLACE_BITS", bits)
    monkeypatch.setattr(ngram_counts, "MOST_CHARS", 1 << bits)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want = tf.term_statistics(tf.with_terms(df, "text", "terms", low, high), "terms")
    plain = df.select(tf.squeezed(F.col("text")).alias("text")).toArrow()["text"].combine_chunks()
    got = {}
    for batch in ngram_counts._of_texts(plain, low, high):
        for r in batch.to_pylist():
            t, d = got.get(r["term"], (0, 0))
            got[r["term"]] = t + r["tf"], d + r["df"]
    assert got == {r["term"]: (r["tf"], r["df"]) for r in want.collect()}
    assert {r["term"]: (r["tf"], r["df"]) for r in tf.char_statistics(df, "text", low, high).collect()} == got


def test_terms_leave_a_task_once_a_batch(spark):
    """Repeated terms of a batch are one row, however many texts hold them."""
    import pyarrow as pa

    texts = pa.array(["abcabc" + "x" * (i % 3) for i in range(5000)])
    rows = sum(b.num_rows for b in ngram_counts._of_texts(texts, 1, 3))
    terms = {t.as_py()[i : i + n] for t in texts[:3] for n in (1, 2, 3) for i in range(len(t.as_py()) - n + 1)}
    assert rows == len(terms)
    assert np.all([b.schema.names == ["term", "tf", "df"] for b in ngram_counts._of_texts(texts[:3], 1, 3)])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_characters_counted_where_the_texts_lie(spark, monkeypatch, kind):
    """Counts and first places of characters against plain Python; keys repeat and are null, nulls come first (F23, F25)."""
    keys = [7, 3, None, 3, 12, None, 5, 5, 1, 100, 11, 2]
    rows = [(k if k is None or kind == "long" else str(k), t) for k, t in zip(keys, TEXTS)]
    df = spark.createDataFrame(rows, f"id {kind}, t string").repartition(3)
    want = {}
    for k, t in rows:
        for p, c in enumerate((t or "").lower()):
            n, first = want.get(c, (0, None))
            place = (k is not None, k if k is not None else (0 if kind == "long" else ""), p)
            want[c] = n + 1, place if first is None else min(first, place)
    got = tf.char_vocabulary(df, "t", "id").collect()
    assert {r["ch"]: r["n"] for r in got} == {c: n for c, (n, _) in want.items()}
    order = sorted(want, key=lambda c: (-want[c][0], want[c][1]))
    by_first = {c: (want[c][0], want[c][1]) for c in want}
    ranked = [by_first[r["ch"]] for r in sorted(got, key=lambda r: r["id"])]
    assert ranked == [by_first[c] for c in order]
    plan = tf.char_vocabulary(df, "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row a character


def test_terms_are_made_once_after_the_rows_are_dealt(spark, tmp_path, monkeypatch):
    """Spark used to infer a filter from the explode and to make the terms a second time below the step that deals rows (F18)."""
    monkeypatch.setattr(tf, "TASK_CHARS", 4)
    rows = [(i % 5 if i % 7 else None, t) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    counted = tf.term_counts(spark.read.parquet(str(tmp_path / "t")), "text", "terms", 1, 3)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten") == 1 and plan.index("flatten") < plan.index("Repartition")
    want = {}
    for k, t in rows:
        s = __import__("re").sub(r"\s{2,}", " ", (t or "").lower())
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                want[k, s[i : i + n]] = want.get((k, s[i : i + n]), 0) + 1
    assert {(r["id"], r["term"]): r["n"] for r in counted.collect()} == want
