"""Operators that return documents leave columns alone whose names they use themselves."""

from collections import Counter

import pytest

from tests.llm.helpers import DOCS, ODD
from tracewarden.llm import line_dedup, mixing, quality, simhash_dedup

CLASHING = "_k1 int, _k2 string, _marks int, _dropped int, _copies int, _repeats int, _copy int, _quality_text int, _quality_score string, fp int, root int, __column_0 int"


@pytest.fixture(scope="module")
def clashing(spark):
    width = len(CLASHING.split(", "))
    rows = [(*r, *(str(i) if t.endswith("string") else i for i, t in enumerate(CLASHING.split(", ")))) for r in ODD]
    assert width == len(rows[0]) - len(ODD[0])
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}").repartition(3)


def check(clashing, out):
    assert out.columns == clashing.columns and out.schema.simpleString() == clashing.schema.simpleString()
    first = len(DOCS.split(", "))
    given = {tuple(r)[first:] for r in clashing.collect()}
    rows = out.collect()
    assert {tuple(r)[first:] for r in rows} <= given
    return Counter(r["doc_id"] for r in rows)


def test_line_dedup(clashing):
    assert check(clashing, line_dedup.drop_lines(clashing)) == Counter(r[0] for r in ODD)


def test_near_duplicates(clashing):
    plain = simhash_dedup.keep_one(clashing.select(*(c.split()[0] for c in DOCS.split(", "))))
    assert check(clashing, simhash_dedup.keep_one(clashing)) == Counter(r["doc_id"] for r in plain.collect())


def test_mixing(clashing):
    plain = mixing.mix_documents(clashing.select(*(c.split()[0] for c in DOCS.split(", "))))
    assert check(clashing, mixing.mix_documents(clashing)) == Counter(r["doc_id"] for r in plain.collect())


def test_quality(spark, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert check(clashing, quality.keep_good(clashing, labels)) == Counter(r[0] for r in ODD)
