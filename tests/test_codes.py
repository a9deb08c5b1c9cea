"""Codes of a column with any number of values, against sorted lists."""

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import codes, text_features


@pytest.mark.parametrize("kind", ["string", "double", "int"])
def test_codes_are_places_in_sorted_order(spark, kind):
    values = [f"{i * 7919 % 5003}" for i in range(3000)] + ["17"] * 4000 + [None] * 1500
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value string").withColumn("value", F.col("value").cast(kind)).repartition(6)
    got = text_features.label_encode(df, "value").collect()
    order = {v: i for i, v in enumerate(sorted({r["value"] for r in got} - {None}))}
    assert len(got) == len(values) and {r["id"] for r in got} == set(range(len(values)))
    assert all(r["value_code"] == order.get(r["value"]) for r in got)


def test_a_million_values(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id"), F.hex((F.col("id") * 7919) % n).alias("v"), (F.col("id") % 3 == 0).alias("hot"))
    df = df.select("id", F.when(F.col("hot"), "FFFFFFF").otherwise(F.col("v")).alias("v"))
    table = codes.code_table(df, "v")
    sums = table.agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"), F.countDistinct("code").alias("d")).first()
    assert sums["n"] == sums["d"] == sums["high"] + 1 and sums["low"] == 0 and sums["n"] > 600_000
    # codes rise with the values: in code order no value is below the one a step before
    pairs = table.alias("a").join(table.alias("b"), F.col("a.code") + 1 == F.col("b.code"))
    assert pairs.where("a.value >= b.value").count() == 0 and pairs.count() == sums["n"] - 1
    coded = codes.with_codes(df, "v", table, "c")
    assert coded.count() == n and coded.where("c is null").count() == 0
    assert coded.join(table, F.col("c") == F.col("code")).where("v != value").count() == 0


def test_one_hot_leaves_unknown_values_empty(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "z"), (4, None), (5, "c")], "id long, value string")
    known = codes.code_table(df.where("value < 'd'"), "value")
    got = {r["id"]: r["vec"] for r in codes.one_hot(df, "value", known, "vec").collect()}
    assert {i: (v.size, v.indices.tolist()) for i, v in got.items()} == {1: (3, [1]), 2: (3, [0]), 3: (3, []), 4: (3, []), 5: (3, [2])}


def test_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "id long, v string")
    assert [tuple(r) for r in text_features.label_encode(df, "v").collect()] == [(1, None, None)]
    assert text_features.label_encode(df.where("id = 0"), "v").count() == 0
