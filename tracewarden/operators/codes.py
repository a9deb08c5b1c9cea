"""Codes for the values of a column with any number of distinct values: dense ranks in sorted order.

Distinct values are dealt to ranges, numbered within their range, and moved up by the size of the ranges before it. The
code table stays on Spark; rows meet it by a join in which frequent values are broadcast, so that no task gets all rows of one.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import stored

#: Values with at least this share of all rows are broadcast: at most as many as its inverse.
FREQUENT_SHARE = 1e-3


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, code)``: every distinct value, its rows and its place in sorted order, from zero. Null has no code.

    Stored, as the ranges must not be drawn anew. The only unpartitioned window is over one row per range.
    """
    counted = df.select(F.col(column).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    ranges = stored(counted.repartitionByRange("value").select("value", "n", F.spark_partition_id().alias("part")), "code-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").agg(F.count("*").alias("values"))
    before = sizes.select("part", F.coalesce(F.sum("values").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    numbered = ranges.withColumn("at", within).join(F.broadcast(before), "part")  # one row per shuffle partition
    return stored(numbered.select("value", "n", (F.col("before") + F.col("at") - 1).cast("long").alias("code")), "codes")


def with_codes(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of ``column`` in ``out`` (long), null for null and for values that ``table`` does not hold.

    Frequent in ``df`` counts, not in the rows that ``table`` was made of: the two may differ.
    """
    value = F.col(column)
    present = df.where(value.isNotNull()).groupBy(value.alias("__value")).agg(F.count("*").alias("__n"))
    least = max(1000.0, df.count() * FREQUENT_SHARE)
    codes = table.select(F.col("value").alias("__value"), F.col("code").alias(out))
    frequent = stored(present.where(F.col("__n") >= least).select("__value").join(codes, "__value", "left"), "frequent-values")
    hot = df.join(F.broadcast(frequent), value == F.col("__value")).drop("__value")
    rest = df.where(value.isNotNull()).join(F.broadcast(frequent.select("__value")), value == F.col("__value"), "left_anti")
    met = rest.join(codes, value == F.col("__value"), "left").drop("__value")
    none = df.where(value.isNull()).withColumn(out, F.lit(None).cast("long"))
    return hot.unionByName(met).unionByName(none)


def one_hot(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """``df`` with a sparse unit vector per known value in sorted order in ``out``, all zeros for unknown values and nulls."""
    size = table.count()
    coded = with_codes(df, column, table, "__code").withColumn("__code", F.coalesce("__code", F.lit(size)).cast("double"))
    last = df.sparkSession.range(size, size + 1).select(F.col("id").cast("double").alias("__code"))
    # the model takes its width from the largest code; the last one is dropped
    encoder = OneHotEncoder(inputCols=["__code"], outputCols=[out], dropLast=True).fit(last)
    return encoder.transform(coded).drop("__code")
