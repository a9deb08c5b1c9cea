"""Cleaned tables, traffic reports, phrase lists, rule tables, exclusions and labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.schemas import CASES, EXCLUSIONS, RULES, TRAFFIC_FAILURES, TRAFFIC_HISTORY, TRAFFIC_STATS


def write_clean(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> str | None:
    """Write a cleaned table below ``base/run_ts=…``; an empty table is not written."""
    if df.isEmpty():
        return None
    path = f"{base.rstrip('/')}/run_ts={run_ts}"
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)
    return path


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a cleaned table; unnamed trailing columns left by a spreadsheet are dropped."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    table = reader.format(fmt).load(path)
    return table.drop(*[c for c in table.columns if c.startswith("Unnamed:") or c.startswith("_c")])


def _report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "N/A").option("escape", '"').csv(path)


def read_traffic_stats(spark: SparkSession, path: str) -> DataFrame:
    return _report(spark, path, TRAFFIC_STATS)


def read_traffic_history(spark: SparkSession, path: str) -> DataFrame:
    table = _report(spark, path, TRAFFIC_HISTORY)
    return table.withColumn("ts", F.timestamp_seconds("Timestamp"))


def read_traffic_failures(spark: SparkSession, path: str) -> DataFrame:
    return _report(spark, path, TRAFFIC_FAILURES)


def read_phrase_list(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    """One phrase per line; blank lines and ``#`` comments are skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .filter((line != "") & ~F.col("value").startswith("#"))
        .select(F.lit(list_name).alias("list_name"), line.alias("phrase"))
    )


def read_rules(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(RULES).format(fmt).load(path)


def read_exclusions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(EXCLUSIONS).format(fmt).load(path)


def read_cases(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(CASES).format(fmt).load(path)
