"""Cleaning of flat audit rows. Each step keeps the order of the original job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns the cleaned table does not keep, columns that must be present, columns put in upper case.
DROPPED = [
    "Timestamp", "TransactionID", "ClientIP", "ClientPort", "ServerIP", "ServerPort",
    "ResponseProtocol", "ResponseHeaders", "ResponseBody",
    "WAFInterrupted", "InterruptionRuleID", "InterruptionStatus", "InterruptionAction",
    "MatchedRulesCount", "MatchedRulesIDs", "MatchedRulesMessages", "MatchedRulesTags",
    "AIScore", "AIVerdict",
]
CRITICAL = ["RequestURI", "RequestMethod"]
UPPERCASE = ["RequestMethod"]
LABEL = "AIVerdictLabel"
LABEL_VALUES = ["benign", "malicious"]

# Path traversal patterns.
TRAVERSAL_PATTERNS = [
    r"\.\./",
    r"\.\.\\",
    r"%2e%2e%2f",
    r"%2e%2e%5c",
    r"%252e%252e%252f",
    r"%252e%252e%255c",
    r"\.\./\.\./",
    r"\.\.\\\.\.\\",
    r"/etc/passwd",
    r"boot.ini",
    r"proc/self/cwd",
    r"WEB-INF",
]


def _is_error(first: Column) -> Column:
    return F.coalesce(first.cast("string").rlike("(?i)failed|error"), F.lit(False))


def drop_error_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose first column mentions a failure; nulls stay."""
    return df.filter(~_is_error(F.col(f"`{df.columns[0]}`"))) if df.columns else df


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def filter_label(df: DataFrame, label: str = LABEL, values: list[str] = LABEL_VALUES) -> DataFrame:
    return df.filter(F.col(label).isin(*values)) if label in df.columns else df


def require_columns(df: DataFrame, columns: list[str] = CRITICAL) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.na.drop(subset=present) if present else df


def uppercase_columns(df: DataFrame, columns: list[str] = UPPERCASE) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(c).cast("string")) for c in columns if c in df.columns})


def drop_columns_if_present(df: DataFrame, columns: list[str] = DROPPED) -> DataFrame:
    return df.drop(*columns)


def clean_audit(df: DataFrame) -> DataFrame:
    """The six steps in order. One shuffle, that of the duplicate step."""
    steps = (drop_error_rows, dedup_exact, filter_label, require_columns, uppercase_columns, drop_columns_if_present)
    return reduce(lambda table, step: step(table), steps, df)


def clean_report(df: DataFrame) -> DataFrame:
    """Rows in, rows removed by each step, rows out, as one row.

    Rows are counted once per distinct row, so copies meet already summed in the shuffle and every later step reads
    the same counts.
    """
    names = [f"`{c}`" for c in df.columns]
    distinct = df.groupBy(*names).agg(F.count("*").alias("__n"))
    error = _is_error(F.col(names[0]))
    bad_label = (
        ~F.coalesce(F.col(LABEL).isin(*LABEL_VALUES), F.lit(False)) if LABEL in df.columns else F.lit(False)
    )
    present = [F.col(c).isNull() for c in CRITICAL if c in df.columns]
    missing = reduce(lambda a, b: a | b, present, F.lit(False))
    n = F.col("__n")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return distinct.agg(
        total(n).alias("rows_in"),
        total(F.when(error, n).otherwise(0)).alias("removed_error"),
        total(F.when(~error, n - 1).otherwise(0)).alias("removed_duplicate"),
        total((~error & bad_label).cast("int")).alias("removed_label"),
        total((~error & ~bad_label & missing).cast("int")).alias("removed_missing"),
        total((~error & ~bad_label & ~missing).cast("int")).alias("rows_out"),
    )


def fill_defaults(
    df: DataFrame, numeric: list[str], text: list[str], categorical: list[str]
) -> DataFrame:
    """Null or absent numbers become 0, null or absent text becomes the empty string."""

    def filled(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    out = {c: filled(c, 0) for c in numeric}
    out.update({c: filled(c, "") for c in [*text, *categorical]})
    return df.withColumns(out)


def binary_label(label: Column) -> Column:
    return F.when(label == "malicious", 1).otherwise(0)


def scoring_gate(method: Column, query: Column, body: Column) -> Column:
    """Requests worth scoring: they carry a body or a query, or are POST or PUT."""
    filled = (F.coalesce(F.octet_length(body), F.lit(0)) > 0) | (F.coalesce(query, F.lit("")) != "")
    return filled | F.coalesce(method.isin("POST", "PUT"), F.lit(False))


def is_traversal(text: Column) -> Column:
    return F.coalesce(text.rlike("(?is)" + "|".join(TRAVERSAL_PATTERNS)), F.lit(False))


def training_guards(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row telling whether a table can be trained on: rows, features, classes and the verdict."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(features)).cast("long").alias("n_features"),
        F.count_distinct(label).alias("n_classes"),
    ).withColumn("trainable", (F.col("n_rows") > 0) & (F.col("n_features") > 0) & (F.col("n_classes") >= 2))


def numeric_columns_only(df: DataFrame, labels: tuple[str, ...] = (LABEL, "AIVulnerabilityTypeLabel", "label")) -> DataFrame:
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in labels]
    return df.select(*[f"`{c}`" for c in keep])
