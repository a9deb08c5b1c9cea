"""Checks of rule tables and of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import ScanConfig
from tracewarden.operators.scoring import severity_points

# Id prefixes that need no test case.
UNTESTED_PREFIXES = ("900", "901", "905", "910", "912", "949", "921170", "942441", "942442")


def needs_test(rule_id: Column) -> Column:
    text = rule_id.cast("string")
    skipped = F.lit(False)
    for prefix in UNTESTED_PREFIXES:
        skipped = skipped | text.startswith(prefix)
    return (rule_id % 1000 >= 100) & ~skipped


def untested_rules(rules: DataFrame, cases: DataFrame) -> DataFrame:
    """Rules that should have a case and have none."""
    wanted = rules.filter(needs_test(F.col("rule_id"))).select("rule_id").distinct()
    return wanted.join(cases.select("rule_id"), "rule_id", "left_anti")


def check_expectations(cases: DataFrame, matches: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case: all expected rules matched and no forbidden one did.

    Expected and forbidden ids are exploded and joined with the matched (case, rule) pairs, then put together per case.
    """
    listed = cases.select(
        key,
        F.explode_outer(
            F.concat(
                F.transform(F.coalesce("expect_ids", F.array().cast("array<int>")), lambda i: F.struct(i.alias("rule_id"), F.lit(True).alias("wanted"))),
                F.transform(F.coalesce("no_expect_ids", F.array().cast("array<int>")), lambda i: F.struct(i.alias("rule_id"), F.lit(False).alias("wanted"))),
            )
        ).alias("x"),
    ).select(key, "x.rule_id", "x.wanted")
    seen = matches.select(key, "rule_id").distinct().withColumn("seen", F.lit(True))
    joined = listed.join(seen, [key, "rule_id"], "left")
    met = F.col("wanted").isNull() | (F.col("wanted") == F.coalesce("seen", F.lit(False)))
    return joined.groupBy(key).agg(F.bool_and(met).alias("passed"))


def pass_rate(cases: DataFrame, outcome: DataFrame, by: str, key: str = "case_id") -> DataFrame:
    return (
        cases.select(key, by)
        .join(outcome, key)
        .groupBy(by)
        .agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("rate"))
    )


def lint_rules(
    rules: DataFrame, defined_vars: list[str], approved_tags: list[str], common_tag: str, version: str, config: ScanConfig = ScanConfig()
) -> DataFrame:
    """Findings ``(rule_id, check, detail)``. ``points`` is the increment a rule adds, where the table has it."""

    def finding(rows: DataFrame, name: str, detail: Column) -> DataFrame:
        return rows.select("rule_id", F.lit(name).alias("check"), detail.cast("string").alias("detail"))

    heads = rules.filter(F.coalesce("chain_link", F.lit(1)) == 1)
    none = F.array().cast("array<string>")
    tags = F.coalesce("tags", none)
    level_tag = F.get(F.filter(tags, lambda t: t.startswith("paranoia-level/")), F.lit(0))
    uses_capture = F.lower("argument").rlike(r"%\{tx\.[0-9]\}") | F.exists("collections", lambda c: c.rlike("^TX:[0-9]$"))
    rule_level = rules.withColumn("__tags", tags)
    repeated = heads.groupBy("rule_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    exploded = heads.select("rule_id", F.explode(tags).alias("tag")).filter(~F.col("tag").isin(*approved_tags))
    captures = rules.groupBy("rule_id").agg(
        F.bool_or(F.coalesce("capture", F.lit(False))).alias("has_capture"),
        F.bool_or(F.coalesce(uses_capture, F.lit(False)) & (F.coalesce("chain_link", F.lit(1)) > 1)).alias("uses_capture"),
    )
    out = [
        finding(repeated, "duplicate_id", F.col("n")),
        finding(heads.filter(~F.col("score_var").isin(*defined_vars)), "undefined_score_var", F.col("score_var")),
        finding(exploded, "tag_not_approved", F.col("tag")),
        finding(
            heads.filter(F.coalesce(level_tag, F.lit("")) != F.concat(F.lit("paranoia-level/"), F.col("pl").cast("string"))),
            "level_tag_mismatch",
            F.coalesce(level_tag, F.lit("none")),
        ),
        finding(rule_level.filter(~F.array_contains("__tags", common_tag)), "common_tag_missing", F.lit(common_tag)),
        finding(heads.filter(F.col("ver").isNull()), "version_missing", F.lit("")),
        finding(heads.filter(F.col("ver") != version), "version_incorrect", F.col("ver")),
        finding(
            rules.filter((F.col("operator") == "rx") & F.col("argument").startswith("(?i)") & F.array_contains(F.coalesce("transforms", none), "lowercase")),
            "ignorecase_with_lowercase",
            F.col("argument"),
        ),
        finding(captures.filter(F.col("uses_capture") & ~F.col("has_capture")), "capture_missing", F.lit("")),
    ]
    if "points" in rules.columns:
        wrong = heads.filter(F.col("points") != severity_points(F.col("severity"), config))
        out.append(finding(wrong, "severity_increment", F.concat_ws("/", "severity", F.col("points").cast("string"))))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
