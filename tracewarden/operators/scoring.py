"""Anomaly scores, decisions and reports from matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import CATEGORIES, ScanConfig
from tracewarden.operators.requests import REPORT_CATEGORIES

LEVELS = (1, 2, 3, 4)
#: Rules (a short row each) that are broadcast; beyond that Spark splits skewed joins itself.
BROADCAST_FACTS = 20_000


def severity_points(severity: Column, config: ScanConfig = ScanConfig()) -> Column:
    points = reduce(
        lambda acc, item: acc.when(F.upper(severity) == item[0], item[1]),
        list(config.points.items())[1:],
        F.when(F.upper(severity) == list(config.points)[0], config.points[list(config.points)[0]]),
    )
    return points.otherwise(0)


def rule_facts(rules: DataFrame, *columns: str) -> DataFrame:
    """One row per rule id; a chain is described by its last link."""
    if "chain_len" in rules.columns:
        rules = rules.filter((F.coalesce("chain_len", F.lit(1)) <= 1) | (F.col("chain_link") == F.col("chain_len")))
    return rules.select("rule_id", *columns).dropDuplicates(["rule_id"])


def point_matches(matches: DataFrame, rules: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Matches with level, direction, category, phase and points of their rule."""
    facts = rule_facts(rules, "pl", "severity", "score_var", "direction", "phase")
    return _with_facts(matches, facts.withColumn("points", severity_points(F.col("severity"), config)))


def _with_facts(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Join on the rule. A common rule has many matches: facts are broadcast while they are few, so it is not one task."""
    few = len(facts.select("rule_id").take(BROADCAST_FACTS + 1)) <= BROADCAST_FACTS
    return matches.join(F.broadcast(facts) if few else facts, "rule_id")


def _measures(config: ScanConfig, of: str = "") -> dict[str, str]:
    """Which matches each score counts, as SQL over the facts of the match's rule; ``of`` is put before their names."""
    found = {}
    for side in ("inbound", "outbound"):
        here = f"{of}direction = '{side}' AND {of}pl"
        found.update({f"{side}_pl{n}": f"{here} = {n}" for n in LEVELS})
        found[f"blocking_{side}"] = f"{here} <= {config.blocking_pl}"
        found[f"detection_{side}"] = f"{here} <= {config.detection_level}"
    found["early_inbound"] = f"{found['blocking_inbound']} AND {of}phase = 1"
    return found | {f"{name}_score": f"{of}score_var = '{name}'" for name in CATEGORIES}


def score_requests(matches: DataFrame, rules: DataFrame, config: ScanConfig = ScanConfig(), key: str = "req_id") -> DataFrame:
    """Per request: sums by direction and level, by category, blocking and detection totals, and the header phase alone.

    One aggregation on the request id; partial sums are formed before the shuffle.
    """
    pointed = point_matches(matches, rules, config)
    total = lambda counted: F.expr(f"CAST(coalesce(sum(CASE WHEN {counted} THEN points END), 0) AS BIGINT)")
    return pointed.groupBy(key).agg(*(total(counted).alias(name) for name, counted in _measures(config).items()))


def score_rows(rows: DataFrame, config: ScanConfig = ScanConfig(), matches: str = "matches") -> DataFrame:
    """The scores of ``score_requests`` from the array of matches in each row (``row_scan.with_matches``): no shuffle.

    Every row is kept; one without matches scores zero.
    """

    facts = ("pl", "direction", "phase", "score_var")
    pointed = F.transform(matches, lambda m: F.struct(*(m[n].alias(n) for n in facts), severity_points(m["severity"], config).alias("points")))
    total = lambda counted: F.expr(f"aggregate(__pointed, 0L, (so_far, m) -> so_far + CASE WHEN {counted} THEN m.points ELSE 0 END)")
    scores = {name: total(counted) for name, counted in _measures(config, "m.").items()}
    return rows.withColumn("__pointed", pointed).withColumns(scores).drop("__pointed")


SCORE_COLUMNS = (
    [f"{s}_pl{n}" for s in ("inbound", "outbound") for n in LEVELS]
    + [f"{k}_{s}" for s in ("inbound", "outbound") for k in ("blocking", "detection")]
    + ["early_inbound"]
    + [f"{c}_score" for c in CATEGORIES]
)


def complete_scores(keys: DataFrame, scores: DataFrame, key: str = "req_id") -> DataFrame:
    """Every request, with zero scores where nothing matched."""
    return keys.select(key).join(scores, key, "left").na.fill(0, subset=SCORE_COLUMNS)


def decide_waf(scores: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Deny when a blocking score reaches its threshold; with early blocking the header phase decides first."""
    inbound = F.col("blocking_inbound") >= config.inbound_threshold
    outbound = F.col("blocking_outbound") >= config.outbound_threshold
    early = (F.col("early_inbound") >= config.inbound_threshold) & F.lit(config.early_blocking)
    rule = F.when(early, 949111).when(inbound, 949110).when(outbound, 959100)
    return scores.withColumns(
        {
            "interrupted": rule.isNotNull(),
            "interruption_rule": rule,
            "interruption_status": F.when(rule.isNotNull(), 403),
            "action": F.when(rule.isNotNull(), "deny").otherwise("pass"),
        }
    )


def reported(config: ScanConfig) -> Column:
    """Whether a request is reported at the configured level (0 none … 5 all)."""
    level = config.reporting_level
    over = lambda kind: (F.col(f"{kind}_inbound") >= config.inbound_threshold) | (F.col(f"{kind}_outbound") >= config.outbound_threshold)
    blocking = F.col("blocking_inbound") + F.col("blocking_outbound")
    detection = F.col("detection_inbound") + F.col("detection_outbound")
    if level <= 0:
        return F.lit(False)
    if level >= 5:
        return F.lit(True)
    steps = [over("blocking"), over("detection"), blocking > 0, detection > 0][:level]
    return (detection != 0) & reduce(lambda a, b: a | b, steps)


def report_level(scores: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    return scores.filter(reported(config))


def correlate(scores: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Combined totals and the report line."""

    def side(name: str, threshold: int) -> tuple[str, list[str]]:
        label = name.capitalize()
        text = f"({label} Scores: blocking=%d, detection=%d, per_pl=%d-%d-%d-%d, threshold={threshold})"
        return text, [f"blocking_{name}", f"detection_{name}", *[f"{name}_pl{n}" for n in LEVELS]]

    in_text, in_cols = side("inbound", config.inbound_threshold)
    out_text, out_cols = side("outbound", config.outbound_threshold)
    cats = ", ".join(f"{short}=%d" for short in REPORT_CATEGORIES)
    line = f"Anomaly Scores: {in_text} - {out_text} - ({cats}, COMBINED_SCORE=%d)"
    scored = scores.withColumns(
        {
            "blocking_total": F.col("blocking_inbound") + F.col("blocking_outbound"),
            "detection_total": F.col("detection_inbound") + F.col("detection_outbound"),
        }
    )
    args = [*in_cols, *out_cols, *[f"{c}_score" for c in REPORT_CATEGORIES.values()], "blocking_total"]
    return scored.withColumn("report", F.format_string(line, *[F.col(a) for a in args]))


def matched_rules_summary(matches: DataFrame, rules: DataFrame, key: str = "req_id") -> DataFrame:
    """Count, ids, messages and tags of the rules that matched each request, in order of their ids.

    Matches are made distinct per request and rule first, so a list holds at most one entry per rule.
    """
    facts = rule_facts(rules, "msg", "tags")
    per_rule = _with_facts(matches.select(key, "rule_id").distinct(), facts)
    entries = F.array_sort(F.collect_list(F.struct("rule_id", "msg", "tags")))
    joined = lambda f: F.array_join(F.transform("entries", f), ";")
    return (
        per_rule.groupBy(key)
        .agg(entries.alias("entries"))
        .select(
            key,
            F.size("entries").cast("long").alias("matched_count"),
            joined(lambda e: e["rule_id"].cast("string")).alias("rule_ids"),
            joined(lambda e: e["msg"]).alias("messages"),
            joined(lambda e: F.array_join(e["tags"], ";")).alias("tags"),
        )
    )


def block_rate(responses: DataFrame, status: str = "status", blocked: int = 403) -> DataFrame:
    """Share of blocked responses."""
    return responses.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col(status) == blocked).alias("blocked"),
        F.avg((F.col(status) == blocked).cast("double")).alias("block_rate"),
    )


def label_distribution(requests: DataFrame, columns: list[str]) -> DataFrame:
    return requests.groupBy(*columns).agg(F.count("*").alias("n"))
