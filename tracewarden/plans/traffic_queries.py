"""Traffic reports, splits, rule checks and streams, with their check SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewarden.config import ScanConfig
from tracewarden.functions.features import featurise
from tracewarden.operators import ranking, rules_check, traffic
from tracewarden.operators.requests import union_audit
from tracewarden.operators.scan import rule_scan
from tracewarden.operators.targets import explode_targets
from tracewarden.operators.verdicts import score_with
from tracewarden.plans import rule_pack, views
from tracewarden.plans.feature_queries import FEATURE_CTE
from tracewarden.plans.registry import register
from tracewarden.plans.scan_queries import SCORE_CTE, matches_cte
from tracewarden.schemas import PERCENTILES
from tracewarden.session import scratch_path
from tracewarden.sources import audit_json
from tracewarden.streaming import streams

_C = F.col
_TRAFFIC = views.cte("traffic")
_SPAN = "(SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM traffic)"


def _percentile_sql(column: str = "latency_ms") -> str:
    return ", ".join(f'quantile_disc({column}, {p}) AS "{name}"' for name, p in PERCENTILES.items())


_MEAN = "CAST(sum(CAST({0} AS DECIMAL(28,6))) AS DOUBLE) / count({0})"


def _summary_sql(kind: str, name: str, group: str) -> str:
    return f"""SELECT {kind} AS "Type", {name} AS "Name", count(*) AS "Request Count", count(error) AS "Failure Count",
  quantile_disc(latency_ms, 0.5) AS "Median Response Time", {_MEAN.format("latency_ms")} AS "Average Response Time",
  min(latency_ms) AS "Min Response Time", max(latency_ms) AS "Max Response Time", {_MEAN.format("size")} AS "Average Content Size",
  round(count(*) / {_SPAN}, 9) AS "Requests/s", round(count(error) / {_SPAN}, 9) AS "Failures/s", {_percentile_sql()}
FROM traffic {group}"""


def _traffic(spark, sf_dir):
    return views.view(spark, sf_dir, "traffic")


_ROUNDED = {"Requests/s": 9, "Failures/s": 9}


@register(
    "a10_traffic_summary",
    _TRAFFIC + _summary_sql("method", "name", "GROUP BY method, name") + "\nUNION ALL " + _summary_sql("CAST(NULL AS VARCHAR)", "'Aggregated'", ""),
)
def a10(spark, sf_dir):
    out = traffic.traffic_summary(_traffic(spark, sf_dir))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), n) for c, n in _ROUNDED.items()})


@register(
    "a11_failure_summary",
    _TRAFFIC + 'SELECT method AS "Method", name AS "Name", error AS "Error", count(*) AS "Occurrences" FROM traffic WHERE error IS NOT NULL GROUP BY ALL',
)
def a11(spark, sf_dir):
    return traffic.failure_summary(_traffic(spark, sf_dir))


@register(
    "w3_traffic_history",
    _TRAFFIC
    + """, t AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM traffic),
seconds AS (SELECT DISTINCT s FROM t),
rolling AS (SELECT x.s, count(DISTINCT t.user_id) AS users, round(count(*) / 10.0, 6) AS rate, round(count(t.error) / 10.0, 6) AS failed,
  """
    + _percentile_sql()
    + """
  FROM seconds x JOIN t ON t.s BETWEEN x.s - 9 AND x.s GROUP BY x.s),
per AS (SELECT s, count(*) AS n, count(error) AS f, sum(CAST(latency_ms AS DECIMAL(28,6))) AS l, min(latency_ms) AS lo, max(latency_ms) AS hi, sum(size) AS b FROM t GROUP BY s),
run AS (SELECT s, sum(n) OVER w AS n, sum(f) OVER w AS f, sum(l) OVER w AS l, min(lo) OVER w AS lo, max(hi) OVER w AS hi, sum(b) OVER w AS b
  FROM per WINDOW w AS (ORDER BY s)),
medians AS (SELECT s, max(m) AS m FROM (SELECT s, quantile_disc(latency_ms, 0.5) OVER (ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM t) x GROUP BY s)
SELECT s AS "Timestamp", users AS "User Count", rate AS "Requests/s", failed AS "Failures/s", """
    + ", ".join(f'"{p}"' for p in PERCENTILES)
    + """,
  CAST(n AS BIGINT) AS "Total Request Count", CAST(f AS BIGINT) AS "Total Failure Count", m AS "Total Median Response Time", CAST(l AS DOUBLE) / n AS "Total Average Response Time",
  lo AS "Total Min Response Time", hi AS "Total Max Response Time", CAST(b AS DOUBLE) / n AS "Total Average Content Size"
FROM run JOIN rolling USING (s) JOIN medians USING (s)""",
)
def w3(spark, sf_dir):
    out = traffic.traffic_history(_traffic(spark, sf_dir))
    return out.drop("Name").withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ("Requests/s", "Failures/s")})


_ORDERED = "row_number() OVER (PARTITION BY label ORDER BY sha1(concat(CAST(req_id AS VARCHAR), ':42')))"


@register(
    "w1_stratified_split",
    views.cte("requests") + f"SELECT req_id, label, rn <= round(n * 0.2) AS is_test FROM (SELECT req_id, label, {_ORDERED} AS rn, count(*) OVER (PARTITION BY label) AS n FROM requests) r",
)
def w1(spark, sf_dir):
    return ranking.stratified_split(views.requests(spark, sf_dir).select("req_id", "label"), "label", "req_id")


@register(
    "w2_stratified_folds",
    views.cte("requests") + f"SELECT req_id, label, CAST(({_ORDERED} - 1) % 5 AS INT) AS fold FROM requests",
)
def w2(spark, sf_dir):
    return ranking.stratified_folds(views.requests(spark, sf_dir).select("req_id", "label"), "label", "req_id")


# ---- rule tables derived from the part table ----------------------------------------------------------------------

_RULE_ROWS = """SELECT CAST(920000 + p_partkey % 997 AS INT) AS rule_id, CAST(p_size % 4 + 1 AS INT) AS pl,
  CASE WHEN p_partkey % 31 = 0 THEN 'typo_score' ELSE 'xss' END AS score_var,
  CASE WHEN p_size % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CAST(CASE WHEN p_partkey % 7 = 0 THEN 4 WHEN p_size % 2 = 0 THEN 5 ELSE 3 END AS INT) AS points,
  concat('paranoia-level/', CAST(CASE WHEN p_partkey % 13 = 0 THEN 9 ELSE p_size % 4 + 1 END AS VARCHAR(2)), ';', CASE WHEN p_partkey % 17 = 0 THEN 'odd-tag' ELSE 'attack-xss' END,
    CASE WHEN p_partkey % 19 = 0 THEN '' ELSE ';COMMON' END) AS tag_text,
  CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'v0' ELSE 'v1' END AS ver,
  CASE WHEN p_partkey % 5 = 0 THEN concat('(?i)', p_name) ELSE p_name END AS argument,
  CASE WHEN p_partkey % 10 = 0 THEN 'lowercase' ELSE 'none' END AS step FROM part"""
_RULES_CTE = f"WITH rules AS ({_RULE_ROWS})\n"
_APPROVED = ["COMMON", "attack-xss", "paranoia-level/1", "paranoia-level/2", "paranoia-level/3", "paranoia-level/4"]


def _rule_rows(spark, sf_dir):
    views.table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_RULE_ROWS)
    return rows.select(
        "rule_id", "pl", "score_var", "severity", "points", F.split("tag_text", ";").alias("tags"), "ver", "argument",
        F.array("step").alias("transforms"), F.lit("rx").alias("operator"), F.array(F.lit("ARGS")).alias("collections"),
        F.lit(None).cast("int").alias("chain_link"), F.lit(False).alias("capture"),
    )


@register(
    "j20_lint_rules",
    _RULES_CTE
    + """, t AS (SELECT rule_id, unnest(string_split(tag_text, ';')) AS tag FROM rules)
SELECT rule_id, 'duplicate_id' AS "check", CAST(count(*) AS VARCHAR) AS detail FROM rules GROUP BY rule_id HAVING count(*) > 1
UNION ALL SELECT rule_id, 'undefined_score_var', score_var FROM rules WHERE score_var <> 'xss'
UNION ALL SELECT rule_id, 'tag_not_approved', tag FROM t WHERE tag NOT IN ('COMMON', 'attack-xss', 'paranoia-level/1', 'paranoia-level/2', 'paranoia-level/3', 'paranoia-level/4')
UNION ALL SELECT rule_id, 'level_tag_mismatch', split_part(tag_text, ';', 1) FROM rules WHERE split_part(tag_text, ';', 1) <> concat('paranoia-level/', CAST(pl AS VARCHAR))
UNION ALL SELECT rule_id, 'common_tag_missing', 'COMMON' FROM rules WHERE NOT contains(tag_text, 'COMMON')
UNION ALL SELECT rule_id, 'version_missing', '' FROM rules WHERE ver IS NULL
UNION ALL SELECT rule_id, 'version_incorrect', ver FROM rules WHERE ver <> 'v1'
UNION ALL SELECT rule_id, 'ignorecase_with_lowercase', argument FROM rules WHERE starts_with(argument, '(?i)') AND step = 'lowercase'
UNION ALL SELECT rule_id, 'severity_increment', concat(severity, '/', CAST(points AS VARCHAR)) FROM rules WHERE points <> CASE severity WHEN 'CRITICAL' THEN 5 ELSE 3 END""",
)
def j20(spark, sf_dir):
    return rules_check.lint_rules(_rule_rows(spark, sf_dir), ["xss"], _APPROVED, "COMMON", "v1")


_SKIPPED = " OR ".join(f"starts_with(CAST(rule_id AS VARCHAR), '{p}')" for p in rules_check.UNTESTED_PREFIXES)
_UNTESTED = f"""SELECT DISTINCT rule_id FROM (SELECT CAST(920000 + p_partkey AS INT) AS rule_id FROM part) r WHERE rule_id % 1000 >= 100 AND NOT ({_SKIPPED})
  AND rule_id NOT IN (SELECT CAST(920000 + s_suppkey * 7 AS INT) FROM supplier)"""


def _untested(spark, sf_dir):
    rules = views.table(spark, sf_dir, "part").select((_C("p_partkey") + 920000).cast("int").alias("rule_id"))
    cases = views.table(spark, sf_dir, "supplier").select((_C("s_suppkey") * 7 + 920000).cast("int").alias("rule_id"))
    return rules_check.untested_rules(rules, cases)


register("j18_untested_rules", _UNTESTED)(_untested)
register("o2_difference", _UNTESTED)(lambda spark, sf_dir: _untested(spark, sf_dir))


@register(
    "o1_union",
    "SELECT doc_id AS id, source AS origin FROM documents UNION ALL SELECT page_id, url FROM pages",
)
def o1(spark, sf_dir):
    return union_audit(
        [
            views.table(spark, sf_dir, "documents").select(_C("doc_id").alias("id"), _C("source").alias("origin")),
            views.table(spark, sf_dir, "pages").select(_C("url").alias("origin"), _C("page_id").alias("id")),
        ]
    )


# ---- cases: every request is a case that expects the rules written for its payload ---------------------------------

_EXPECTED = {0: 942902, 1: 942901, 2: 941901, 3: 941902, 4: 930902, 8: 931901, 9: 933901, 11: 934901, 12: 944901, 18: 941903}
_EXPECT_SQL = " ".join(f"WHEN {slot} THEN {rule}" for slot, rule in _EXPECTED.items())


@register(
    "j19_check_expectations",
    matches_cte(rule_pack.PACK)
    + f""", cases AS (SELECT req_id AS case_id, CAST(CASE req_id % 40 {_EXPECT_SQL} END AS INT) AS wanted FROM requests),
m AS (SELECT DISTINCT req_id AS case_id, rule_id FROM matches)
SELECT c.case_id, (c.wanted IS NULL OR EXISTS (SELECT 1 FROM m WHERE m.case_id = c.case_id AND m.rule_id = c.wanted))
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = c.case_id AND m.rule_id = 955901) AS passed FROM cases c""",
)
def j19(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    wanted = F.coalesce(*[F.when(_C("req_id") % 40 == slot, rule) for slot, rule in _EXPECTED.items()])
    cases = requests.select(
        _C("req_id").alias("case_id"),
        F.when(wanted.isNotNull(), F.array(wanted)).alias("expect_ids"),
        F.array(F.lit(955901)).alias("no_expect_ids"),
    )
    used = sorted({c for r in rule_pack.PACK for c in r["collections"]})
    matches = rule_scan(explode_targets(requests, used), rule_pack.rules(spark), rule_pack.phrases(spark))
    return rules_check.check_expectations(cases, matches.withColumnRenamed("req_id", "case_id"))


# ---- streams ------------------------------------------------------------------------------------------------------


def _stream_requests(spark, sf_dir):
    stored = views.requests(spark, sf_dir)
    return streams.stream_table(spark, views.stored_path(spark, sf_dir), stored.schema)


def _paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


_X1 = ["NumParams", "NumSpecialChars", "DepthOfPath", "NumKeywords"]


@register("x1_stream_features", FEATURE_CTE + f"SELECT req_id, {', '.join(_X1)} FROM featured")
def x1(spark, sf_dir):
    path, checkpoint = _paths(spark, "x1")
    rows = streams.stream_features(_stream_requests(spark, sf_dir), _X1)
    streams.write_available(rows.select("req_id", *[_C(c).cast("long") for c in _X1]), path, checkpoint)
    return spark.read.parquet(path)


@register(
    "x2_stream_scan_score",
    SCORE_CTE + "SELECT r.req_id, coalesce(blocking_inbound, 0) AS blocking_inbound, coalesce(blocking_outbound, 0) AS blocking_outbound, coalesce(blocking_inbound >= 5 OR blocking_outbound >= 4, false) AS interrupted FROM requests r LEFT JOIN scores USING (req_id)",
)
def x2(spark, sf_dir):
    path, checkpoint = _paths(spark, "x2")
    config = ScanConfig(blocking_pl=1, detection_pl=4)
    streams.stream_scan_score(
        _stream_requests(spark, sf_dir), rule_pack.rules(spark), rule_pack.phrases(spark), config, path, checkpoint
    ).awaitTermination()
    return spark.read.parquet(path).select("req_id", "blocking_inbound", "blocking_outbound", "interrupted")


def _logistic(matrix):
    return 1 / (1 + np.exp(-(0.5 * matrix[:, 0] - 0.04 * matrix[:, 1])))


_U1_COLUMNS = ["NumKeywords", "NumParams"]
_P_SQL = "1 / (1 + exp(-(0.5 * NumKeywords - 0.04 * NumParams)))"
_VERDICT_SQL = (
    f"SELECT req_id, CASE WHEN {_P_SQL} > 0.5 THEN 'malicious' ELSE 'benign' END AS verdict, "
    f"round(CASE WHEN {_P_SQL} > 0.5 THEN {_P_SQL} ELSE 1 - {_P_SQL} END, 9) AS score FROM featured"
)


@register("u1_score_with_user_model", FEATURE_CTE + _VERDICT_SQL)
def u1(spark, sf_dir):
    rows = featurise(views.requests(spark, sf_dir), _U1_COLUMNS)
    return score_with(rows, _U1_COLUMNS, _logistic).select("req_id", "verdict", F.round("score", 9).alias("score"))


@register(
    "x3_stream_verdicts",
    FEATURE_CTE
    + f"SELECT req_id, verdict, score, CAST(CASE WHEN score > 0.8 THEN 1001 WHEN score > 0.5 THEN 1002 END AS INT) AS tier_rule FROM ({_VERDICT_SQL}) v",
)
def x3(spark, sf_dir):
    path, checkpoint = _paths(spark, "x3")
    rows = streams.stream_features(_stream_requests(spark, sf_dir), _U1_COLUMNS)
    scored = streams.stream_verdicts(rows, lambda df: score_with(df, _U1_COLUMNS, _logistic))
    streams.write_available(scored.select("req_id", "verdict", F.round("score", 9).alias("score"), "tier_rule"), path, checkpoint)
    return spark.read.parquet(path)


def _stream_events(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    return streams.stream_table(spark, f"{sf_dir}/events*.parquet", schema)


@register(
    "x4_stream_traffic",
    """SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures,
  """ + _MEAN.format("value") + " AS mean_latency FROM events GROUP BY 1",
)
def x4(spark, sf_dir):
    path, checkpoint = _paths(spark, "x4")
    events = _stream_events(spark, sf_dir).withColumns(
        {"error": F.when(_C("event_type") == "error", "failed"), "latency_ms": _C("value")}
    )
    streams.write_updates(streams.stream_traffic(events), path, checkpoint)
    return streams.latest_updates(spark, path, "second")


@register("x5_stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def x5(spark, sf_dir):
    path, checkpoint = _paths(spark, "x5")
    rows = streams.stream_dedup(_stream_events(spark, sf_dir), ["event_type", "user_id"], "365 days")
    streams.write_available(rows.select("event_type", "user_id"), path, checkpoint)
    return spark.read.parquet(path)


@register("x6_stream_alerts", "SELECT event_id, CAST(user_id % 16 AS BIGINT) AS level FROM events WHERE user_id % 16 >= 3")
def x6(spark, sf_dir):
    path, checkpoint = _paths(spark, "x6")
    rows = _stream_events(spark, sf_dir).select("event_id", (_C("user_id") % 16).alias("level"))
    streams.write_available(streams.stream_alerts(rows), path, checkpoint)
    return spark.read.parquet(path)


@register(
    "s13_stream_audit",
    views.cte("requests") + "SELECT CAST(req_id AS VARCHAR) AS transaction_id, method, path, body FROM requests",
)
def s13(spark, sf_dir):
    log = audit_json.write_audit_json(
        audit_json.nest_audit(audit_json.audit_records(views.requests(spark, sf_dir))), scratch_path(spark, "follow"), "20250710_200141"
    )
    path, checkpoint = _paths(spark, "s13")
    rows = audit_json.stream_audit(spark, log).select(
        "transaction_id", _C("request.method").alias("method"), _C("request.path").alias("path"),
        F.coalesce("request.body", F.lit("")).alias("body"),
    )
    streams.write_available(rows, path, checkpoint)
    return spark.read.parquet(path)
