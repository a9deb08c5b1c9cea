"""Round trips through every reader and writer, and the cleaning steps, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import cleaning as P
from tracewarden.operators.requests import union_audit
from tracewarden.plans import views
from tracewarden.plans.registry import register
from tracewarden.schemas import AUDIT_FLAT, TRAFFIC_HISTORY, TRAFFIC_STATS
from tracewarden.session import scratch_path
from tracewarden.sources import audit_csv, audit_json, tables

_C = F.col

# A flat audit log with the faults the cleaning job is there for, one fault per residue of event_id.
_RAW_LOG = """
SELECT event_id,
  CASE WHEN event_id % 50 = 7 THEN concat('error at ', CAST(event_id AS VARCHAR(20))) WHEN event_id % 50 = 8 THEN NULL
       ELSE concat('tx-', CAST(event_id AS VARCHAR(20))) END AS stamp,
  CASE WHEN event_id % 23 = 1 THEN NULL WHEN event_id % 23 = 2 THEN lower('Get') ELSE 'POST' END AS RequestMethod,
  concat('/', event_type) AS RequestURIPath, CAST(user_id AS INT) AS PathLength,
  CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 11 = 1 THEN NULL WHEN event_id % 2 = 0 THEN 'benign' ELSE 'malicious' END AS AIVerdictLabel,
  'x' AS AIVerdict
FROM events
"""
# rows with a path length divisible by three occur twice
LOG = (
    f"SELECT stamp, RequestMethod, RequestURIPath, PathLength, AIVerdictLabel, AIVerdict FROM ({_RAW_LOG}) a"
    f" UNION ALL SELECT stamp, RequestMethod, RequestURIPath, PathLength, AIVerdictLabel, AIVerdict FROM ({_RAW_LOG}) b"
    " WHERE PathLength % 3 = 0"
)
_LOG_CTE = f"WITH log AS ({LOG})\n"
_LOG_COLS = "stamp, RequestMethod, RequestURIPath, PathLength, AIVerdictLabel, AIVerdict"
_NOT_ERROR = "(stamp IS NULL OR NOT regexp_matches(stamp, '(?i)failed|error'))"


def _log(spark, sf_dir):
    views.table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(LOG)


@register("p1_drop_error_rows", _LOG_CTE + f"SELECT {_LOG_COLS} FROM log WHERE {_NOT_ERROR}")
def p1(spark, sf_dir):
    return P.drop_error_rows(_log(spark, sf_dir))


@register("p2_dedup_exact", _LOG_CTE + f"SELECT DISTINCT {_LOG_COLS} FROM log")
def p2(spark, sf_dir):
    return P.dedup_exact(_log(spark, sf_dir))


@register("p3_filter_label", _LOG_CTE + f"SELECT {_LOG_COLS} FROM log WHERE AIVerdictLabel IN ('benign', 'malicious')")
def p3(spark, sf_dir):
    return P.filter_label(_log(spark, sf_dir))


@register("p4_require_columns", _LOG_CTE + f"SELECT {_LOG_COLS} FROM log WHERE RequestMethod IS NOT NULL")
def p4(spark, sf_dir):
    return P.require_columns(_log(spark, sf_dir))


@register("p5_uppercase_columns", _LOG_CTE + f"SELECT {_LOG_COLS.replace('RequestMethod', 'upper(RequestMethod) AS RequestMethod')} FROM log")
def p5(spark, sf_dir):
    return P.uppercase_columns(_log(spark, sf_dir))


@register("p6_drop_columns_if_present", _LOG_CTE + "SELECT stamp, RequestMethod, RequestURIPath, PathLength, AIVerdictLabel FROM log")
def p6(spark, sf_dir):
    return P.drop_columns_if_present(_log(spark, sf_dir))


_CLEAN = f"""SELECT stamp, upper(RequestMethod) AS RequestMethod, RequestURIPath, PathLength, AIVerdictLabel
FROM (SELECT DISTINCT {_LOG_COLS} FROM log WHERE {_NOT_ERROR}) d
WHERE AIVerdictLabel IN ('benign', 'malicious') AND RequestMethod IS NOT NULL"""


@register("p7_clean_audit", _LOG_CTE + _CLEAN)
def p7(spark, sf_dir):
    return P.clean_audit(_log(spark, sf_dir))


@register(
    "p8_clean_report",
    _LOG_CTE
    + f""", kept AS (SELECT * FROM log WHERE {_NOT_ERROR}), uniq AS (SELECT DISTINCT * FROM kept),
labelled AS (SELECT * FROM uniq WHERE AIVerdictLabel IN ('benign', 'malicious'))
SELECT (SELECT count(*) FROM log) AS rows_in, (SELECT count(*) FROM log) - (SELECT count(*) FROM kept) AS removed_error,
  (SELECT count(*) FROM kept) - (SELECT count(*) FROM uniq) AS removed_duplicate,
  (SELECT count(*) FROM uniq) - (SELECT count(*) FROM labelled) AS removed_label,
  (SELECT count(*) FROM labelled WHERE RequestMethod IS NULL) AS removed_missing,
  (SELECT count(*) FROM labelled WHERE RequestMethod IS NOT NULL) AS rows_out""",
)
def p8(spark, sf_dir):
    return P.clean_report(_log(spark, sf_dir))


@register(
    "p9_fill_defaults",
    _LOG_CTE
    + """SELECT coalesce(stamp, '') AS stamp, coalesce(RequestMethod, '') AS RequestMethod, coalesce(PathLength, 0) AS PathLength,
  CAST(0 AS INT) AS QueryLength, '' AS UserAgent FROM log""",
)
def p9(spark, sf_dir):
    rows = _log(spark, sf_dir).select("stamp", "RequestMethod", "PathLength")
    return P.fill_defaults(rows, ["PathLength", "QueryLength"], ["stamp", "UserAgent"], ["RequestMethod"])


@register(
    "p10_binary_label",
    views.cte("requests") + "SELECT req_id, CAST(CASE WHEN label = 'malicious' THEN 1 ELSE 0 END AS INT) AS label FROM requests",
)
def p10(spark, sf_dir):
    return views.requests(spark, sf_dir).select("req_id", P.binary_label(_C("label")).alias("label"))


@register(
    "p11_scoring_gate",
    views.cte("requests") + "SELECT req_id, (body <> '' OR query <> '' OR method IN ('POST', 'PUT')) AS gated FROM requests",
)
def p11(spark, sf_dir):
    rows = views.requests(spark, sf_dir)
    return rows.select("req_id", P.scoring_gate(_C("method"), _C("query"), _C("body")).alias("gated"))


_TRAVERSAL_SQL = " OR ".join(f"regexp_matches(payload, '(?is){p}')" for p in P.TRAVERSAL_PATTERNS)


@register("p12_is_traversal", views.cte("requests") + f"SELECT req_id, ({_TRAVERSAL_SQL}) AS hit FROM requests")
def p12(spark, sf_dir):
    return views.requests(spark, sf_dir).select("req_id", P.is_traversal(_C("payload")).alias("hit"))


@register(
    "p13_training_guards",
    views.cte("requests")
    + """SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_features, count(DISTINCT label) AS n_classes,
  count(*) > 0 AND count(DISTINCT label) >= 2 AS trainable FROM requests""",
)
def p13(spark, sf_dir):
    return P.training_guards(views.requests(spark, sf_dir), ["path", "query"])


@register("p14_numeric_columns_only", "SELECT doc_id, n_chars FROM documents")
def p14(spark, sf_dir):
    return P.numeric_columns_only(views.table(spark, sf_dir, "documents"))


# ---- round trips --------------------------------------------------------------------------------------------------

_AUDIT = """SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS TransactionID, 'POST' AS RequestMethod, concat('/', lang) AS RequestURIPath,
  text AS RequestBody, CAST(n_chars AS INT) AS BodyLength, doc_id % 2 = 0 AS IsXMLBody FROM documents"""


def _audit_log(spark, sf_dir):
    views.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    rows = spark.sql(_AUDIT)
    return rows.select(
        *[(_C(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT_FLAT.fields]
    ).withColumn("Timestamp", F.lit("2025-07-10T20:01:41Z").cast("timestamp"))


_READ_BACK = ["TransactionID", "RequestMethod", "RequestURIPath", "RequestBody", "BodyLength", "IsXMLBody"]
_READ_SQL = f"SELECT TransactionID, RequestMethod, RequestURIPath, replace(RequestBody, chr(13), '') AS RequestBody, BodyLength, IsXMLBody FROM ({_AUDIT}) a"


@register("s1_read_audit_csv", _READ_SQL)
def s1(spark, sf_dir):
    """Whole document texts as bodies, line breaks and all, written as CSV and put together again."""
    path = audit_csv.write_audit_csv(_audit_log(spark, sf_dir), scratch_path(spark, "audit-csv"), "20250710_200141")
    missing = scratch_path(spark, "no-such-log")
    back = audit_csv.read_audit_csv(spark, [f"{path}/*.csv", missing])
    return back.select(*_READ_BACK).withColumn("RequestBody", F.replace("RequestBody", F.lit("\r"), F.lit("")))


@register("s1_header_order", _READ_SQL)
def s1_header_order(spark, sf_dir):
    """The same log written in two column orders, half the rows each, with quoted headers in one."""
    log = _audit_log(spark, sf_dir)
    first, second = (log.filter(F.pmod(F.xxhash64("TransactionID"), F.lit(2)) == half) for half in (0, 1))
    paths = [scratch_path(spark, name) for name in ("audit-as-is", "audit-reversed")]
    first = audit_csv.write_audit_csv(first, paths[0], "20250710_200141")
    text = second.select(*[_C(c).cast("string").alias(c) for c in reversed(log.columns)])
    text.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(paths[1])
    back = audit_csv.read_audit_csv(spark, [f"{first}/*.csv", f"{paths[1]}/*.csv"])
    return back.select(*_READ_BACK).withColumn("RequestBody", F.replace("RequestBody", F.lit("\r"), F.lit("")))


_STRAY = """SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS TransactionID, concat('/', CASE WHEN doc_id % 10 = 4 THEN 'a"b' ELSE '' END, lang) AS RequestURIPath,
  text AS RequestBody FROM documents"""


@register(
    "s1_stray_quote",
    f"SELECT TransactionID, RequestURIPath, replace(RequestBody, chr(13), '') AS RequestBody FROM ({_STRAY}) a WHERE substr(TransactionID, length(TransactionID), 1) <> '3'",
)
def s1_stray_quote(spark, sf_dir):
    """Every tenth record has a field with an opening quote that is never closed, another tenth a quote within a plain field."""
    docs = views.table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("documents")
    body = F.concat(F.lit('"'), F.replace("RequestBody", F.lit('"'), F.lit('""')), F.lit('"'))
    whole = F.concat_ws(",", "TransactionID", "RequestURIPath", body)
    damaged = F.concat(_C("TransactionID"), F.lit(',"'), _C("RequestURIPath"), F.lit(",no end"))
    rows = spark.sql(_STRAY).select("TransactionID", F.when(_C("TransactionID").endswith("3"), damaged).otherwise(whole).alias("line"))
    files = 1 + docs.count() // 500
    rows = rows.groupBy(F.pmod(F.xxhash64("TransactionID"), F.lit(files)).alias("part")).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    path = scratch_path(spark, "stray-quotes")
    header = F.array(F.lit("TransactionID,RequestURIPath,RequestBody"))
    rows.select("part", F.array_join(F.concat(header, "lines"), "\n").alias("value")).write.partitionBy("part").text(path)
    back = audit_csv.read_audit_csv(spark, f"{path}/*/*.txt")
    return back.select("TransactionID", "RequestURIPath", F.replace("RequestBody", F.lit("\r"), F.lit("")).alias("RequestBody"))


@register(
    "s2_drop_corrupt_lines",
    "SELECT concat('line ', CAST(event_id AS VARCHAR(20))) AS value FROM events WHERE event_id % 5 > 1",
)
def s2(spark, sf_dir):
    path = scratch_path(spark, "corrupt")
    first, second = audit_csv.BAD_ENDINGS
    ending = F.when(_C("event_id") % 5 == 0, F.lit(first)).when(_C("event_id") % 5 == 1, F.lit(second)).otherwise(F.lit(""))
    events = views.table(spark, sf_dir, "events")
    events.select(F.concat(F.lit("line "), _C("event_id").cast("string"), ending).alias("value")).write.text(path)
    return audit_csv.drop_corrupt_lines(spark.read.text(path))


@register(
    "s3_union_audit",
    """SELECT event_id AS id, event_type AS kind, CAST(NULL AS VARCHAR) AS lang FROM events
UNION ALL SELECT doc_id, CAST(NULL AS VARCHAR), lang FROM documents""",
)
def s3(spark, sf_dir):
    return union_audit(
        [
            views.table(spark, sf_dir, "events").select(_C("event_id").alias("id"), _C("event_type").alias("kind")),
            views.table(spark, sf_dir, "documents").select("lang", _C("doc_id").alias("id")),
        ]
    )


_NESTED_SQL = (
    views.cte("requests")
    + """SELECT CAST(req_id AS VARCHAR) AS transaction_id, method, path, query, body, coalesce(user_agent, '') AS user_agent,
  CAST(status AS INT) AS status, CAST(strlen(query) AS INT) AS query_length FROM requests"""
)


def _nested(spark, sf_dir):
    return audit_json.nest_audit(audit_json.audit_records(views.requests(spark, sf_dir)))


def _nested_columns(nested):
    c = nested
    calculated = F.col("calculated_fields")
    return c.select(
        "transaction_id", _C("request.method").alias("method"), _C("request.path").alias("path"),
        F.coalesce("request.query", F.lit("")).alias("query"), F.coalesce("request.body", F.lit("")).alias("body"),
        F.coalesce("request.headers.user_agent", F.lit("")).alias("user_agent"), _C("response.status_code").alias("status"),
        F.coalesce(calculated["query_ength"], calculated["query_length"]).alias("query_length"),
    )


@register("s4_read_audit_json", _NESTED_SQL)
def s4(spark, sf_dir):
    """Records behind a date prefix over many lines, with an information line in front of some."""
    path = scratch_path(spark, "audit-pretty")
    pretty = F.to_json(F.struct("*"), {"pretty": "true"})
    note = F.when(_C("transaction_id").cast("long") % 10 == 0, F.lit("2025/07/10 20:01:40 INFO: forwarded\n")).otherwise(F.lit(""))
    rows = _nested(spark, sf_dir)
    rows.select(F.concat(note, F.lit("2025/07/10 20:01:41 "), pretty).alias("value")).write.text(path)
    return _nested_columns(audit_json.read_audit_json(spark, path))


@register("s4_read_audit_json_lines", _NESTED_SQL)
def s4_lines(spark, sf_dir):
    path = audit_json.write_audit_json(_nested(spark, sf_dir), scratch_path(spark, "audit-json"), "20250710_200141")
    return _nested_columns(audit_json.read_audit_json(spark, path, layout="lines"))


@register(
    "s5_flatten_audit",
    views.cte("requests")
    + """SELECT CAST(req_id AS VARCHAR) AS TransactionID, method AS RequestMethod, path AS RequestURIPath, query AS RequestURIQuery,
  body AS RequestBody, CAST(status AS INT) AS ResponseStatus, CAST(0 AS INT) AS MatchedRulesCount,
  CASE WHEN response_encoding IS NULL THEN 'Content-Type:text/html' ELSE concat('Content-Encoding:', response_encoding, '; Content-Type:text/html') END AS ResponseHeaders,
  label AS AIVerdictLabel FROM requests""",
)
def s5(spark, sf_dir):
    flat = audit_json.flatten_audit(_nested(spark, sf_dir))
    return flat.select(
        "TransactionID", "RequestMethod", "RequestURIPath", "RequestURIQuery", "RequestBody", "ResponseStatus",
        "MatchedRulesCount", "ResponseHeaders", "AIVerdictLabel",
    )


@register("s6_s7_write_read_clean", _LOG_CTE + _CLEAN)
def s6(spark, sf_dir):
    base = scratch_path(spark, "clean")
    path = tables.write_clean(P.clean_audit(_log(spark, sf_dir)), base, "20250710_200141")
    return tables.read_clean(spark, path)


@register("s7_read_clean_csv", "SELECT event_id, event_type, user_id FROM events")
def s7_csv(spark, sf_dir):
    """The CSV form with a declared schema."""
    schema = "event_id long, event_type string, user_id long"
    events = views.table(spark, sf_dir, "events").select(_C("event_id").cast("long"), "event_type", _C("user_id").cast("long"))
    path = tables.write_clean(events, scratch_path(spark, "clean-csv"), "20250710_200141", "csv")
    return tables.read_clean(spark, path, "csv", schema)


@register(
    "s9_read_traffic_stats",
    """SELECT event_type AS "Name", CAST(user_id AS BIGINT) AS "Request Count", CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS "99%" FROM events""",
)
def s9_stats(spark, sf_dir):
    path, events = scratch_path(spark, "stats"), views.table(spark, sf_dir, "events")
    high = F.when(_C("event_id") % 3 == 0, "N/A").otherwise(_C("value").cast("string"))
    given = {"Name": _C("event_type"), "Request Count": _C("user_id"), "99%": high}
    events.select(*[given.get(f.name, F.lit("0")).alias(f.name) for f in TRAFFIC_STATS.fields]).write.option("header", True).csv(path)
    return tables.read_traffic_stats(spark, path).select("Name", "`Request Count`", "`99%`")


@register(
    "s9_read_traffic_failures",
    """SELECT 'GET' AS "Method", event_type AS "Name", concat('error, "', user_id, '"') AS "Error", CAST(event_id AS BIGINT) AS "Occurrences" FROM events""",
)
def s9_failures(spark, sf_dir):
    path, events = scratch_path(spark, "failures"), views.table(spark, sf_dir, "events")
    error = F.concat(F.lit('error, "'), _C("user_id").cast("string"), F.lit('"'))
    rows = events.select(F.lit("GET").alias("Method"), _C("event_type").alias("Name"), error.alias("Error"), _C("event_id").alias("Occurrences"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_traffic_failures(spark, path)


@register(
    "s8_write_audit_sinks",
    views.cte("requests") + "SELECT label, CAST(count(*) AS BIGINT) AS n FROM requests GROUP BY label",
)
def s8(spark, sf_dir):
    rows = audit_json.audit_records(views.requests(spark, sf_dir))
    path = audit_csv.write_audit_csv(rows, scratch_path(spark, "sink"), "20250710_200141", "AIVerdictLabel")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.groupBy(_C("AIVerdictLabel").alias("label")).agg(F.count("*").alias("n"))


@register(
    "s9_read_traffic_history",
    """SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS "Timestamp", CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS "50%"
FROM events""",
)
def s9(spark, sf_dir):
    path = scratch_path(spark, "history")
    events = views.table(spark, sf_dir, "events")
    median = F.when(_C("event_id") % 3 == 0, "N/A").otherwise(_C("value").cast("string"))
    second = F.unix_seconds(F.date_trunc("second", _C("ts").cast("timestamp")))
    given = {"Timestamp": second, "50%": median, "Name": F.lit("Aggregated")}
    events.select(*[given.get(f.name, F.lit("0")).alias(f.name) for f in TRAFFIC_HISTORY.fields]).write.option(
        "header", True
    ).csv(path)
    return tables.read_traffic_history(spark, path).select("Timestamp", "`50%`")


@register("s10_read_phrase_list", "SELECT 'events' AS list_name, event_type || ' ' || user_id AS phrase FROM events WHERE event_id % 4 > 1")
def s10(spark, sf_dir):
    path = scratch_path(spark, "phrases")
    phrase = F.concat_ws(" ", "event_type", _C("user_id").cast("string"))
    line = F.when(_C("event_id") % 4 == 0, F.lit("# note")).when(_C("event_id") % 4 == 1, F.lit("")).otherwise(phrase)
    views.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return tables.read_phrase_list(spark, path, "events")


_RULE_ROWS = """SELECT CAST(920000 + p_partkey AS INT) AS rule_id, 'part' AS family, CAST(p_partkey % 4 + 1 AS INT) AS pl, 'rx' AS operator,
  p_name AS argument, CASE WHEN p_partkey % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM part"""


@register("s11_read_rules", _RULE_ROWS)
def s11(spark, sf_dir):
    path = scratch_path(spark, "rules")
    views.table(spark, sf_dir, "part").createOrReplaceTempView("part")
    spark.sql(_RULE_ROWS).write.json(path)
    return tables.read_rules(spark, path).select("rule_id", "family", "pl", "operator", "argument", "severity")


@register(
    "s12_read_cases",
    """SELECT CAST(941100 AS INT) AS rule_id, CAST(event_id AS INT) AS test_id, event_type AS "desc", CAST(user_id AS INT) AS expected FROM events""",
)
def s12(spark, sf_dir):
    path = scratch_path(spark, "cases")
    events = views.table(spark, sf_dir, "events")
    events.select(
        F.lit(941100).alias("rule_id"), _C("event_id").cast("int").alias("test_id"), _C("event_type").alias("desc"),
        F.array(_C("user_id").cast("int")).alias("expect_ids"),
    ).write.json(path)
    return tables.read_cases(spark, path).select("rule_id", "test_id", "desc", F.get("expect_ids", F.lit(0)).alias("expected"))
