"""Nested audit logs: pretty-printed JSON records behind a date prefix, or one record per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions import features as X
from tracewarden.operators.requests import flatten_headers
from tracewarden.schemas import AUDIT_FLAT, AUDIT_NESTED, FLAT_COLUMNS

# A record ends where a closing brace stands alone at the start of a line; inner braces are indented and line breaks
# inside strings are escaped. Splitting there lets a large file be read in parallel.
RECORD_END = "\n}\n"
_HEAD = r"(?s)^.*?(?:^|\n)[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} \{"


def record_json(text: Column) -> Column:
    """JSON text of one pretty-printed record without its date prefix; null for other log lines."""
    body = F.regexp_replace(text, _HEAD, "{")
    closed = F.when(F.rtrim(body).endswith("\n}"), body).otherwise(F.concat(body, F.lit("\n}")))
    return F.when(text.rlike(_HEAD), closed)


def _parsed(json: Column) -> Column:
    return F.from_json(json, AUDIT_NESTED, {"mode": "PERMISSIVE"})


def read_audit_json(spark: SparkSession, path: str, layout: str = "pretty") -> DataFrame:
    if layout == "lines":
        return spark.read.schema(AUDIT_NESTED).json(path)
    lines = spark.read.option("lineSep", RECORD_END).text(path)
    return (
        lines.select(_parsed(record_json(F.col("value"))).alias("r"))
        .filter(F.col("r.transaction_id").isNotNull())
        .select("r.*")
    )


def write_audit_json(nested: DataFrame, base: str, started: str, partition_by: str | None = None) -> str:
    path = f"{base}_{started}"
    writer = nested.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
    return path


def stream_audit(spark: SparkSession, path: str, layout: str = "lines", max_files: int = 1000) -> DataFrame:
    """Follow a folder of nested audit logs."""
    if layout == "lines":
        return spark.readStream.schema(AUDIT_NESTED).option("maxFilesPerTrigger", max_files).json(path)
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", RECORD_END).text(path)
    return (
        lines.select(_parsed(record_json(F.col("value"))).alias("r"))
        .filter(F.col("r.transaction_id").isNotNull())
        .select("r.*")
    )


# Flat column -> path in the nested record, where the value is taken over as it is.
_DIRECT = {
    "Timestamp": "timestamp", "TransactionID": "transaction_id", "ClientIP": "client_ip", "ClientPort": "client_port",
    "ServerIP": "server_ip", "ServerPort": "server_port", "RequestMethod": "request.method",
    "RequestURIPath": "request.path", "RequestURIQuery": "request.query", "RequestProtocol": "request.protocol",
    "UserAgent": "request.headers.user_agent", "Referer": "request.headers.referer",
    "AcceptEncoding": "request.headers.accept_encoding", "ContentType": "request.headers.content_type",
    "Accept": "request.headers.accept", "Cookie": "request.headers.cookie",
    "Connection": "request.headers.connection", "RequestBody": "request.body",
    "ResponseStatus": "response.status_code", "ResponseProtocol": "response.protocol",
    "ResponseBody": "response.body", "WAFInterrupted": "waf_processing.interrupted",
    "InterruptionRuleID": "waf_processing.interruption_details.rule_id",
    "InterruptionStatus": "waf_processing.interruption_details.status",
    "InterruptionAction": "waf_processing.interruption_details.action",
    "AIScore": "waf_processing.ai_score", "AIVerdict": "waf_processing.ai_verdict",
    "AIVerdictLabel": "waf_processing.ai_verdict_label",
    "AIVulnerabilityTypeLabel": "waf_processing.ai_vulnerability_type_label",
}
_CALCULATED = {
    "RequestLength": "request_length", "PathLength": "path_length", "BodyLength": "body_length",
    "NumParams": "num_params", "LongestParamValueLength": "longest_param_value_length",
    "NumSpecialChars": "num_special_chars", "NumEncodedChars": "num_encoded_chars",
    "NumDoubleEncodedChars": "num_double_encoded_chars",
    "RatioSpecialCharsToTotalChars": "ratio_special_chars_to_total_chars", "NumKeywords": "num_keywords",
    "NumUniqueChars": "num_unique_chars", "IsJSONBody": "is_json_body", "IsXMLBody": "is_xml_body",
    "IsMultipartForm": "is_multipart_form", "HasNumericPathSegment": "has_numeric_path_segment",
    "DepthOfPath": "depth_of_path", "UsesBase64Encoding": "uses_base64_encoding",
    "UsesHexEncoding": "uses_hex_encoding", "HasMultipleContentLength": "has_multiple_content_length",
    "InvalidHTTPVersion": "invalid_http_version", "NumHTTPHeaders": "num_http_headers",
    "TimeOfDayHour": "time_of_day_hour", "TimeOfDayDayOfWeek": "time_of_day_day_of_week",
}


def flatten_audit(nested: DataFrame) -> DataFrame:
    """Nested records as flat rows; rule ids, messages and tags are joined with ``;``."""
    rules = F.coalesce(F.col("waf_processing.matched_rules"), F.expr("cast(array() as array<struct<rule_id: string, message: string, tags: array<string>>>)"))
    calculated = F.col("calculated_fields")
    columns = {flat: F.col(path) for flat, path in _DIRECT.items()}
    columns.update({flat: calculated[name] for flat, name in _CALCULATED.items()})
    columns.update(
        {
            "QueryLength": F.coalesce(calculated["query_ength"], calculated["query_length"]),
            "OtherHeaders": flatten_headers(F.col("request.headers.other_headers")),
            "ResponseHeaders": flatten_headers(F.col("response.headers")),
            "MatchedRulesCount": F.size(rules),
            "MatchedRulesIDs": F.array_join(F.transform(rules, lambda r: r["rule_id"]), ";"),
            "MatchedRulesMessages": F.array_join(F.transform(rules, lambda r: r["message"]), ";"),
            "MatchedRulesTags": F.array_join(F.transform(rules, lambda r: F.array_join(r["tags"], ";")), ";"),
        }
    )
    return nested.select(*[columns[name].alias(name) for name in FLAT_COLUMNS])


def _header_map(text: Column) -> Column:
    """``k:v1,v2; k2:v`` back into a map of arrays."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "; ", -1), lambda s: s != "")
    return F.map_from_entries(
        F.transform(
            lines,
            lambda s: F.struct(
                F.regexp_extract(s, r"(?s)^([^:]*)", 1).alias("key"),
                F.split(F.regexp_replace(s, r"(?s)^[^:]*:", ""), ",", -1).alias("value"),
            ),
        )
    )


def nest_audit(flat: DataFrame) -> DataFrame:
    """Flat rows as nested records. Tags stay a bag of the whole request: the flat row does not say whose they are."""
    c = F.col
    ids, messages = F.split(c("MatchedRulesIDs"), ";", -1), F.split(c("MatchedRulesMessages"), ";", -1)
    no_tags = F.array().cast("array<string>")
    rules = F.when(
        F.coalesce(c("MatchedRulesIDs"), F.lit("")) != "",
        F.transform(
            F.arrays_zip(ids.alias("rule_id"), messages.alias("message")),
            lambda r: F.struct(r["rule_id"].alias("rule_id"), r["message"].alias("message"), no_tags.alias("tags")),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<rule_id: string, message: string, tags: array<string>>>)"))
    uri = F.when(F.coalesce(c("RequestURIQuery"), F.lit("")) == "", c("RequestURIPath")).otherwise(
        F.concat_ws("?", "RequestURIPath", "RequestURIQuery")
    )
    named = ["UserAgent", "Referer", "AcceptEncoding", "ContentType", "Accept", "Cookie", "Connection"]
    header_fields = [c(n).alias(_DIRECT[n].rsplit(".", 1)[1]) for n in named]
    request = F.struct(
        c("RequestMethod").alias("method"), uri.alias("uri"), c("RequestURIPath").alias("path"),
        c("RequestURIQuery").alias("query"), c("RequestProtocol").alias("protocol"),
        F.struct(*header_fields, _header_map(c("OtherHeaders")).alias("other_headers")).alias("headers"),
        c("RequestBody").alias("body"),
    )
    response = F.when(
        c("ResponseStatus").isNotNull(),
        F.struct(
            c("ResponseStatus").alias("status_code"), c("ResponseProtocol").alias("protocol"),
            _header_map(c("ResponseHeaders")).alias("headers"), c("ResponseBody").alias("body"),
        ),
    )
    details = F.when(
        c("InterruptionRuleID").isNotNull(),
        F.struct(
            c("InterruptionRuleID").alias("rule_id"), c("InterruptionStatus").alias("status"),
            c("InterruptionAction").alias("action"),
        ),
    )
    processing = F.struct(
        c("WAFInterrupted").alias("interrupted"), details.alias("interruption_details"), rules.alias("matched_rules"),
        c("AIScore").alias("ai_score"), c("AIVerdict").alias("ai_verdict"),
        c("AIVerdictLabel").alias("ai_verdict_label"),
        c("AIVulnerabilityTypeLabel").alias("ai_vulnerability_type_label"),
    )
    calculated = F.struct(
        *[c(flat_name).alias(name) for flat_name, name in _CALCULATED.items()], c("QueryLength").alias("query_ength"),
        F.lit(None).cast("int").alias("query_length"),
    )
    return flat.select(
        c("Timestamp").alias("timestamp"), c("TransactionID").alias("transaction_id"), c("ClientIP").alias("client_ip"),
        c("ClientPort").alias("client_port"), c("ServerIP").alias("server_ip"), c("ServerPort").alias("server_port"),
        request.alias("request"), response.alias("response"), processing.alias("waf_processing"),
        calculated.alias("calculated_fields"),
    )


def request_rows(nested: DataFrame) -> DataFrame:
    """The request table the operators read (req_id, ts, method, uri, path, query, protocol, headers, body, …)."""
    h = F.col("request.headers")
    one = lambda v: F.when(v.isNotNull(), F.array(v))
    named = F.map_filter(
        F.create_map(
            *[
                x
                for name, field in [
                    ("User-Agent", "user_agent"), ("Referer", "referer"), ("Accept-Encoding", "accept_encoding"),
                    ("Content-Type", "content_type"), ("Accept", "accept"), ("Cookie", "cookie"),
                    ("Connection", "connection"),
                ]
                for x in (F.lit(name), one(h[field]))
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    other = F.coalesce(h["other_headers"], F.expr("cast(map() as map<string, array<string>>)"))
    return nested.select(
        F.col("transaction_id").alias("req_id"),
        F.col("timestamp").alias("ts"),
        "client_ip",
        F.col("request.method").alias("method"),
        F.col("request.uri").alias("uri"),
        F.col("request.path").alias("path"),
        F.col("request.query").alias("query"),
        F.col("request.protocol").alias("protocol"),
        F.map_concat(named, other).alias("headers"),
        F.col("request.body").alias("body"),
        F.col("response.status_code").alias("status"),
        F.col("response.headers").alias("response_headers"),
        F.col("response.body").alias("response_body"),
        F.col("waf_processing.ai_verdict_label").alias("label"),
        F.col("waf_processing.ai_vulnerability_type_label").alias("attack_type"),
    )


def audit_records(requests: DataFrame) -> DataFrame:
    """Featurised request table as flat audit rows, with no scan result yet."""
    featured = X.featurise(requests)
    header = lambda name: F.array_join(X.header_values(F.col("headers"), name), ", ")
    known = {"User-Agent": "UserAgent", "Referer": "Referer", "Accept-Encoding": "AcceptEncoding",
             "Content-Type": "ContentType", "Accept": "Accept", "Cookie": "Cookie", "Connection": "Connection"}
    lowered = [k.lower() for k in known]
    rest = F.map_filter(F.col("headers"), lambda k, _: ~F.lower(k).isin(*lowered))
    columns = {
        "Timestamp": F.col("ts").cast("timestamp"), "TransactionID": F.col("req_id").cast("string"),
        "ClientIP": F.col("client_ip"), "RequestMethod": F.col("method"), "RequestURIPath": F.col("path"),
        "RequestURIQuery": F.col("query"), "RequestProtocol": F.col("protocol"),
        **{column: header(name) for name, column in known.items()},
        "OtherHeaders": flatten_headers(rest), "RequestBody": F.col("body"), "ResponseStatus": F.col("status"),
        "ResponseHeaders": flatten_headers(F.col("response_headers")), "ResponseBody": F.col("response_body"),
        "WAFInterrupted": F.lit(False), "InterruptionStatus": F.lit(0), "MatchedRulesCount": F.lit(0),
        "MatchedRulesIDs": F.lit(""), "MatchedRulesMessages": F.lit(""), "MatchedRulesTags": F.lit(""),
        "AIScore": F.lit(-1.0), "AIVerdict": F.lit("not evaluated"), "AIVerdictLabel": F.col("label"),
        "AIVulnerabilityTypeLabel": F.col("attack_type"),
    }
    return featured.select(
        *[
            columns.get(f.name, F.col(f.name) if f.name in X.FEATURES else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in AUDIT_FLAT.fields
        ]
    )
