"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The flat audit row, in file order.
_FLAT = (
    ("Timestamp", "timestamp"),
    ("TransactionID", "string"),
    ("ClientIP", "string"),
    ("ClientPort", "int"),
    ("ServerIP", "string"),
    ("ServerPort", "int"),
    ("RequestMethod", "string"),
    ("RequestURIPath", "string"),
    ("RequestURIQuery", "string"),
    ("RequestProtocol", "string"),
    ("UserAgent", "string"),
    ("Referer", "string"),
    ("AcceptEncoding", "string"),
    ("ContentType", "string"),
    ("Accept", "string"),
    ("Cookie", "string"),
    ("Connection", "string"),
    ("OtherHeaders", "string"),
    ("RequestBody", "string"),
    ("ResponseStatus", "int"),
    ("ResponseProtocol", "string"),
    ("ResponseHeaders", "string"),
    ("ResponseBody", "string"),
    ("WAFInterrupted", "boolean"),
    ("InterruptionRuleID", "string"),
    ("InterruptionStatus", "int"),
    ("InterruptionAction", "string"),
    ("MatchedRulesCount", "int"),
    ("MatchedRulesIDs", "string"),
    ("MatchedRulesMessages", "string"),
    ("MatchedRulesTags", "string"),
    ("AIScore", "double"),
    ("AIVerdict", "string"),
    ("AIVerdictLabel", "string"),
    ("AIVulnerabilityTypeLabel", "string"),
    ("RequestLength", "int"),
    ("PathLength", "int"),
    ("QueryLength", "int"),
    ("BodyLength", "int"),
    ("NumParams", "int"),
    ("LongestParamValueLength", "int"),
    ("NumSpecialChars", "int"),
    ("NumEncodedChars", "int"),
    ("NumDoubleEncodedChars", "int"),
    ("RatioSpecialCharsToTotalChars", "double"),
    ("NumKeywords", "int"),
    ("NumUniqueChars", "int"),
    ("IsJSONBody", "boolean"),
    ("IsXMLBody", "boolean"),
    ("IsMultipartForm", "boolean"),
    ("HasNumericPathSegment", "boolean"),
    ("DepthOfPath", "int"),
    ("UsesBase64Encoding", "boolean"),
    ("UsesHexEncoding", "boolean"),
    ("HasMultipleContentLength", "boolean"),
    ("InvalidHTTPVersion", "boolean"),
    ("NumHTTPHeaders", "int"),
    ("TimeOfDayHour", "int"),
    ("TimeOfDayDayOfWeek", "string"),
)
_KINDS = {
    "timestamp": T.TimestampType(), "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
}


def _columns(*specs: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in specs])


AUDIT_FLAT = _columns(*_FLAT)
FLAT_COLUMNS = AUDIT_FLAT.fieldNames()

_HEADERS = (
    "user_agent: string, referer: string, accept_encoding: string, content_type: string, accept: string,"
    "cookie: string, connection: string, other_headers: map<string, array<string>>"
)
_CALCULATED = (
    "request_length: int, path_length: int, query_ength: int, query_length: int, body_length: int, num_params: int,"
    "longest_param_value_length: int, num_special_chars: int, num_encoded_chars: int, num_double_encoded_chars: int,"
    "ratio_special_chars_to_total_chars: double, num_keywords: int, num_unique_chars: int, is_json_body: boolean,"
    "is_xml_body: boolean, is_multipart_form: boolean, has_numeric_path_segment: boolean, depth_of_path: int,"
    "uses_base64_encoding: boolean, uses_hex_encoding: boolean, has_multiple_content_length: boolean,"
    "invalid_http_version: boolean, num_http_headers: int, time_of_day_hour: int, time_of_day_day_of_week: string"
)
# ``query_ength`` is the spelling found in the logs; both spellings are read.
AUDIT_NESTED = (
    "timestamp timestamp, transaction_id string, client_ip string, client_port int, server_ip string, server_port int,"
    f"request struct<method: string, uri: string, path: string, query: string, protocol: string, headers: struct<{_HEADERS}>, body: string>,"
    "response struct<status_code: int, protocol: string, headers: map<string, array<string>>, body: string>,"
    "waf_processing struct<interrupted: boolean, interruption_details: struct<rule_id: string, status: int, action: string>,"
    "matched_rules: array<struct<rule_id: string, message: string, tags: array<string>>>, ai_score: double,"
    "ai_verdict: string, ai_verdict_label: string, ai_vulnerability_type_label: string>,"
    f"calculated_fields struct<{_CALCULATED}>"
)

RULES = (
    "rule_id int, family string, phase int, pl int, chain_id int, chain_link int, chain_len int,"
    "collections array<string>, name_filter string, excluded array<struct<collection: string, name: string>>,"
    "is_count boolean, operator string, negate boolean, argument string, transforms array<string>,"
    "multi_match boolean, capture boolean, severity string, score_var string, direction string, tags array<string>,"
    "msg string, ver string"
)
PHRASES = "list_name string, phrase string"
EXCLUSIONS = "scope string, rule_id int, tag string, collection string, name string"
CASES = (
    "rule_id int, test_id int, stage int, desc string, method string, uri string, version string,"
    "headers map<string, string>, data string, expect_ids array<int>, no_expect_ids array<int>, expect_status int"
)

# Percentile columns of a traffic report.
PERCENTILES = {
    "50%": 0.5, "66%": 0.66, "75%": 0.75, "80%": 0.8, "90%": 0.9, "95%": 0.95, "98%": 0.98, "99%": 0.99,
    "99.9%": 0.999, "99.99%": 0.9999, "100%": 1.0,
}


TRAFFIC_STATS = _columns(
    ("Type", "string"), ("Name", "string"), ("Request Count", "bigint"), ("Failure Count", "bigint"),
    ("Median Response Time", "double"), ("Average Response Time", "double"), ("Min Response Time", "double"),
    ("Max Response Time", "double"), ("Average Content Size", "double"), ("Requests/s", "double"),
    ("Failures/s", "double"), *((p, "double") for p in PERCENTILES),
)
TRAFFIC_HISTORY = _columns(
    ("Timestamp", "bigint"), ("User Count", "bigint"), ("Type", "string"), ("Name", "string"),
    ("Requests/s", "double"), ("Failures/s", "double"), *((p, "double") for p in PERCENTILES),
    ("Total Request Count", "bigint"), ("Total Failure Count", "bigint"), ("Total Median Response Time", "double"),
    ("Total Average Response Time", "double"), ("Total Min Response Time", "double"),
    ("Total Max Response Time", "double"), ("Total Average Content Size", "double"),
)
TRAFFIC_FAILURES = _columns(("Method", "string"), ("Name", "string"), ("Error", "string"), ("Occurrences", "bigint"))
