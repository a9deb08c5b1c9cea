"""Request features and request projections, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import features as X
from tracewarden.operators import requests as R
from tracewarden.plans import views
from tracewarden.plans.registry import register

_C = F.col
_TEXT = "concat(path, query, body)"
_SPECIAL = X.SPECIAL_CHARS.replace("'", "''")
_HEADERS = (
    "host user_agent referer accept accept_encoding content_type cookie connection transfer_encoding range_header method_override"
).split()
_NAMES = (
    "Host User-Agent Referer Accept Accept-Encoding Content-Type Cookie Connection Transfer-Encoding Range X-HTTP-Method-Override"
).split()


def _sql_pairs(text: str) -> str:
    """Non-empty pieces of a form text; none when it holds a semicolon or a broken escape."""
    rest = f"regexp_replace({text}, '%[0-9a-fA-F][0-9a-fA-F]', '', 'g')"
    return (
        f"CASE WHEN {text} LIKE '%;%' OR contains({rest}, '%') THEN [] "
        f"ELSE list_filter(string_split({text}, '&'), lambda p: p <> '') END"
    )


def _sql_value_bytes(pairs: str) -> str:
    value = "CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END"
    return (
        f"coalesce(list_max(list_transform({pairs}, "
        f"lambda p: strlen({value}) - 2 * len(regexp_extract_all({value}, '%[0-9a-fA-F]{{2}}')))), 0)"
    )


_IS_JSON = "(json_valid(body) AND body <> '')"
_IS_XML = "(starts_with(trim(body), '<') AND ends_with(trim(body), '>') AND (contains(body, '<?xml') OR contains(body, 'xmlns')))"
_IS_FORM = "coalesce(contains(content_type, 'application/x-www-form-urlencoded'), false)"
_XML_TEXTS = "regexp_extract_all(body, '>([^<]+)<', 1)"
_JSON_STRINGS = (
    "CASE WHEN json_type(body) = 'OBJECT' THEN list_transform(list_filter(json_keys(body), "
    "lambda n: json_type(body, concat('$.\"', n, '\"')) = 'VARCHAR'), "
    "lambda n: strlen(json_extract_string(body, concat('$.\"', n, '\"')))) ELSE [] END"
)
_HEADER_BYTES = " + ".join(
    f"coalesce({len(n)} + strlen({c}) + 4, 0)" for n, c in zip(_NAMES, _HEADERS)
) + " + coalesce(14 + strlen(content_length) + 4, 0) + coalesce(14 + strlen(content_length_2) + 4, 0)"
_URI_BYTES = "(strlen(path) + CASE WHEN query = '' THEN 0 ELSE 1 + strlen(query) END)"
_KEYWORD_SUM = " + ".join(
    f"(strlen(low) - strlen(replace(low, '{k}', ''))) // {len(k)}" for k in X.KEYWORDS
)
_HEADER_COUNT = " + ".join(f"({c} IS NOT NULL)::INT" for c in _HEADERS) + (
    " + (content_length IS NOT NULL OR content_length_2 IS NOT NULL)::INT"
)

# feature -> (inventory id, check SQL over the requests view, SQL type)
FEATURE_SQL = {
    "RequestLength": ("c01", f"strlen(method) + {_URI_BYTES} + strlen(protocol) + 4 + {_HEADER_BYTES} + 2 + strlen(body)", "BIGINT"),
    "PathLength": ("c02", "strlen(path)", "BIGINT"),
    "QueryLength": ("c03", "strlen(query)", "BIGINT"),
    "BodyLength": ("c04", "strlen(body)", "BIGINT"),
    "NumParams": (
        "c05",
        f"len({_sql_pairs('query')}) + CASE WHEN {_IS_FORM} THEN len({_sql_pairs('body')}) ELSE 0 END"
        f" + CASE WHEN {_IS_JSON} THEN coalesce(len(json_keys(body)), 0) WHEN {_IS_XML} THEN len({_XML_TEXTS}) ELSE 0 END",
        "BIGINT",
    ),
    "LongestParamValueLength": (
        "c06",
        f"greatest({_sql_value_bytes(_sql_pairs('query'))}, CASE WHEN {_IS_FORM} THEN {_sql_value_bytes(_sql_pairs('body'))} ELSE 0 END,"
        f" CASE WHEN {_IS_JSON} THEN coalesce(list_max({_JSON_STRINGS}), 0)"
        f" WHEN {_IS_XML} THEN coalesce(list_max(list_transform({_XML_TEXTS}, lambda t: strlen(t))), 0) ELSE 0 END)",
        "BIGINT",
    ),
    "NumSpecialChars": ("c07", f"length({_TEXT}) - length(translate({_TEXT}, '{_SPECIAL}', ''))", "BIGINT"),
    "NumEncodedChars": ("c08", f"len(regexp_extract_all({_TEXT}, '%[0-9a-fA-F]{{2}}'))", "BIGINT"),
    "NumDoubleEncodedChars": ("c09", f"len(regexp_extract_all({_TEXT}, '%25[0-9a-fA-F]{{2}}'))", "BIGINT"),
    "RatioSpecialCharsToTotalChars": (
        "c10",
        f"CASE WHEN strlen({_TEXT}) = 0 THEN 0 ELSE round((length({_TEXT}) - length(translate({_TEXT}, '{_SPECIAL}', '')))::DOUBLE / strlen({_TEXT}), 4) END",
        "DOUBLE",
    ),
    "NumKeywords": ("c11", _KEYWORD_SUM, "BIGINT"),
    "NumUniqueChars": ("c12", f"len(list_distinct(list_filter(string_split({_TEXT}, ''), lambda ch: ch <> '')))", "BIGINT"),
    "IsJSONBody": ("c13", _IS_JSON, "BOOLEAN"),
    "IsXMLBody": ("c14", _IS_XML, "BOOLEAN"),
    "IsMultipartForm": ("c15", "coalesce(starts_with(content_type, 'multipart/form-data'), false)", "BOOLEAN"),
    "HasNumericPathSegment": ("c16", "regexp_matches(path, '(^|/)[0-9]+(/|$)')", "BOOLEAN"),
    "DepthOfPath": (
        "c17",
        "CASE WHEN path IN ('', '/') THEN 0 ELSE length(trim(path, '/')) - length(replace(trim(path, '/'), '/', '')) + 1 END",
        "BIGINT",
    ),
    "UsesBase64Encoding": ("c18", f"strlen({_TEXT}) % 4 = 0", "BOOLEAN"),
    "UsesHexEncoding": ("c19", f"regexp_matches({_TEXT}, '%[0-9a-fA-F]{{2}}|\\\\x[0-9a-fA-F]{{2}}')", "BOOLEAN"),
    "HasMultipleContentLength": ("c20", "content_length IS NOT NULL AND content_length_2 IS NOT NULL", "BOOLEAN"),
    "InvalidHTTPVersion": ("c21", "protocol NOT IN ('HTTP/1.0', 'HTTP/1.1', 'HTTP/2.0')", "BOOLEAN"),
    "NumHTTPHeaders": ("c22", _HEADER_COUNT, "BIGINT"),
    "TimeOfDayHour": ("c23", "hour(ts)", "BIGINT"),
    "TimeOfDayDayOfWeek": ("c24", "dayname(ts)", "VARCHAR"),
}

_SPARK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string"}


def _typed(name: str):
    return F.col(name).cast(_SPARK_TYPES[FEATURE_SQL[name][2]]).alias(name)


def _feature_query(name: str):
    ident, sql, sql_type = FEATURE_SQL[name]
    oracle = (
        views.cte("requests")
        + f"SELECT req_id, CAST({sql} AS {sql_type}) AS {name} FROM (SELECT *, lower({_TEXT}) AS low FROM requests) r"
    )

    @register(f"{ident}_{_snake(name)}", oracle)
    def query(spark, sf_dir) -> DataFrame:
        return X.featurise(views.requests(spark, sf_dir), [name]).select("req_id", _typed(name))


def _snake(name: str) -> str:
    out = "".join(f"_{ch.lower()}" if ch.isupper() and i and not name[i - 1].isupper() else ch.lower() for i, ch in enumerate(name))
    return out


for _name in FEATURE_SQL:
    _feature_query(_name)

_ALL_SQL = ", ".join(f"CAST({sql} AS {t}) AS {n}" for n, (_, sql, t) in FEATURE_SQL.items())
FEATURE_CTE = views.cte("requests") + (
    f", featured AS (SELECT req_id, ts, host, method, path, status, label, attack_type, {_ALL_SQL}"
    f" FROM (SELECT *, lower({_TEXT}) AS low FROM requests) r)\n"
)


@register("c25_featurise_requests", FEATURE_CTE + f"SELECT req_id, {', '.join(FEATURE_SQL)} FROM featured")
def featurise_requests(spark, sf_dir):
    return X.featurise(views.requests(spark, sf_dir)).select("req_id", *map(_typed, FEATURE_SQL))


_DOC_SQL = (
    views.cte("bodies")
    + f"""SELECT req_id, CAST(length(t) - length(translate(t, '{_SPECIAL}', '')) AS BIGINT) AS num_special,
  CAST(len(list_distinct(list_filter(string_split(t, ''), lambda ch: ch <> ''))) AS BIGINT) AS num_unique,
  CAST({_KEYWORD_SUM} AS BIGINT) AS num_keywords, CAST(strlen(body) AS BIGINT) AS body_length, {_IS_JSON} AS is_json,
  CAST(len(regexp_extract_all(t, '%[0-9a-fA-F]{{2}}')) AS BIGINT) AS num_encoded
FROM (SELECT *, {_TEXT} AS t, lower({_TEXT}) AS low FROM bodies) b"""
)


@register("c25_featurise_long_bodies", _DOC_SQL)
def featurise_long_bodies(spark, sf_dir):
    rows = views.spread(views.view(spark, sf_dir, "bodies"))
    text = rows.withColumn("t", X.content(_C("path"), _C("query"), _C("body"))).withColumn("low", F.lower("t"))
    return text.select(
        "req_id",
        X.num_special_chars(_C("t")).cast("long").alias("num_special"),
        X.num_unique_chars(_C("t")).cast("long").alias("num_unique"),
        X.num_keywords(_C("low")).cast("long").alias("num_keywords"),
        X.body_length(_C("body")).cast("long").alias("body_length"),
        X.is_json_body(_C("body")).alias("is_json"),
        X.num_encoded_chars(_C("t")).cast("long").alias("num_encoded"),
    )


@register(
    "flagship_host_profile",
    FEATURE_CTE
    + """SELECT coalesce(host, '') AS host, DepthOfPath AS path_depth, CAST(count(*) AS BIGINT) AS requests,
  CAST(sum(CAST(RatioSpecialCharsToTotalChars AS DECIMAL(10,4))) AS DOUBLE) / count(RatioSpecialCharsToTotalChars) AS avg_special_ratio, CAST(max(NumParams) AS BIGINT) AS max_params,
  CAST(sum(NumKeywords) AS BIGINT) AS keywords, CAST(max(RequestLength) AS BIGINT) AS max_length
FROM featured GROUP BY 1, 2""",
)
def flagship_host_profile(spark, sf_dir):
    used = ["DepthOfPath", "RatioSpecialCharsToTotalChars", "NumParams", "NumKeywords", "RequestLength"]
    rows = X.featurise(views.requests(spark, sf_dir), used)
    return rows.groupBy(
        F.coalesce(X.header(_C("headers"), "Host"), F.lit("")).alias("host"), _typed("DepthOfPath").alias("path_depth")
    ).agg(
        F.count("*").alias("requests"),
        # the ratio has four places: a decimal sum does not depend on the order of the rows
        (F.sum(_C("RatioSpecialCharsToTotalChars").cast("decimal(10,4)")).cast("double") / F.count("RatioSpecialCharsToTotalChars")).alias("avg_special_ratio"),
        F.max("NumParams").cast("long").alias("max_params"),
        F.sum("NumKeywords").cast("long").alias("keywords"),
        F.max("RequestLength").cast("long").alias("max_length"),
    )


@register(
    "r1_split_uri",
    views.cte("page_views")
    + """SELECT req_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query
FROM page_views""",
)
def r1_split_uri(spark, sf_dir):
    rows = views.view(spark, sf_dir, "page_views")
    return R.split_uri(rows, "url").select("req_id", R.uri_host(_C("url")).alias("host"), "path", "query")


@register(
    "r2_categorise_headers",
    views.cte("requests")
    + """SELECT req_id, coalesce(user_agent, '') AS UserAgent, coalesce(referer, '') AS Referer,
  coalesce(accept_encoding, '') AS AcceptEncoding, coalesce(content_type, '') AS ContentType, coalesce(accept, '') AS Accept,
  coalesce(cookie, '') AS Cookie, coalesce(connection, '') AS Connection,
  CAST((host IS NOT NULL)::INT + (content_length IS NOT NULL OR content_length_2 IS NOT NULL)::INT + (transfer_encoding IS NOT NULL)::INT
   + (range_header IS NOT NULL)::INT + (method_override IS NOT NULL)::INT AS BIGINT) AS other_count FROM requests""",
)
def r2_categorise_headers(spark, sf_dir):
    return R.categorise_headers(views.requests(spark, sf_dir)).select(
        "req_id", *R.NAMED_HEADERS.values(), F.size("other_headers").cast("long").alias("other_count")
    )


@register(
    "r3_flatten_headers",
    views.cte("requests")
    + """SELECT req_id, array_to_string(list_filter([
  CASE WHEN content_length IS NOT NULL AND content_length_2 IS NOT NULL THEN concat('Content-Length:', content_length, ',', content_length_2)
       WHEN content_length IS NOT NULL THEN concat('Content-Length:', content_length)
       WHEN content_length_2 IS NOT NULL THEN concat('Content-Length:', content_length_2) END,
  'Host:' || host, 'Range:' || range_header, 'Transfer-Encoding:' || transfer_encoding,
  'X-HTTP-Method-Override:' || method_override], lambda x: x IS NOT NULL), '; ') AS flat FROM requests""",
)
def r3_flatten_headers(spark, sf_dir):
    rows = R.categorise_headers(views.requests(spark, sf_dir))
    return rows.select("req_id", R.flatten_headers(_C("other_headers")).alias("flat"))


@register(
    "r4_split_host_port",
    views.cte("requests")
    + """SELECT req_id, coalesce(split_part(host, ':', 1), '') AS server_ip,
  CAST(CASE WHEN contains(host, ':') THEN split_part(host, ':', 2) ELSE '80' END AS BIGINT) AS server_port FROM requests""",
)
def r4_split_host_port(spark, sf_dir):
    rows = views.requests(spark, sf_dir).withColumn("address", F.coalesce(X.header(_C("headers"), "Host"), F.lit("")))
    return R.split_host_port(rows, "address", "server_ip", "server_port").select(
        "req_id", "server_ip", _C("server_port").cast("long")
    )


@register(
    "r5_stamp_labels",
    views.cte("requests")
    + "SELECT req_id, method, 'malicious' AS AIVerdictLabel, 'enum' AS AIVulnerabilityTypeLabel FROM requests",
)
def r5_stamp_labels(spark, sf_dir):
    return R.stamp_labels(views.requests(spark, sf_dir).select("req_id", "method"), "malicious", "enum")


@register(
    "r6_explode_matched_rules",
    """WITH a AS (SELECT doc_id, string_split(replace(text, ';', ','), ' ') AS words FROM documents WHERE text <> ''),
b AS (SELECT doc_id, unnest(words) AS rule_id, unnest(list_transform(words, lambda w: md5(w))) AS message,
  unnest(range(len(words))) AS pos FROM a)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, rule_id, message FROM b""",
)
def r6_explode_matched_rules(spark, sf_dir):
    words = F.split(F.replace("text", F.lit(";"), F.lit(",")), " ")
    flat = views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(words, ";").alias("MatchedRulesIDs"),
        F.array_join(F.transform(words, F.md5), ";").alias("MatchedRulesMessages"),
    )
    return R.explode_matched_rules(flat, "doc_id").withColumn("pos", _C("pos").cast("long"))


_REPORT = (
    "concat('Anomaly Scores: (Inbound Scores: blocking=', {a}, ', detection=', {b}, ', per_pl=', {a}, '-', {c}, '-0-1, threshold=5)"
    " - (Outbound Scores: blocking=', {c}, ', detection=', {c}, ', per_pl=0-', {a}, '-2-', {b}, ', threshold=4)"
    " - (SQLI=', {a}, ', XSS=', {b}, ', RFI=0, LFI=1, RCE=', {c}, ', PHPI=0, HTTP=3, SESS=', {a}, ', COMBINED_SCORE=', {b}, ')')"
)


@register(
    "r8_parse_score_message",
    """SELECT event_id, CAST(user_id AS INT) AS inbound_blocking, CAST(event_id % 77 AS INT) AS inbound_detection,
  CAST(user_id AS INT) AS inbound_pl1, CAST(user_id % 9 AS INT) AS inbound_pl2, CAST(0 AS INT) AS inbound_pl3, CAST(1 AS INT) AS inbound_pl4,
  CAST(5 AS INT) AS inbound_threshold, CAST(user_id % 9 AS INT) AS outbound_blocking, CAST(user_id % 9 AS INT) AS outbound_detection,
  CAST(0 AS INT) AS outbound_pl1, CAST(user_id AS INT) AS outbound_pl2, CAST(2 AS INT) AS outbound_pl3, CAST(event_id % 77 AS INT) AS outbound_pl4,
  CAST(4 AS INT) AS outbound_threshold, CAST(user_id AS INT) AS sql_injection_score, CAST(event_id % 77 AS INT) AS xss_score,
  CAST(0 AS INT) AS rfi_score, CAST(1 AS INT) AS lfi_score, CAST(user_id % 9 AS INT) AS rce_score, CAST(0 AS INT) AS php_injection_score,
  CAST(3 AS INT) AS http_violation_score, CAST(user_id AS INT) AS session_fixation_score, CAST(event_id % 77 AS INT) AS combined_score
FROM events""",
)
def r8_parse_score_message(spark, sf_dir):
    line = _REPORT.format(a="user_id", b="event_id % 77", c="user_id % 9")
    events = views.table(spark, sf_dir, "events").select("event_id", F.expr(line).alias("msg"))
    return R.parse_score_message(events, "msg").drop("msg")
