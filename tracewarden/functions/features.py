"""Lexical and structural features of a request, one Column function each.

Lengths are bytes; character counts are code points. ``content`` is path + query + body.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as special.
SPECIAL_CHARS = "!@#$%^&*()_+{}[]|\\:;\"'<>,.?/~"

# The suspicious keywords. A keyword listed twice counts twice.
KEYWORDS = [
    "union", "select", "sleep", "script", "alert", "etc/passwd",
    "cmd.exe", "exec", "system", "wget", "nc", "rm -rf", "insert",
    "drop", "alter", "delete from", "xp_cmdshell", "benchmark", "sleep",
    "information_schema", "/etc/passwd", "file_get_contents", "passthru",
    "shell_exec", "system", "base64_decode", "php://filter", "data://",
    "input.php", "load_file", "outfile", "dumpfile", "load data",
    "into outfile", "into dumpfile", "union all", "union select",
    "cast(", "convert(", "declare @", "nchar(", "varchar(", "nvarchar(",
    "substring(", "mid(", "concat(", "char(", "chr(", "convert(", "cast(",
    "schema_name()", "table_name()", "column_name()", "database()", "version()",
    "user()", "current_user()", "session_user()", "system_user()", "@@version",
    "@@hostname", "load_file", "select pg_sleep", "select benchmark",
    "document.cookie", "window.location", "eval(", "prompt(", "confirm(",
    "alert(", "javascript:", "vbscript:", "<script>", "</script>", "<iframe>",
    "</iframe>", "<embed>", "</embed>", "<object>", "</object>", "<svg>",
    "</svg>", "<img src=x onerror=", "onload=", "onerror=", "onmouseover=",
    "onfocus=", "autofocus", "background-image:url(", "expression(",
    "xss", "cross-site scripting", "sql injection", "remote code execution",
    "local file inclusion", "remote file inclusion",
]

# Marks that keywords hold; each keyword goes by the first of them that it holds.
KEYWORD_MARKS = "<@(:_=.- /"

# Protocol versions taken as valid by the feature (the policy list is wider).
VALID_VERSIONS = ("HTTP/1.0", "HTTP/1.1", "HTTP/2.0")

BAD_ESCAPE = r"%(?![0-9a-fA-F]{2})"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bytes(c: Column) -> Column:
    return F.octet_length(_text(c))


def content(path: Column, query: Column, body: Column) -> Column:
    return F.concat(_text(path), _text(query), _text(body))


def header_values(headers: Column, name: str) -> Column:
    """All values of one header, its name compared without case; an empty array when absent."""
    hits = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.flatten(hits), F.array().cast("array<string>"))


def header(headers: Column, name: str) -> Column:
    """First value of a header or null."""
    return F.get(header_values(headers, name), F.lit(0))


def request_length(method: Column, uri: Column, protocol: Column, headers: Column, body: Column) -> Column:
    """Bytes of the request line, one ``name: value`` line per header value, a blank line and the body."""
    line = _bytes(method) + _bytes(uri) + _bytes(protocol) + 4
    per_header = F.transform(
        F.map_entries(headers),
        lambda e: F.aggregate(
            e["value"], F.lit(0), lambda total, v: total + F.octet_length(e["key"]) + F.octet_length(v) + 4
        ),
    )
    total = F.aggregate(per_header, F.lit(0), lambda a, b: a + b)
    return line + F.coalesce(total, F.lit(0)) + 2 + _bytes(body)


def path_length(path: Column) -> Column:
    return _bytes(path)


def query_length(query: Column) -> Column:
    return _bytes(query)


def body_length(body: Column) -> Column:
    return _bytes(body)


def form_pairs(text: Column) -> Column:
    """The non-empty ``&`` pieces of a query or form body; none when any piece is malformed."""
    text = _text(text)
    broken = text.contains(";") | text.rlike(BAD_ESCAPE)
    return F.when(broken, F.array().cast("array<string>")).otherwise(
        F.filter(F.split(text, "&", -1), lambda p: p != "")
    )


def _pair_value_bytes(pair: Column) -> Column:
    value = F.when(F.instr(pair, "=") > 0, F.regexp_replace(pair, r"(?s)^[^=]*=", "")).otherwise(F.lit(""))
    return F.octet_length(value) - 2 * F.regexp_count(value, F.lit("%[0-9a-fA-F]{2}"))


def _max_or_zero(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def is_json_body(body: Column) -> Column:
    """Exactly one JSON value of any kind, nothing after it.

    The body is wrapped once as an array and once as an object: text that closes one wrapper early breaks the other.
    """
    body = _text(body)
    looks = body.rlike(r'^\s*(?:[{\["]|-?[0-9]|true|false|null)') & F.rtrim(body).rlike(r'[}\]"0-9el\s]$')
    alone = (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1) & (
        F.size(F.json_object_keys(F.concat(F.lit('{"a":'), body, F.lit("}")))) == 1
    )
    keys = F.json_object_keys(body)
    strict = F.try_parse_json(body).isNotNull() | (F.size(keys) > F.size(F.array_distinct(keys)))
    return F.when(looks, F.coalesce(alone & strict, F.lit(False))).otherwise(F.lit(False))


def is_xml_body(body: Column) -> Column:
    body = _text(body)
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    marked = body.contains("<?xml") | body.contains("xmlns")
    return marked & trimmed.startswith("<") & trimmed.endswith(">")


def _json_members(body: Column) -> Column:
    """Members of a JSON object, the last one of a repeated name."""
    members = F.map_entries(F.from_json(body, "map<string,variant>"))
    names = F.reverse(F.transform(members, lambda m: m["key"]))
    return F.filter(
        members, lambda m, i: F.size(members) - F.array_position(names, m["key"]).cast("int") == i
    )


def _json_value_bytes(body: Column) -> Column:
    return F.transform(
        _json_members(body),
        lambda m: F.when(F.schema_of_variant(m["value"]) == "STRING", F.octet_length(m["value"].cast("string"))).otherwise(0),
    )


def _xml_texts(body: Column) -> Column:
    return F.regexp_extract_all(_text(body), F.lit(r">([^<]+)<"), F.lit(1))


def _is_form(content_type: Column) -> Column:
    return _text(content_type).contains("application/x-www-form-urlencoded")


def num_params(query: Column, body: Column, content_type: Column) -> Column:
    """Query pairs, plus form pairs of the body, plus top-level JSON names or XML texts."""
    count = F.size(form_pairs(query)) + F.when(_is_form(content_type), F.size(form_pairs(body))).otherwise(0)
    return count + F.when(
        is_json_body(body), F.coalesce(F.size(F.array_distinct(F.json_object_keys(body))), F.lit(0))
    ).when(is_xml_body(body), F.size(_xml_texts(body))).otherwise(0)


def longest_param_value(query: Column, body: Column, content_type: Column) -> Column:
    """Largest decoded value in bytes; only string values of a JSON body count."""
    query_max = _max_or_zero(F.transform(form_pairs(query), _pair_value_bytes))
    form_max = F.when(_is_form(content_type), _max_or_zero(F.transform(form_pairs(body), _pair_value_bytes))).otherwise(0)
    body_max = (
        F.when(is_json_body(body), _max_or_zero(_json_value_bytes(body)))
        .when(is_xml_body(body), _max_or_zero(F.transform(_xml_texts(body), F.octet_length)))
        .otherwise(0)
    )
    return F.greatest(query_max, form_max, body_max)


def num_special_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SPECIAL_CHARS, ""))


def num_encoded_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit("%[0-9a-fA-F]{2}"))


def num_double_encoded(text: Column) -> Column:
    return F.regexp_count(text, F.lit("%25[0-9a-fA-F]{2}"))


def special_ratio(text: Column) -> Column:
    ratio = num_special_chars(text) / F.octet_length(text)
    return F.when(F.octet_length(text) > 0, F.round(ratio, 4)).otherwise(F.lit(0.0))


def _mark_of(keyword: str) -> str | None:
    return next((mark for mark in KEYWORD_MARKS if mark in keyword), None)


def num_keywords(lowered: Column) -> Column:
    """Occurrences of every keyword in lower-cased text; the keyword list is a multiset."""

    def hits(keyword: str) -> Column:
        removed = F.replace(lowered, F.lit(keyword), F.lit(""))
        return ((F.octet_length(lowered) - F.octet_length(removed)) / len(keyword)).cast("int")

    repeated: dict[str, int] = {}
    for k in KEYWORDS:
        repeated[k] = repeated.get(k, 0) + 1
    counted = {k: F.when(F.contains(lowered, F.lit(k)), hits(k) * n).otherwise(0) for k, n in repeated.items()}
    # keywords with a mark are looked for in texts that hold the mark only
    gated = [([k for k in counted if _mark_of(k) == mark], mark) for mark in KEYWORD_MARKS]
    terms = [F.when(F.contains(lowered, F.lit(mark)), reduce(lambda a, b: a + b, [counted[k] for k in held])).otherwise(0) for held, mark in gated if held]
    return reduce(lambda a, b: a + b, [*terms, *(counted[k] for k in counted if _mark_of(k) is None)])


def num_unique_chars(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def is_multipart_form(content_type: Column) -> Column:
    return _text(content_type).startswith("multipart/form-data")


def has_numeric_segment(path: Column) -> Column:
    return _text(path).rlike(r"(?:^|/)[0-9]+(?:/|$)")


def path_depth(path: Column) -> Column:
    path = _text(path)
    inner = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(path.isin("", "/"), 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit("/"))) + 1)


def uses_base64(text: Column) -> Column:
    """Byte length divisible by four and valid UTF-8; the pattern test of the original always holds."""
    return (F.octet_length(text) % 4 == 0) & F.is_valid_utf8(text)


def uses_hex(text: Column) -> Column:
    return text.rlike(r"%[0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}")


def multiple_content_length(headers: Column) -> Column:
    return F.size(header_values(headers, "Content-Length")) > 1


def invalid_http_version(protocol: Column) -> Column:
    return ~F.coalesce(protocol.isin(*VALID_VERSIONS), F.lit(False))


def num_headers(headers: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(headers)), F.lit(0))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def _feature_columns(text: Column, lowered: Column, ctype: Column) -> dict:
    c = F.col
    return {
        "RequestLength": lambda: request_length(c("method"), c("uri"), c("protocol"), c("headers"), c("body")),
        "PathLength": lambda: path_length(c("path")),
        "QueryLength": lambda: query_length(c("query")),
        "BodyLength": lambda: body_length(c("body")),
        "NumParams": lambda: num_params(c("query"), c("body"), ctype),
        "LongestParamValueLength": lambda: longest_param_value(c("query"), c("body"), ctype),
        "NumSpecialChars": lambda: num_special_chars(text),
        "NumEncodedChars": lambda: num_encoded_chars(text),
        "NumDoubleEncodedChars": lambda: num_double_encoded(text),
        "RatioSpecialCharsToTotalChars": lambda: special_ratio(text),
        "NumKeywords": lambda: num_keywords(lowered),
        "NumUniqueChars": lambda: num_unique_chars(text),
        "IsJSONBody": lambda: is_json_body(c("body")),
        "IsXMLBody": lambda: is_xml_body(c("body")),
        "IsMultipartForm": lambda: is_multipart_form(ctype),
        "HasNumericPathSegment": lambda: has_numeric_segment(c("path")),
        "DepthOfPath": lambda: path_depth(c("path")),
        "UsesBase64Encoding": lambda: uses_base64(text),
        "UsesHexEncoding": lambda: uses_hex(text),
        "HasMultipleContentLength": lambda: multiple_content_length(c("headers")),
        "InvalidHTTPVersion": lambda: invalid_http_version(c("protocol")),
        "NumHTTPHeaders": lambda: num_headers(c("headers")),
        "TimeOfDayHour": lambda: hour_of_day(c("ts")),
        "TimeOfDayDayOfWeek": lambda: day_of_week(c("ts")),
    }


FEATURES = list(_feature_columns(None, None, None))


@cache
def _feature(name: str) -> Column:
    """Expression of one feature over the shared columns; it does not depend on a session, so it is built once."""
    return _feature_columns(F.col("__content"), F.col("__lower"), F.col("__type"))[name]()


def featurise(df, only: list[str] | None = None):
    """Add the 24 features (or those named) to a request table.

    Reads method, uri, path, query, protocol, headers, body, ts. Three narrow projections and no shuffle: the content,
    then what several features share (its lower case, the content type), then the features. Each shared value is built
    once per row.
    """
    shared = df.withColumn("__content", content(F.col("path"), F.col("query"), F.col("body"))).withColumns(
        {"__lower": F.lower("__content"), "__type": header(F.col("headers"), "Content-Type")}
    )
    return shared.withColumns({n: _feature(n) for n in only or FEATURES}).drop("__content", "__lower", "__type")
