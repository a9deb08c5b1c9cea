"""Normalisation steps, match predicates, encoders and robustness, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import encoders as G
from tracewarden.functions import transforms as N
from tracewarden.functions.predicates import capture, match
from tracewarden.operators.augment import augment, robustness_report
from tracewarden.operators.scan import rule_scan
from tracewarden.operators.targets import explode_targets, normalise_targets
from tracewarden.plans import rule_pack, views
from tracewarden.plans.registry import register
from tracewarden.plans.scan_queries import TARGET_CTE

_C = F.col
_DIALOG = views.cte("dialog")


def _dialog(spark, sf_dir):
    return views.spread(views.view(spark, sf_dir, "dialog"))


def _step(name: str, chain: list[str], written, sql: str, source: str = "text") -> None:
    """A step applied to ``written`` (a text in its encoded spelling) must give what ``sql`` says."""

    @register(name, _DIALOG + f"SELECT row_id, {sql} AS normalised FROM dialog")
    def query(spark, sf_dir):
        rows = _dialog(spark, sf_dir).withColumn("value", written(_C(source)))
        return normalise_targets(rows, chain).select("row_id", "normalised")


_HEX = lambda t: F.hex(F.encode(t, "UTF-8"))
_QUOTES = "concat(text, ' /* note ', text, ' */ -- x # y /* open')"
_NOTED = lambda t: F.concat(t, F.lit(" /* note "), t, F.lit(" */ -- x # y /* open"))
_BLANK = "[ \\t\\n\\r\\f\\v\\x{a0}]+"

_step("n01_none", ["lowercase", "none"], lambda t: t, "text")
_step("n02_url_decode_uni", ["urlDecodeUni"], F.url_encode, "text")
_step("n03_lowercase", ["lowercase"], lambda t: t, "lower(text)")
_step("n04_html_entity_decode", ["htmlEntityDecode"], G.html_entity_encode, "text")
_step("n05_js_decode", ["jsDecode"], lambda t: F.regexp_replace(_HEX(t), "(..)", r"\\x$1"), "text")
_step("n06_css_decode", ["cssDecode"], lambda t: F.regexp_replace(_HEX(t), "(..)", r"\\$1 "), "text")
_step(
    "n07_utf8_to_unicode",
    ["utf8toUnicode"],
    lambda t: t,
    "array_to_string(list_transform(string_split(text, ''), lambda ch: CASE WHEN unicode(ch) > 127 THEN concat('%u', lpad(lower(to_hex(unicode(ch))), 4, '0')) ELSE ch END), '')",
)
_step("n08_escape_seq_decode", ["escapeSeqDecode"], lambda t: F.regexp_replace(_HEX(t), "(..)", r"\\x$1"), "text")
_step("n09_remove_nulls", ["removeNulls"], lambda t: F.replace(t, F.lit(" "), F.lit("\x00 \x00")), "text")
_step(
    "n10_cmd_line",
    ["cmdLine"],
    lambda t: F.replace(F.concat(t, F.lit(" ; 'LS'  /tmp (x")), F.lit("e"), F.lit("^e")),
    "lower(regexp_replace(regexp_replace(regexp_replace(replace(concat(text, ' ; ''LS''  /tmp (x'), 'e', '^e'), '[\\\\\"''^]', '', 'g'), '[ \\t\\n\\r,;]+', ' ', 'g'), ' +([/(])', '\\1', 'g'))",
)
_step("n11_replace_comments", ["replaceComments"], _NOTED, f"regexp_replace({_QUOTES}, '(?s)/\\*.*?(?:\\*/|\\z)', ' ', 'g')")
_step("n11_remove_comments_char", ["removeCommentsChar"], _NOTED, f"regexp_replace({_QUOTES}, '/\\*|\\*/|--|#', '', 'g')")
_step("n12_remove_whitespace", ["removeWhitespace"], lambda t: t, f"regexp_replace(text, '{_BLANK}', '', 'g')")
_step("n12_compress_whitespace", ["compressWhitespace"], lambda t: F.replace(t, F.lit(" "), F.lit(" \t ")), f"regexp_replace(text, '{_BLANK}', ' ', 'g')")
_step("n14_length", ["length"], lambda t: t, "CAST(strlen(text) AS VARCHAR)")
_step("n15_base64_decode", ["base64Decode"], lambda t: F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"\s+", ""), "text")
_step("n16_sha1_hex_encode", ["sha1", "hexEncode"], lambda t: t, "sha1(text)")


@register(
    "n13_normalize_path",
    "SELECT doc_id, concat('/', lang, '/', source, '/') AS rooted, concat(lang, '/', source) AS relative, concat('../', lang) AS above FROM documents",
)
def n13(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    rooted = F.concat_ws("", F.lit("/./"), "lang", F.lit("//x/../"), "source", F.lit("/./"))
    relative = F.concat_ws("", F.lit("a\\..\\"), "lang", F.lit("\\.\\"), "source")
    above = F.concat_ws("", F.lit("a/../../"), "lang")
    return docs.select(
        "doc_id",
        N.normalize_path(rooted).alias("rooted"),
        N.normalize_path_win(relative).alias("relative"),
        N.normalize_path(above).alias("above"),
    )


# ---- predicates ---------------------------------------------------------------------------------------------------


def _predicate(name: str, collection: str, operator: str, argument: str, sql: str, negate: bool = False) -> None:
    oracle = TARGET_CTE + f"SELECT req_id, name, value FROM targets WHERE collection = '{collection}' AND ({sql})"

    @register(name, oracle)
    def query(spark, sf_dir):
        targets = explode_targets(views.requests(spark, sf_dir), [collection])
        hit = match(operator, _C("value"), argument, negate, rule_pack.PHRASE_LISTS)
        return targets.filter(hit).select("req_id", "name", "value")


_predicate("m01_rx", "ARGS", "rx", r"(?i)<[a-z]+[^>]*on[a-z]+=", "regexp_matches(value, '(?i)<[a-z]+[^>]*on[a-z]+=')")
_predicate("m01_not_rx", "REQUEST_URI", "rx", "^/api/", "NOT regexp_matches(value, '^/api/')", True)
_predicate("m02_pm", "ARGS", "pm", "UNION script passwd", "regexp_matches(lower(value), 'union|script|passwd')")
_predicate("m03_pm_from_file", "REQUEST_HEADERS", "pmFromFile", "scanner-agents", "regexp_matches(lower(value), 'sqlmap|nikto|masscan|wpscan|dirbuster|acunetix')")
_predicate("m04_not_within", "REQUEST_METHOD", "within", "GET HEAD POST", "NOT contains('GET HEAD POST', value)", True)
_predicate("m05_streq", "REQUEST_METHOD", "streq", "PUT", "value = 'PUT'")
_predicate("m06_contains", "REQUEST_URI", "contains", "/click/", "contains(value, '/click/')")
_predicate("m07_ends_with", "REQUEST_FILENAME", "endsWith", ".bak", "ends_with(value, '.bak')")
_predicate("m08_gt", "ARGS", "gt", "50", "coalesce(TRY_CAST(CASE WHEN regexp_matches(value, '^[0-9]+$') THEN value END AS BIGINT), 0) > 50")
_predicate("m08_lt", "RESPONSE_STATUS", "lt", "400", "CAST(value AS BIGINT) < 400")
_predicate("m08_ge", "RESPONSE_STATUS", "ge", "403", "CAST(value AS BIGINT) >= 403")
_predicate("m08_not_eq", "RESPONSE_STATUS", "eq", "200", "CAST(value AS BIGINT) <> 200", True)
_predicate("m10_validate_byte_range", "ARGS", "validateByteRange", "32-59,61,63-126", "regexp_matches(value, '[^ -;=?-~]')")
_predicate("m11_validate_url_encoding", "QUERY_STRING", "validateUrlEncoding", "", "contains(regexp_replace(value, '%[0-9a-fA-F][0-9a-fA-F]', '', 'g'), '%')")
_predicate(
    "m13_ip_match", "REMOTE_ADDR", "ipMatch", "10.0.0.0/10,10.150.0.1,::1",
    "CAST(split_part(value, '.', 1) AS INT) = 10 AND CAST(split_part(value, '.', 2) AS INT) < 64 OR value = '10.150.0.1'",
)
_predicate("m14_unconditional", "REQUEST_PROTOCOL", "unconditionalMatch", "", "true")


@register(
    "m01_capture",
    views.cte("page_views") + "SELECT req_id, regexp_extract(url, '^https?://([^./]+)[.]', 1) AS captured FROM page_views WHERE regexp_matches(url, '^https?://([^./]+)[.]')",
)
def m01_capture(spark, sf_dir):
    rows = views.view(spark, sf_dir, "page_views").select("req_id", capture(_C("url"), r"^https?://([^./]+)[.]", 1).alias("captured"))
    return rows.filter("captured is not null")


@register("m12_validate_utf8", "SELECT doc_id, doc_id % 3 = 0 AS invalid FROM documents")
def m12(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    spoiled = F.unhex(F.concat(F.hex(F.encode("text", "UTF-8")), F.lit("FF"))).cast("string")
    value = F.when(_C("doc_id") % 3 == 0, spoiled).otherwise(_C("text"))
    return docs.select("doc_id", match("validateUtf8Encoding", value, "").alias("invalid"))


# ---- encoders -----------------------------------------------------------------------------------------------------

_BYTES = "regexp_extract_all(hex(encode({c})), '..')"
_URL_SQL = (
    "array_to_string(list_transform(string_split(text, ''), lambda ch: CASE WHEN ch = ' ' THEN '+' WHEN regexp_matches(ch, '[A-Za-z0-9_.~-]') THEN ch "
    "ELSE array_to_string(list_transform(regexp_extract_all(hex(encode(ch)), '..'), lambda b: concat('%', b)), '') END), '')"
)


@register("g1_url_encode", _DIALOG + f"SELECT row_id, coded, replace(replace(coded, '%', '%25'), '+', '%2B') AS twice FROM (SELECT row_id, {_URL_SQL} AS coded FROM dialog) d")
def g1(spark, sf_dir):
    return _dialog(spark, sf_dir).select("row_id", G.url_encode(_C("text")).alias("coded"), G.double_url_encode(_C("text")).alias("twice"))


@register(
    "g2_html_entity_encode",
    _DIALOG + "SELECT row_id, array_to_string(list_transform(list_filter(string_split(text, ''), lambda ch: ch <> ''), lambda ch: concat('&#x', lower(to_hex(unicode(ch))), ';')), '') AS coded FROM dialog",
)
def g2(spark, sf_dir):
    return _dialog(spark, sf_dir).select("row_id", G.html_entity_encode(_C("text")).alias("coded"))


_CASE_SQL = """array_to_string(list_transform(range(length(text)), lambda i:
  CASE WHEN substr(sha1(concat(CAST(row_id AS VARCHAR), ':', CAST(i AS VARCHAR), ':42')), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')
  THEN lower(substr(text, CAST(i + 1 AS BIGINT), 1)) WHEN substr(text, CAST(i + 1 AS BIGINT), 1) = 'ß' THEN 'SS' ELSE upper(substr(text, CAST(i + 1 AS BIGINT), 1)) END), '')"""


@register("g3_case_vary", _DIALOG + f"SELECT row_id, {_CASE_SQL} AS varied FROM dialog")
def g3(spark, sf_dir):
    return _dialog(spark, sf_dir).select("row_id", G.case_vary(_C("text"), _C("row_id")).alias("varied"))


@register(
    "g4_hex_encode",
    _DIALOG + "SELECT row_id, array_to_string(list_transform(list_filter(string_split(text, ''), lambda ch: ch <> ''), lambda ch: concat('%', lower(hex(encode(ch))))), '') AS coded FROM dialog",
)
def g4(spark, sf_dir):
    return _dialog(spark, sf_dir).select("row_id", G.hex_encode(_C("text")).alias("coded"))


def _digit_sql(salt: str) -> str:
    return f"CAST(concat('0x', substr(sha1(concat(CAST(req_id AS VARCHAR), ':42{salt}')), 1, 7)) AS BIGINT)"


_NAMES_SQL = "['url_encode', 'double_url_encode', 'html_entity_encode', 'case_vary', 'hex_encode']"


@register(
    "g5_augment_choice",
    views.cte("requests")
    + f"SELECT req_id, {_NAMES_SQL}[a + 1] AS single, concat({_NAMES_SQL}[a + 1], '+', {_NAMES_SQL}[(a + b) % 5 + 1]) AS pair"
    f" FROM (SELECT req_id, {_digit_sql('a')} % 5 AS a, {_digit_sql('b')} % 4 + 1 AS b FROM requests) c",
)
def g5(spark, sf_dir):
    rows = views.requests(spark, sf_dir).select("req_id", "payload")
    single = augment(rows, ["payload"], "single").withColumnsRenamed({"encoding": "single", "payload": "p1"})
    return augment(single.withColumn("payload", _C("p1")), ["payload"], "double").select("req_id", "single", _C("encoding").alias("pair"))


def robustness(spark, sf_dir, mode: str):
    """Attack payloads encoded, sent as an argument, scanned by the rules that look at arguments."""
    attacks = views.requests(spark, sf_dir).filter("label = 'malicious'").select("req_id", "payload")
    encoded = augment(attacks, ["payload"], mode)
    targets = encoded.select("req_id", F.lit("ARGS").alias("collection"), F.lit("q").alias("name"), _C("payload").alias("value"))
    rules = rule_pack.rules(spark).filter(F.array_contains("collections", "ARGS") & (_C("pl") <= 2))
    return robustness_report(encoded, rule_scan(targets, rules, rule_pack.phrases(spark)))


@register("g6_robustness_single")
def g6(spark, sf_dir):
    return robustness(spark, sf_dir, "single")


@register("g6_robustness_double")
def g6_double(spark, sf_dir):
    return robustness(spark, sf_dir, "double")
