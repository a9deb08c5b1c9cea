"""Rule scan, policy and scores over the request view, with check SQL written from the rule pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.config import CATEGORIES, ScanConfig
from tracewarden.operators import phrase_index, policy, row_scan, scan, scoring
from tracewarden.operators.targets import explode_targets
from tracewarden.plans import rule_pack, views
from tracewarden.plans.registry import register
from tracewarden.schemas import RULES

_C = F.col

# ---- check SQL ----------------------------------------------------------------------------------------------------


def _decode(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


_NAME = "CASE WHEN contains(p, '=') THEN substr(p, 1, instr(p, '=') - 1) ELSE p END"
_VALUE = "CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END"
_HEADER_COLUMNS = {
    "Host": "host", "User-Agent": "user_agent", "Referer": "referer", "Accept": "accept",
    "Accept-Encoding": "accept_encoding", "Content-Type": "content_type", "Cookie": "cookie",
    "Connection": "connection", "Content-Length": "content_length", "Transfer-Encoding": "transfer_encoding",
    "Range": "range_header", "X-HTTP-Method-Override": "method_override",
}
_HEADER_ROWS = " UNION ALL ".join(
    f"SELECT req_id, '{name}' AS name, {column} AS value FROM requests WHERE {column} IS NOT NULL"
    for name, column in [*_HEADER_COLUMNS.items(), ("Content-Length", "content_length_2")]
)
_URI = "CASE WHEN query = '' THEN path ELSE concat(path, '?', query) END"
TARGET_CTE = views.cte("requests") + f""", pieces AS (
  SELECT req_id, 'get' AS side, unnest(list_filter(string_split(query, '&'), lambda p: p <> '')) AS p FROM requests
  UNION ALL SELECT req_id, 'post', unnest(list_filter(string_split(body, '&'), lambda p: p <> '')) FROM requests
  WHERE content_type = 'application/x-www-form-urlencoded'),
args AS (SELECT req_id, side, {_decode(_NAME)} AS name, {_decode(_VALUE)} AS value FROM pieces
  UNION ALL SELECT req_id, 'post', concat('json.', n), json_extract_string(body, concat('$.', n)) FROM
  (SELECT req_id, body, unnest(json_keys(body)) AS n FROM requests WHERE content_type = 'application/json')),
header_rows AS ({_HEADER_ROWS}),
cookies AS (SELECT req_id, unnest(list_filter(string_split(cookie, ';'), lambda p: trim(p) <> '')) AS p FROM requests WHERE cookie IS NOT NULL),
targets AS (
  SELECT req_id, 'ARGS' AS collection, name, value FROM args
  UNION ALL SELECT req_id, 'ARGS_GET', name, value FROM args WHERE side = 'get'
  UNION ALL SELECT req_id, 'ARGS_POST', name, value FROM args WHERE side = 'post'
  UNION ALL SELECT req_id, 'ARGS_NAMES', name, name FROM args
  UNION ALL SELECT req_id, 'REQUEST_COOKIES', trim({_NAME}), {_VALUE} FROM cookies
  UNION ALL SELECT req_id, 'REQUEST_COOKIES_NAMES', trim({_NAME}), trim({_NAME}) FROM cookies
  UNION ALL SELECT req_id, 'REQUEST_HEADERS', name, value FROM header_rows
  UNION ALL SELECT DISTINCT req_id, 'REQUEST_HEADERS_NAMES', name, name FROM header_rows
  UNION ALL SELECT req_id, 'REQUEST_METHOD', '', method FROM requests
  UNION ALL SELECT req_id, 'REQUEST_PROTOCOL', '', protocol FROM requests
  UNION ALL SELECT req_id, 'REQUEST_URI', '', {_URI} FROM requests
  UNION ALL SELECT req_id, 'REQUEST_FILENAME', '', path FROM requests
  UNION ALL SELECT req_id, 'REQUEST_BASENAME', '', regexp_extract(path, '([^/]*)$', 1) FROM requests
  UNION ALL SELECT req_id, 'REQUEST_LINE', '', concat(method, ' ', {_URI}, ' ', protocol) FROM requests
  UNION ALL SELECT req_id, 'QUERY_STRING', '', query FROM requests
  UNION ALL SELECT req_id, 'REQUEST_BODY', '', body FROM requests WHERE body <> ''
  UNION ALL SELECT req_id, 'REMOTE_ADDR', '', client_ip FROM requests
  UNION ALL SELECT req_id, 'RESPONSE_STATUS', '', CAST(status AS VARCHAR) FROM requests
  UNION ALL SELECT req_id, 'RESPONSE_HEADERS', 'Content-Type', 'text/html' FROM requests
  UNION ALL SELECT req_id, 'RESPONSE_HEADERS', 'Content-Encoding', response_encoding FROM requests WHERE response_encoding IS NOT NULL
  UNION ALL SELECT req_id, 'RESPONSE_BODY', '', response_body FROM requests)
"""

_STEP_SQL = {
    "urlDecodeUni": "url_decode(replace({v}, '+', ' '))",
    "lowercase": "lower({v})",
    "removeNulls": "replace({v}, chr(0), '')",
    "compressWhitespace": "regexp_replace({v}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')",
    "removeWhitespace": "regexp_replace({v}, '[ \\t\\n\\r\\f\\v]+', '', 'g')",
    "replaceComments": "regexp_replace({v}, '(?s)/\\*.*?(?:\\*/|\\z)', ' ', 'g')",
    "htmlEntityDecode": "replace(replace(replace(replace({v}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')",
    "jsDecode": "replace(replace({v}, concat(chr(92), 'b'), chr(8)), chr(92), '')",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chain_sql(chain) -> str:
    v = "value"
    for step in chain:
        v = _STEP_SQL[step].format(v=v)
    return v


_COMPARE_SQL = {"eq": "=", "lt": "<", "gt": ">", "ge": ">=", "le": "<="}
_TEXT_SQL = {
    "streq": "{v} = {arg}",
    "endsWith": "ends_with({v}, {arg})",
    "beginsWith": "starts_with({v}, {arg})",
    "validateUtf8Encoding": "({v} IS NULL)",
    "unconditionalMatch": "({v} IS NOT NULL)",
}


def _test_sql(rule, v: str) -> str:
    op, arg = rule["operator"], rule["argument"]
    if op == "rx":
        test = f"regexp_matches({v}, {_quoted(arg)})"
    elif op == "within":
        test = f"contains({_quoted(arg)}, {v})"
    elif op == "contains":
        test = f"contains({v}, {_quoted(arg)})"
    elif op == "validateUrlEncoding":
        test = f"contains(regexp_replace({v}, '%[0-9a-fA-F][0-9a-fA-F]', '', 'g'), '%')"
    elif op in _COMPARE_SQL:
        test = f"coalesce(TRY_CAST({v} AS BIGINT), 0) {_COMPARE_SQL[op]} {arg}"
    elif op in _TEXT_SQL:
        test = _TEXT_SQL[op].format(v=v, arg=_quoted(arg))
    elif op == "validateByteRange":
        test = f"regexp_matches({v}, '[^\\x09\\x0a\\x20-\\x7e]')"  # the ranges of the one rule that has it
    elif op == "ipMatch":
        test = f"regexp_matches({v}, '^10\\.') AND TRY_CAST(split_part({v}, '.', 2) AS INT) < 128"
    else:
        words = arg.split() if op == "pm" else [w for name in arg.split() for w in rule_pack.PHRASE_LISTS[name]]
        test = "(" + " OR ".join(f"contains(lower({v}), {_quoted(w.lower())})" for w in words) + ")"
    return f"NOT ({test})" if rule["negate"] else f"({test})"


def _count_rule_sql(rule) -> str:
    """Targets per request, requests without any included."""
    (collection,) = rule["collections"]
    named = f" AND regexp_matches(t.name, {_quoted(rule['name_filter'])})" if rule["name_filter"] else ""
    label = f"&{collection}:{rule['name_filter']}" if rule["name_filter"] else f"&{collection}"
    return (
        f"SELECT req_id, CAST({rule['rule_id']} AS INT) AS rule_id, CAST(0 AS INT) AS chain_link, {_quoted(label)} AS collection, '' AS name,"
        f" CAST(n AS VARCHAR) AS value FROM (SELECT r.req_id, count(t.req_id) AS n FROM requests r LEFT JOIN targets t"
        f" ON t.req_id = r.req_id AND t.collection = {_quoted(collection)}{named} GROUP BY 1) WHERE {_test_sql(rule, 'n')}"
    )


def _rule_sql(rule) -> str:
    if rule["is_count"]:
        return _count_rule_sql(rule)
    where = [f"collection IN ({', '.join(_quoted(c) for c in rule['collections'])})"]
    if rule["name_filter"]:
        where.append(f"regexp_matches(name, {_quoted(rule['name_filter'])})")
    for out in rule["excluded"]:
        where.append(f"NOT (collection = {_quoted(out['collection'])} AND regexp_matches(name, {_quoted(out['name'])}))")
    chains = [rule["transforms"][:n] for n in range(len(rule["transforms"]) + 1)] if rule["multi_match"] else [rule["transforms"]]
    where.append("(" + " OR ".join(_test_sql(rule, _chain_sql(c)) for c in chains) + ")")
    link = rule["chain_link"] or 0
    return (
        f"SELECT req_id, CAST({rule['rule_id']} AS INT) AS rule_id, CAST({link} AS INT) AS chain_link, collection, name, value"
        f" FROM targets WHERE {' AND '.join(where)}"
    )


def matches_cte(rules) -> str:
    return TARGET_CTE + ", matches AS (" + "\nUNION ALL ".join(_rule_sql(r) for r in rules) + ")\n"


def _values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS r({names})"


_FACTS = [
    (r["rule_id"], r["pl"], r["score_var"], r["direction"], r["phase"], {"CRITICAL": 5, "ERROR": 4, "WARNING": 3, "NOTICE": 2}[r["severity"]], r["msg"], ";".join(r["tags"]))
    for r in rule_pack.PACK
    if (r["chain_len"] or 1) == (r["chain_link"] or 1)
]
_FACT_SQL = _values(_FACTS, "rule_id, pl, score_var, direction, phase, points, msg, tags")


def completed_cte(rules, gate: str = "true") -> str:
    """Matches that score: plain ones, and the last link of chains with all links; compressed bodies left out."""
    return (
        matches_cte(rules)
        + f""", gated AS (SELECT m.* FROM matches m JOIN requests r USING (req_id) WHERE {gate} AND NOT (m.collection = 'RESPONSE_BODY' AND r.response_encoding IS NOT NULL)),
chains AS (SELECT req_id, rule_id FROM gated WHERE chain_link > 0 GROUP BY ALL HAVING count(DISTINCT chain_link) = 2),
done AS (SELECT * FROM gated WHERE chain_link = 0 UNION ALL SELECT g.* FROM gated g JOIN chains USING (req_id, rule_id) WHERE g.chain_link = 2)
"""
    )


# ---- queries ------------------------------------------------------------------------------------------------------


def _pack_collections(rules) -> list[str]:
    return sorted({c for r in rules for c in r["collections"]})


def _targets(spark, sf_dir, collections=None):
    return explode_targets(views.requests(spark, sf_dir), collections)


_MATCH_COLUMNS = ["req_id", "rule_id", "chain_link", "collection", "name", "value"]


@register("r7_explode_targets", TARGET_CTE + "SELECT req_id, collection, name, value FROM targets")
def r7(spark, sf_dir):
    return _targets(spark, sf_dir)


@register("j1_rule_scan", matches_cte(rule_pack.PACK) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches")
def j1(spark, sf_dir):
    targets = _targets(spark, sf_dir, _pack_collections(rule_pack.PACK))
    return scan.rule_scan(targets, rule_pack.rules(spark), rule_pack.phrases(spark)).select(*_MATCH_COLUMNS)


def _operator_rule(number: int, collection: str, operator: str, argument: str, **extra) -> dict:
    return rule_pack._rule(990000 + number, "operators", 1, [collection], operator, argument, [], "NOTICE", "inbound", operator, **extra)


# one rule per operator, and one on counts
_OPERATOR_RULES = [
    _operator_rule(1, "REQUEST_URI", "rx", "[0-9]{2}", negate=True),
    _operator_rule(2, "REQUEST_HEADERS", "pm", "curl bot python", name_filter="^User-Agent$"),
    _operator_rule(3, "REQUEST_HEADERS", "pmFromFile", "scanner-agents web-shells", name_filter="^User-Agent$"),
    _operator_rule(4, "REQUEST_METHOD", "within", "HEAD OPTIONS", negate=True),
    _operator_rule(5, "REQUEST_METHOD", "streq", "POST"),
    _operator_rule(6, "REQUEST_URI", "contains", "/api"),
    _operator_rule(7, "REQUEST_URI", "endsWith", "1"),
    _operator_rule(8, "REQUEST_PROTOCOL", "beginsWith", "HTTP/1."),
    _operator_rule(9, "RESPONSE_STATUS", "eq", "200"),
    _operator_rule(10, "RESPONSE_STATUS", "lt", "300"),
    _operator_rule(11, "RESPONSE_STATUS", "gt", "400"),
    _operator_rule(12, "RESPONSE_STATUS", "ge", "404"),
    _operator_rule(13, "RESPONSE_STATUS", "le", "404"),
    _operator_rule(14, "ARGS", "validateByteRange", "9,10,32-126"),
    _operator_rule(15, "ARGS", "validateUrlEncoding", ""),
    _operator_rule(16, "REQUEST_METHOD", "validateUtf8Encoding", "", negate=True),
    _operator_rule(17, "REMOTE_ADDR", "ipMatch", "10.0.0.0/9,2001:db8::/32"),
    _operator_rule(18, "REQUEST_METHOD", "unconditionalMatch", ""),
    _operator_rule(19, "ARGS", "ge", "2", is_count=True),
    _operator_rule(20, "REQUEST_HEADERS", "eq", "0", is_count=True, name_filter="^User-Agent$"),
]
_COUNT_RULES = [r for r in _OPERATOR_RULES if r["is_count"]]
_ALL_RULES = rule_pack.PACK + _OPERATOR_RULES


@register("j1_rule_scan_large_table", matches_cte(_ALL_RULES) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches")
def j1_large(spark, sf_dir):
    """The whole pack and a rule per operator, scanned as a table of more rules than one projection holds."""
    targets = _targets(spark, sf_dir, _pack_collections(_ALL_RULES))
    rules = spark.createDataFrame(_ALL_RULES, RULES)
    return scan.rule_scan(targets, rules, rule_pack.phrases(spark), batch=10).select(*_MATCH_COLUMNS)


_PHRASE_RULES = [r for r in _ALL_RULES if r["operator"] in ("pm", "pmFromFile") and not r["negate"]]


@register("j1_phrase_rules_by_index", matches_cte(_PHRASE_RULES) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches")
def j1_phrases(spark, sf_dir):
    """The phrase rules by the path that takes lists and rules of any number."""
    targets = _targets(spark, sf_dir, _pack_collections(_PHRASE_RULES))
    rules = spark.createDataFrame(_ALL_RULES, RULES)
    return phrase_index.phrase_rule_scan(targets, rules, rule_pack.phrases(spark)).select(*_MATCH_COLUMNS)


_REFUSED = _operator_rule(21, "ARGS", "pmFromFile", "refused")
_REFUSED["collections"] = ["ARGS", "REQUEST_URI", "REQUEST_BODY", "REQUEST_COOKIES"]


@register(
    "m03_phrase_table",
    TARGET_CTE
    + """, refused AS (SELECT DISTINCT lower(t.value) AS phrase FROM targets t JOIN requests r USING (req_id) WHERE r.status = 403 AND t.collection = 'ARGS' AND t.value <> ''),
texts AS (SELECT DISTINCT lower(value) AS text FROM targets WHERE collection IN ('ARGS', 'REQUEST_URI', 'REQUEST_BODY', 'REQUEST_COOKIES')),
hits AS (SELECT text FROM texts WHERE EXISTS (SELECT 1 FROM refused WHERE contains(text, phrase)))
SELECT req_id, CAST(990021 AS INT) AS rule_id, CAST(0 AS INT) AS chain_link, collection, name, value FROM targets JOIN hits ON lower(value) = text
WHERE collection IN ('ARGS', 'REQUEST_URI', 'REQUEST_BODY', 'REQUEST_COOKIES')""",
)
def m03_table(spark, sf_dir):
    """Every argument of a refused request is a phrase of the list: a list that grows with the traffic."""
    requests = views.requests(spark, sf_dir)
    refused = explode_targets(requests.filter(_C("status") == 403), ["ARGS"]).filter(_C("value") != "")
    phrases = refused.select(F.lit("refused").alias("list_name"), F.col("value").alias("phrase"))
    rules = spark.createDataFrame([_REFUSED], RULES)
    return phrase_index.phrase_rule_scan(explode_targets(requests, _REFUSED["collections"]), rules, phrases).select(*_MATCH_COLUMNS)


@register("m09_count_rule", matches_cte(_COUNT_RULES) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches")
def m09_count(spark, sf_dir):
    rules = spark.createDataFrame(_COUNT_RULES, RULES)
    return scan.scan_requests(views.requests(spark, sf_dir), rules).select(*_MATCH_COLUMNS)


def _scan(spark, sf_dir, family=None, config=ScanConfig(blocking_pl=2, detection_pl=4)):
    rules = rule_pack.rules(spark, family)
    return scan.scan_requests(views.requests(spark, sf_dir), rules, rule_pack.phrases(spark), config), rules


def _family_query(ident: str, family: str) -> None:
    own = [r for r in rule_pack.PACK if r["family"] == family]

    @register(
        f"{ident}_{family.replace('-', '_')}",
        completed_cte(own)
        + "SELECT rule_id, collection, count(*) AS hits, count(DISTINCT req_id) AS requests FROM done GROUP BY ALL",
    )
    def query(spark, sf_dir):
        matches, _ = _scan(spark, sf_dir, family)
        return matches.groupBy("rule_id", "collection").agg(
            F.count("*").alias("hits"), F.count_distinct("req_id").alias("requests")
        )


for _ident, _family in rule_pack.FAMILIES.items():
    _family_query(_ident, _family)

_EXCLUDED = [(942904, "ARGS", "^page$"), (942904, "REQUEST_COOKIES", ".*"), (930902, "ARGS", "^note$"), (941901, "ARGS", "^no")]


@register(
    "j2_excluded_targets",
    matches_cte([r for r in rule_pack.PACK if r["family"] in ("sqli", "lfi", "xss")])
    + f""", x AS (SELECT * FROM {_values(_EXCLUDED, 'rule_id, collection, name')})
SELECT {', '.join(_MATCH_COLUMNS)} FROM matches m WHERE NOT EXISTS (
  SELECT 1 FROM x WHERE x.rule_id = m.rule_id AND x.collection = m.collection AND regexp_matches(m.name, x.name))""",
)
def j2(spark, sf_dir):
    rules = rule_pack.rules(spark).filter(_C("family").isin("sqli", "lfi", "xss"))
    targets = _targets(spark, sf_dir, _pack_collections(rule_pack.PACK))
    excluded = spark.createDataFrame(_EXCLUDED, "rule_id int, collection string, name string")
    return scan.exclude_targets(scan.rule_scan(targets, rules), excluded).select(*_MATCH_COLUMNS)


_INJECTION = [r for r in rule_pack.PACK if r["family"] in ("sqli", "xss")]


@register(
    "j3_runtime_exclusions",
    matches_cte(_INJECTION)
    + f"""SELECT m.* FROM matches m JOIN requests r USING (req_id)
WHERE NOT (starts_with(r.path, '/api/') AND m.rule_id = 942904)
  AND NOT (starts_with(r.path, '/api/view') AND m.rule_id BETWEEN 941000 AND 941999)
  AND NOT (starts_with(r.path, '/click') AND m.rule_id BETWEEN 942000 AND 942999 AND m.collection = 'ARGS' AND regexp_matches(m.name, '^note$'))""",
)
def j3(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    rules = rule_pack.rules(spark).filter(_C("family").isin("sqli", "xss"))
    targets = explode_targets(requests, _pack_collections(_INJECTION))
    path, none = _C("path"), F.lit(None).cast("string")
    per_request = F.array_compact(
        F.array(
            F.when(path.startswith("/api/"), F.struct(F.lit("id").alias("scope"), F.lit(942904).alias("rule_id"), none.alias("tag"), none.alias("collection"), none.alias("name"))),
            F.when(path.startswith("/api/view"), F.struct(F.lit("tag").alias("scope"), F.lit(None).cast("int").alias("rule_id"), F.lit("attack-xss").alias("tag"), none.alias("collection"), none.alias("name"))),
            F.when(path.startswith("/click"), F.struct(F.lit("target").alias("scope"), F.lit(None).cast("int").alias("rule_id"), F.lit("attack-sqli").alias("tag"), F.lit("ARGS").alias("collection"), F.lit("^note$").alias("name"))),
        )
    )
    exclusions = requests.select("req_id", F.explode(per_request).alias("x")).select("req_id", "x.*")
    return scan.apply_exclusions(scan.rule_scan(targets, rules), rules, exclusions).select(*_MATCH_COLUMNS)


@register(
    "j4_static_exclusions",
    matches_cte([r for r in rule_pack.PACK if r["family"] in ("sqli", "xss")])
    + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches WHERE rule_id <> 942904 AND rule_id NOT BETWEEN 941000 AND 941999 AND NOT (rule_id = 942903 AND collection = 'ARGS' AND regexp_matches(name, '^q$'))",
)
def j4(spark, sf_dir):
    rules = scan.exclude_rules(
        rule_pack.rules(spark).filter(_C("family").isin("sqli", "xss")), [942904], ["attack-xss"], [(942903, "ARGS", "^q$")]
    )
    return scan.rule_scan(_targets(spark, sf_dir, _pack_collections(_INJECTION)), rules).select(*_MATCH_COLUMNS)


_FIXATION = [r for r in rule_pack.PACK if r["family"] == "fixation"]


@register("j5_chained_rules", completed_cte(_FIXATION) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM done")
def j5(spark, sf_dir):
    rules = rule_pack.rules(spark, "fixation")
    matches = scan.rule_scan(_targets(spark, sf_dir, _pack_collections(_FIXATION)), rules)
    return scan.complete_chains(matches, rules).select(*_MATCH_COLUMNS)


@register(
    "j5_chain_capture",
    TARGET_CTE
    + """, a AS (SELECT req_id, regexp_extract(value, '^https?://([^/]*)/', 1) AS captured FROM targets WHERE collection = 'REQUEST_HEADERS' AND name = 'Referer')
SELECT t.req_id, t.value AS host FROM targets t JOIN a USING (req_id) WHERE t.collection = 'REQUEST_HEADERS' AND t.name = 'Host' AND t.value <> a.captured""",
)
def j5_capture(spark, sf_dir):
    from tracewarden.functions.predicates import capture

    headers = _targets(spark, sf_dir, ["REQUEST_HEADERS"])
    referer = headers.filter(_C("name") == "Referer").withColumn("captured", capture(_C("value"), r"^https?://([^/]*)/", 1))
    host = headers.filter(_C("name") == "Host")
    return scan.capture_chain(referer, host, _C("value") != _C("captured")).select("req_id", _C("value").alias("host"))


_FROM_ELSEWHERE = [
    _operator_rule(31, "ARGS_NAMES", "rx", "^(?:sessionid|user)$", chain_id=990031, chain_link=1, chain_len=3),
    _operator_rule(31, "REQUEST_HEADERS", "rx", "^(https?)://([^/]*)/", chain_id=990031, chain_link=2, chain_len=3, name_filter="^Referer$", capture=True),
    _operator_rule(31, "TX:2", "endsWith", "%{request_headers.host}", chain_id=990031, chain_link=3, chain_len=3, negate=True),
    _operator_rule(32, "REQUEST_HEADERS", "rx", "^https?://([^/]*)/", chain_id=990032, chain_link=1, chain_len=2, name_filter="^Referer$", capture=True),
    _operator_rule(32, "REQUEST_HEADERS", "streq", "%{tx.1}", chain_id=990032, chain_link=2, chain_len=2, name_filter="^Host$"),
]


@register(
    "j5_captures_by_rules",
    views.cte("requests")
    + """, r AS (SELECT q.*, regexp_extract(referer, '^https?://([^/]*)/', 1) AS site FROM requests q WHERE regexp_matches(referer, '^https?://([^/]*)/')),
named AS (SELECT DISTINCT req_id FROM ("""
    + TARGET_CTE
    + """SELECT * FROM targets) t WHERE collection = 'ARGS_NAMES' AND regexp_matches(value, '^(?:sessionid|user)$'))
SELECT req_id, CAST(990031 AS INT) AS rule_id, CAST(3 AS INT) AS chain_link, 'TX' AS collection, '2' AS name, site AS value FROM r JOIN named USING (req_id)
WHERE NOT ends_with(site, coalesce(host, ''))
UNION ALL SELECT req_id, CAST(990032 AS INT), CAST(2 AS INT), 'REQUEST_HEADERS', 'Host', host FROM r WHERE host = site""",
)
def j5_rules(spark, sf_dir):
    """Links that look at a captured text, or compare with one, straight from the rule table."""
    rules = spark.createDataFrame(_FROM_ELSEWHERE, RULES)
    return scan.scan_requests(views.requests(spark, sf_dir), rules).select(*_MATCH_COLUMNS)


@register("j5_chains_in_rows", completed_cte(rule_pack.PACK) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM done")
def j5_in_rows(spark, sf_dir):
    """The whole pack scanned within the request rows, chains completed without a shuffle."""
    rules, lists = rule_pack.rules(spark).collect(), scan.phrase_lists(rule_pack.phrases(spark))
    requests = scan.response_gate(views.requests(spark, sf_dir))
    return row_scan.explode_matches(row_scan.with_matches(requests, rules, lists)).select(*_MATCH_COLUMNS)


_LFI = [r for r in rule_pack.PACK if r["rule_id"] == 930901]


@register("j6_multi_match", matches_cte(_LFI) + f"SELECT {', '.join(_MATCH_COLUMNS)} FROM matches")
def j6(spark, sf_dir):
    rules = rule_pack.rules(spark).filter(_C("rule_id") == 930901)
    return scan.rule_scan(_targets(spark, sf_dir, ["ARGS", "REQUEST_URI"]), rules).select(*_MATCH_COLUMNS)


@register(
    "j7_paranoia_gate",
    completed_cte([r for r in rule_pack.PACK if r["pl"] <= 2]) + "SELECT rule_id, count(*) AS hits FROM done GROUP BY rule_id",
)
def j7(spark, sf_dir):
    matches, _ = _scan(spark, sf_dir, config=ScanConfig(blocking_pl=1, detection_pl=2))
    return matches.groupBy("rule_id").agg(F.count("*").alias("hits"))


@register(
    "j8_loopback_exception",
    views.cte("requests")
    + """SELECT req_id FROM requests WHERE NOT (
  CASE WHEN req_id % 8 = 2 THEN '127.0.0.1' ELSE client_ip END = '127.0.0.1' AND method = 'GET' AND path = '/' AND query = '' AND protocol IN ('HTTP/1.0', 'HTTP/1.1', 'HTTP/2.0'))""",
)
def j8(spark, sf_dir):
    local = F.when(_C("req_id") % 8 == 2, "127.0.0.1").otherwise(_C("client_ip"))
    agent = F.map_concat(
        F.map_filter("headers", lambda k, _: k != "User-Agent"),
        F.create_map(F.lit("User-Agent"), F.array(F.lit("server (internal dummy connection)"))),
    )
    requests = views.requests(spark, sf_dir).withColumns({"client_ip": local, "headers": agent})
    return scan.scan_gate(requests, ScanConfig()).select("req_id")


@register(
    "j9_sample_requests",
    views.cte("requests")
    + """SELECT req_id FROM (SELECT req_id, regexp_extract(sha1(CAST(req_id AS VARCHAR)), '^[a-f]*([0-9])[a-f]*([0-9])', 1) AS a,
  regexp_extract(sha1(CAST(req_id AS VARCHAR)), '^[a-f]*([0-9])[a-f]*([0-9])', 2) AS b FROM requests) s WHERE a = '' OR CAST(concat(a, b) AS INT) < 35""",
)
def j9(spark, sf_dir):
    return scan.sample_requests(views.requests(spark, sf_dir), 35).select("req_id")


@register(
    "j10_parameter_pollution",
    TARGET_CTE + "SELECT req_id, name, count(*) AS n FROM targets WHERE collection = 'ARGS_NAMES' GROUP BY ALL HAVING count(*) > 1",
)
def j10(spark, sf_dir):
    return policy.parameter_pollution(_targets(spark, sf_dir, ["ARGS_NAMES"]))


@register(
    "j11_session_fixation",
    TARGET_CTE
    + f""", named AS (SELECT DISTINCT req_id FROM targets WHERE collection = 'ARGS_NAMES' AND lower(value) IN ({', '.join(_quoted(n) for n in policy.SESSION_NAMES)})),
r AS (SELECT req_id, host, referer, regexp_extract(coalesce(referer, ''), '^(?:ht|f)tps?://(.*?)/', 1) AS site FROM requests JOIN named USING (req_id))
SELECT req_id, CAST(943110 AS INT) AS rule_id FROM r WHERE site <> '' AND NOT coalesce(ends_with(site, host), false)
UNION ALL SELECT req_id, CAST(943120 AS INT) FROM r WHERE referer IS NULL""",
)
def j11(spark, sf_dir):
    return policy.session_fixation(views.requests(spark, sf_dir))


_STRICT = ScanConfig(
    blocking_pl=4, max_num_args=3, arg_name_length=7, arg_length=20, total_arg_length=50, max_file_size=60, combined_file_sizes=25
)


def _policy_query(name: str, group: str, checks: dict[int, str], prefix: str = views.cte("requests")) -> None:
    arms = " UNION ALL ".join(
        f"SELECT req_id, CAST({rule_id} AS INT) AS rule_id FROM requests WHERE {test}" for rule_id, test in checks.items()
    )

    @register(name, prefix + arms)
    def query(spark, sf_dir):
        found = policy.policy_matches(views.requests(spark, sf_dir), _STRICT, [group])
        return found.select("req_id", "rule_id")


def _in(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


_policy_query("j12_method_policy", "method", {911100: f"method NOT IN {_in(_STRICT.allowed_methods)}"})
_MEDIA = "regexp_extract(lower(content_type), '^([^;\\s]+)', 1)"
_policy_query(
    "j13_list_policy",
    "lists",
    {
        920430: f"protocol NOT IN {_in(_STRICT.allowed_versions)}",
        920420: f"{_MEDIA} <> '' AND {_MEDIA} NOT IN {_in(_STRICT.allowed_content_types)}",
        920480: "regexp_extract(lower(content_type), 'charset\\s*=\\s*([^;\\s]+)', 1) NOT IN ('', 'utf-8', 'iso-8859-1', 'iso-8859-15', 'windows-1252')",
        920440: f"regexp_extract(lower(path), '\\.([^./]+)$', 1) IN {_in(_STRICT.restricted_extensions)}",
        920450: "method_override IS NOT NULL",
    },
)
_LENGTH = "coalesce(content_length, content_length_2)"
_ARG = "(SELECT req_id, count(*) AS n, max(strlen(name)) AS longest_name, max(strlen(value)) AS longest, sum(strlen(name) + strlen(value)) AS total FROM args GROUP BY req_id)"
_policy_query(
    "j14_size_limits",
    "sizes",
    {
        920380: f"req_id IN (SELECT req_id FROM {_ARG} a WHERE n > 3)",
        920360: f"req_id IN (SELECT req_id FROM {_ARG} a WHERE longest_name > 7)",
        920370: f"req_id IN (SELECT req_id FROM {_ARG} a WHERE longest > 20)",
        920390: f"req_id IN (SELECT req_id FROM {_ARG} a WHERE total > 50)",
        920400: f"starts_with(content_type, 'multipart/form-data') AND TRY_CAST({_LENGTH} AS BIGINT) > 60",
        920410: "starts_with(content_type, 'multipart/form-data') AND strlen(body) > 25",
    },
    TARGET_CTE,
)
_policy_query(
    "j15_header_sanity",
    "headers",
    {
        920160: f"{_LENGTH} IS NOT NULL AND NOT regexp_matches({_LENGTH}, '^[0-9]+$')",
        920170: f"method IN ('GET', 'HEAD') AND {_LENGTH} NOT IN ('', '0')",
        920171: "method IN ('GET', 'HEAD') AND transfer_encoding IS NOT NULL",
        920180: f"method = 'POST' AND {_LENGTH} IS NULL AND transfer_encoding IS NULL AND NOT regexp_matches(protocol, '^HTTP/[23]')",
        920181: f"{_LENGTH} IS NOT NULL AND transfer_encoding IS NOT NULL",
        920190: "range_header = 'bytes=9-1'",
        920200: "range_header LIKE 'bytes=1-2,%'",
        920210: "connection = 'keep-alive, close'",
        920280: "host IS NULL",
        920290: "host = ''",
        920300: "accept IS NULL AND user_agent IS NOT NULL AND method NOT IN ('OPTIONS', 'CONNECT')",
        920310: "accept = '' AND method <> 'OPTIONS'",
        920320: "user_agent IS NULL",
        920330: "user_agent = ''",
        920340: f"{_LENGTH} <> '0' AND content_type IS NULL",
        920341: f"{_LENGTH} <> '0' AND content_type IS NULL",
        920350: "regexp_matches(host, '^[0-9.]+(:[0-9]+)?$')",
    },
)
_ANY = "req_id IN (SELECT req_id FROM targets WHERE collection IN ({c}) AND {t})"
_WIDE = "'REQUEST_URI', 'REQUEST_HEADERS', 'ARGS', 'ARGS_NAMES'"
_DEC = "url_decode(replace(value, '+', ' '))"
_policy_query(
    "j16_encoding_sanity",
    "encodings",
    {
        920230: _ANY.format(c="'ARGS'", t="regexp_matches(value, '%[0-9a-fA-F]{2}')"),
        920240: "content_type = 'application/x-www-form-urlencoded' AND contains(regexp_replace(body, '%[0-9a-fA-F]{2}', '', 'g'), '%')",
        920270: _ANY.format(c=_WIDE, t=f"contains({_DEC}, chr(0))"),
        920271: _ANY.format(c=_WIDE, t=f"regexp_matches({_DEC}, '[^\\t\\n\\r -~\\x80-\\x{{10FFFF}}]')"),
        920272: _ANY.format(c=_WIDE + ", 'REQUEST_BODY'", t=f"regexp_matches({_DEC}, '[^ -$&-~]')"),
        920273: _ANY.format(c="'ARGS', 'ARGS_NAMES', 'REQUEST_BODY'", t=f"regexp_matches({_DEC}, '[^&,-.0-:=A-Z_a-z]')"),
        920460: _ANY.format(c=_WIDE, t="regexp_matches(lower(value), '(?:^|[^\\\\])\\\\[cdeghijklmpqwxyz123456789]')"),
        920610: "contains(query, '#')",
    },
    TARGET_CTE,
)


@register(
    "j21_response_gate",
    views.cte("requests")
    + "SELECT req_id, CASE WHEN response_encoding IS NULL THEN response_body END AS response_body FROM requests",
)
def j21(spark, sf_dir):
    return scan.response_gate(views.requests(spark, sf_dir)).select("req_id", "response_body")


@register(
    "m9_count_targets",
    TARGET_CTE
    + "SELECT r.req_id, count(t.req_id) AS n FROM requests r LEFT JOIN targets t ON t.req_id = r.req_id AND t.collection = 'REQUEST_HEADERS' AND t.name = 'Content-Length' GROUP BY r.req_id",
)
def m9(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    return scan_count(requests)


def scan_count(requests):
    from tracewarden.operators.targets import count_targets

    return count_targets(explode_targets(requests, ["REQUEST_HEADERS"]), requests, "REQUEST_HEADERS", "content-length")


# ---- scores -------------------------------------------------------------------------------------------------------

_BOTH = ScanConfig(blocking_pl=1, detection_pl=4)


def _score_sql(blocking: int, detection: int) -> str:
    def total(test: str, name: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {test} THEN points END), 0) AS BIGINT) AS {name}"

    parts = []
    for side in ("inbound", "outbound"):
        parts += [total(f"direction = '{side}' AND pl = {n}", f"{side}_pl{n}") for n in scoring.LEVELS]
        parts.append(total(f"direction = '{side}' AND pl <= {blocking}", f"blocking_{side}"))
        parts.append(total(f"direction = '{side}' AND pl <= {detection}", f"detection_{side}"))
    parts.append(total(f"direction = 'inbound' AND pl <= {blocking} AND phase = 1", "early_inbound"))
    parts += [total(f"score_var = '{c}'", f"{c}_score") for c in CATEGORIES]
    return f", scores AS (SELECT req_id, {', '.join(parts)} FROM done JOIN {_FACT_SQL} USING (rule_id) GROUP BY req_id)\n"


SCORE_CTE = completed_cte(rule_pack.PACK) + _score_sql(1, 4)
_DECISION = """CASE WHEN blocking_inbound >= 5 THEN 949110 WHEN blocking_outbound >= 4 THEN 959100 END"""


def _scores(spark, sf_dir, config=_BOTH):
    matches, rules = _scan(spark, sf_dir, config=config)
    return scoring.score_requests(matches, rules, config)


@register(
    "a1_severity_points",
    matches_cte(rule_pack.PACK) + f"SELECT rule_id, CAST(points AS INT) AS points, count(*) AS n FROM matches JOIN {_FACT_SQL} USING (rule_id) GROUP BY ALL",
)
def a1(spark, sf_dir):
    rules = rule_pack.rules(spark)
    matches = scan.rule_scan(_targets(spark, sf_dir, _pack_collections(rule_pack.PACK)), rules, rule_pack.phrases(spark))
    return scoring.point_matches(matches, rules).groupBy("rule_id", "points").agg(F.count("*").alias("n"))


@register("a2_score_requests", SCORE_CTE + "SELECT req_id, " + ", ".join(f"{s}_pl{n}" for s in ("inbound", "outbound") for n in scoring.LEVELS) + " FROM scores")
def a2(spark, sf_dir):
    return _scores(spark, sf_dir).select("req_id", *[f"{s}_pl{n}" for s in ("inbound", "outbound") for n in scoring.LEVELS])


_TOTALS = ["blocking_inbound", "detection_inbound", "blocking_outbound", "detection_outbound"]


@register(
    "a3_blocking_detection",
    SCORE_CTE + f"SELECT r.req_id, {', '.join(f'coalesce({t}, 0) AS {t}' for t in _TOTALS)} FROM requests r LEFT JOIN scores USING (req_id)",
)
def a3(spark, sf_dir):
    scores = scan.score_in_rows(views.requests(spark, sf_dir), rule_pack.rules(spark), rule_pack.phrases(spark), _BOTH)
    return scores.select("req_id", *_TOTALS)


@register("a4_category_scores", SCORE_CTE + f"SELECT req_id, {', '.join(c + '_score' for c in CATEGORIES)} FROM scores")
def a4(spark, sf_dir):
    return _scores(spark, sf_dir).select("req_id", *[f"{c}_score" for c in CATEGORIES])


@register(
    "a5_decide_waf",
    SCORE_CTE
    + f"""SELECT req_id, {_DECISION} IS NOT NULL AS interrupted, CAST({_DECISION} AS INT) AS interruption_rule,
  CAST(CASE WHEN {_DECISION} IS NOT NULL THEN 403 END AS INT) AS interruption_status,
  CASE WHEN {_DECISION} IS NOT NULL THEN 'deny' ELSE 'pass' END AS action FROM scores""",
)
def a5(spark, sf_dir):
    return scoring.decide_waf(_scores(spark, sf_dir), _BOTH).select(
        "req_id", "interrupted", "interruption_rule", "interruption_status", "action"
    )


_EARLY = "CASE WHEN early_inbound >= 5 THEN 949111 WHEN blocking_inbound >= 5 THEN 949110 WHEN blocking_outbound >= 4 THEN 959100 END"


@register(
    "a5_decide_waf_early",
    SCORE_CTE
    + f"SELECT req_id, CAST({_EARLY} AS INT) AS interruption_rule, CAST(CASE WHEN {_EARLY} IS NOT NULL THEN 403 END AS INT) AS interruption_status FROM scores",
)
def a5_early(spark, sf_dir):
    config = ScanConfig(blocking_pl=1, detection_pl=4, early_blocking=True)
    return scoring.decide_waf(_scores(spark, sf_dir, config), config).select("req_id", "interruption_rule", "interruption_status")


_LEVEL_TESTS = {
    0: "false",
    1: "blocking_inbound >= 5 OR blocking_outbound >= 4",
    2: "blocking_inbound >= 5 OR blocking_outbound >= 4 OR detection_inbound >= 5 OR detection_outbound >= 4",
    3: "blocking_inbound + blocking_outbound > 0 OR detection_inbound >= 5 OR detection_outbound >= 4",
    4: "detection_inbound + detection_outbound > 0",
    5: "true",
}


@register(
    "a6_report_level",
    SCORE_CTE
    + " UNION ALL ".join(f"SELECT CAST({n} AS INT) AS level, count(*) AS reported FROM scores WHERE {t}" for n, t in _LEVEL_TESTS.items()),
)
def a6(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    counts = scores.agg(
        *[F.count_if(scoring.reported(ScanConfig(blocking_pl=1, detection_pl=4, reporting_level=n))).alias(f"l{n}") for n in _LEVEL_TESTS]
    )
    return counts.select(F.posexplode(F.array(*[f"l{n}" for n in _LEVEL_TESTS])).alias("level", "reported"))


_SHORT = {"SQLI": "sql_injection", "XSS": "xss", "RFI": "rfi", "LFI": "lfi", "RCE": "rce", "PHPI": "php_injection", "HTTP": "http_violation", "SESS": "session_fixation"}


@register(
    "a7_correlate",
    SCORE_CTE
    + "SELECT req_id, blocking_inbound + blocking_outbound AS blocking_total, detection_inbound + detection_outbound AS detection_total, concat('Anomaly Scores: "
    + " - ".join(
        f"({s.capitalize()} Scores: blocking=', blocking_{s}, ', detection=', detection_{s}, ', per_pl=', {s}_pl1, '-', {s}_pl2, '-', {s}_pl3, '-', {s}_pl4, ', threshold={t})"
        for s, t in (("inbound", 5), ("outbound", 4))
    )
    + " - ("
    + ", ".join(f"{k}=', {v}_score, '" for k, v in _SHORT.items())
    + ", COMBINED_SCORE=', blocking_inbound + blocking_outbound, ')') AS report FROM scores",
)
def a7(spark, sf_dir):
    return scoring.correlate(_scores(spark, sf_dir), _BOTH).select("req_id", "blocking_total", "detection_total", "report")


@register(
    "a8_config_plausibility",
    "SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (p_size % 4 + 1 < p_size % 3 + 1) AS BIGINT) AS rejected FROM part",
)
def a8(spark, sf_dir):
    """Level pairs taken from the part table (a dozen at most), each put to ``ScanConfig.check``."""
    levels = views.table(spark, sf_dir, "part").select((_C("p_size") % 4 + 1).alias("detection"), (_C("p_size") % 3 + 1).alias("blocking"))

    def rejected(blocking: int, detection: int) -> bool:
        try:
            ScanConfig(blocking_pl=blocking, detection_pl=detection).check()
        except ValueError:
            return True
        return False

    pairs = levels.groupBy("blocking", "detection").count().collect()
    checked = [(r["count"], r["count"] if rejected(r["blocking"], r["detection"]) else 0) for r in pairs]
    return spark.createDataFrame(checked, "n long, bad long").agg(F.sum("n").alias("checked"), F.sum("bad").alias("rejected"))


@register(
    "a9_matched_rules_summary",
    completed_cte(rule_pack.PACK)
    + f"""SELECT req_id, count(*) AS matched_count, string_agg(CAST(rule_id AS VARCHAR), ';' ORDER BY rule_id) AS rule_ids,
  string_agg(msg, ';' ORDER BY rule_id) AS messages, string_agg(tags, ';' ORDER BY rule_id) AS tags
FROM (SELECT DISTINCT req_id, rule_id FROM done) d JOIN {_FACT_SQL} USING (rule_id) GROUP BY req_id""",
)
def a9(spark, sf_dir):
    matches, rules = _scan(spark, sf_dir)
    return scoring.matched_rules_summary(matches, rules)


@register(
    "a12_label_distribution",
    views.cte("requests") + "SELECT label, attack_type, method, count(*) AS n FROM requests GROUP BY ALL",
)
def a12(spark, sf_dir):
    return scoring.label_distribution(views.requests(spark, sf_dir), ["label", "attack_type", "method"])


@register(
    "a13_block_rate",
    views.cte("requests")
    + "SELECT count(*) AS requests, count(*) FILTER (status = 403) AS blocked, avg(CASE WHEN status = 403 THEN 1.0 ELSE 0.0 END) AS block_rate FROM requests",
)
def a13(spark, sf_dir):
    return scoring.block_rate(views.requests(spark, sf_dir))
