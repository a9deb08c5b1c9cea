"""A small rule pack and phrase list, one or more rules per family. Rules are data: any table of the schema will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewarden.schemas import PHRASES, RULES

_ARGS = ["ARGS", "ARGS_NAMES", "REQUEST_COOKIES"]
_URL = ["urlDecodeUni"]
_URL_LOW = ["urlDecodeUni", "lowercase"]
_WIDE = ["REQUEST_URI", "ARGS", "REQUEST_HEADERS"]


def _rule(rule_id, family, pl, collections, operator, argument, transforms, severity, score_var, msg, **extra):
    direction = "outbound" if collections[0].startswith("RESPONSE") else "inbound"
    header_phase = {"REQUEST_HEADERS", "REQUEST_METHOD", "REQUEST_PROTOCOL", "REQUEST_URI", "REQUEST_LINE"}
    row = {
        "rule_id": rule_id,
        "family": family,
        "phase": 4 if direction == "outbound" else 1 if set(collections) <= header_phase else 2,
        "pl": pl,
        "chain_id": None,
        "chain_link": None,
        "chain_len": None,
        "collections": collections,
        "name_filter": None,
        "excluded": [],
        "is_count": False,
        "operator": operator,
        "negate": False,
        "argument": argument,
        "transforms": transforms,
        "multi_match": False,
        "capture": False,
        "severity": severity,
        "score_var": score_var,
        "direction": direction,
        "tags": [f"attack-{family}", f"paranoia-level/{pl}", "TRACEWARDEN"],
        "msg": msg,
        "ver": "TRACEWARDEN/1.0",
    }
    row.update(extra)
    return row


PACK = [
    _rule(911901, "method", 1, ["REQUEST_METHOD"], "within", "GET HEAD POST PUT OPTIONS", [], "CRITICAL", "inbound", "Unusual method", negate=True),
    _rule(913901, "scanner", 1, ["REQUEST_HEADERS"], "pmFromFile", "scanner-agents", ["lowercase"], "CRITICAL", "inbound", "Scanner user agent", name_filter="^User-Agent$"),
    _rule(920901, "protocol", 1, ["REQUEST_PROTOCOL"], "rx", r"^HTTP/(?:1\.[01]|2(?:\.0)?|3(?:\.0)?)$", [], "CRITICAL", "inbound", "Unknown protocol version", negate=True),
    _rule(920902, "protocol", 2, ["ARGS"], "validateUrlEncoding", "", [], "WARNING", "inbound", "Broken percent escape"),
    _rule(920903, "protocol", 1, ["REQUEST_HEADERS"], "rx", "^[0-9]+$", [], "CRITICAL", "inbound", "Length is no number", name_filter="^Content-Length$", negate=True),
    _rule(921901, "protocol-attack", 1, ["ARGS", "ARGS_NAMES"], "rx", "[\r\n][a-zA-Z-]+:", _URL, "CRITICAL", "http_violation", "Header injection"),
    _rule(921902, "protocol-attack", 1, ["ARGS"], "rx", r"^\([&|][(][a-z]+=", _URL, "CRITICAL", "http_violation", "Directory query injection"),
    _rule(922901, "multipart", 1, ["REQUEST_HEADERS"], "rx", "(?i)^multipart/form-data;.*boundary=.{0,3}$", [], "CRITICAL", "inbound", "Short multipart boundary", name_filter="^Content-Type$"),
    _rule(930901, "lfi", 1, ["ARGS", "REQUEST_URI"], "rx", r"(?:^|[/\\=])\.\.[/\\]", _URL, "CRITICAL", "lfi", "Path traversal", multi_match=True),
    _rule(930902, "lfi", 1, _ARGS, "rx", r"/etc/(?:passwd|shadow|hosts)|boot\.ini|/proc/self", _URL_LOW, "CRITICAL", "lfi", "System file", excluded=[{"collection": "REQUEST_COOKIES", "name": "^theme$"}]),
    _rule(931901, "rfi", 1, ["ARGS"], "rx", r"(?i)^(?:https?|ftps?|file)://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", [], "CRITICAL", "rfi", "URL with an address"),
    _rule(931902, "rfi", 2, ["ARGS"], "rx", r"(?i)^(?:https?|ftps?|file)://.*\?$", [], "CRITICAL", "rfi", "URL that ends in a question mark"),
    _rule(932901, "rce", 1, _ARGS, "rx", r"[;|`&]\s*(?:cat|ls|id|wget|curl|nc|sh)(?:[^a-z]|$)", _URL_LOW + ["compressWhitespace"], "CRITICAL", "rce", "Unix command"),
    _rule(932902, "rce", 1, _ARGS, "rx", r"\$\([a-z]+", _URL_LOW, "CRITICAL", "rce", "Command substitution"),
    _rule(933901, "php", 1, _ARGS, "rx", r"<\?(?:php|=)", _URL_LOW, "CRITICAL", "php_injection", "Open tag"),
    _rule(933902, "php", 1, _ARGS, "pm", "php://filter php://input system( passthru( shell_exec(", _URL_LOW, "CRITICAL", "php_injection", "PHP stream or function"),
    _rule(934901, "generic", 1, ["ARGS"], "contains", "169.254.169.254", _URL_LOW, "CRITICAL", "rce", "Metadata service address"),
    _rule(941901, "xss", 1, _ARGS, "rx", r"<script[^>]*>", _URL_LOW + ["htmlEntityDecode", "removeNulls"], "CRITICAL", "xss", "Script element"),
    _rule(941902, "xss", 1, _ARGS, "rx", r"<[a-z]+[^>]*[\s/]on[a-z]+\s*=", _URL_LOW + ["htmlEntityDecode"], "CRITICAL", "xss", "Event handler"),
    _rule(941903, "xss", 1, _ARGS, "rx", r"(?:java|vb)script:", _URL_LOW + ["removeWhitespace"], "CRITICAL", "xss", "Script scheme"),
    _rule(941904, "xss", 2, _ARGS, "rx", r"document\.cookie|window\.location", _URL + ["jsDecode", "lowercase"], "CRITICAL", "xss", "Document access"),
    _rule(942901, "sqli", 1, _ARGS, "rx", r"union\s+(?:all\s+)?select", _URL_LOW + ["replaceComments", "compressWhitespace"], "CRITICAL", "sql_injection", "Union select"),
    _rule(942902, "sqli", 1, _ARGS, "rx", r"'\s*(?:or|and)\s+'?[0-9a-z]+'?\s*=\s*'?[0-9a-z]+", _URL_LOW, "CRITICAL", "sql_injection", "Tautology"),
    _rule(942903, "sqli", 1, _ARGS, "rx", r"(?:sleep|benchmark|pg_sleep)\s*\(", _URL_LOW, "CRITICAL", "sql_injection", "Time based probe"),
    _rule(942904, "sqli", 3, _ARGS, "rx", "['\";#]", _URL, "WARNING", "sql_injection", "Quote or comment sign"),
    _rule(943901, "fixation", 1, ["ARGS_NAMES"], "rx", "^(?:sessionid|phpsessid|jsessionid)$", ["lowercase"], "CRITICAL", "session_fixation", "Session id by argument", chain_id=943901, chain_link=1, chain_len=2),
    _rule(943901, "fixation", 1, ["REQUEST_HEADERS"], "rx", r"^https?://other\.", [], "CRITICAL", "session_fixation", "Session id by argument from another site", chain_id=943901, chain_link=2, chain_len=2, name_filter="^Referer$"),
    _rule(943902, "fixation", 1, _ARGS, "pm", "document.cookie= document.cookie+= x.cookie= set-cookie:", _URL_LOW + ["removeWhitespace"], "CRITICAL", "session_fixation", "Cookie set from an argument"),
    _rule(944901, "java", 1, _ARGS, "pm", "getruntime( processbuilder( java.lang.runtime java.lang.process", _URL_LOW + ["removeWhitespace"], "CRITICAL", "rce", "Java process started from an argument"),
    _rule(944902, "java", 2, _ARGS + ["REQUEST_HEADERS"], "rx", r"\$[{\[]jndi:", _URL_LOW, "CRITICAL", "rce", "Name lookup"),
    _rule(950901, "leak-listing", 1, ["RESPONSE_BODY"], "rx", "<title>Index of /|<h1>Index of /", [], "ERROR", "outbound", "Directory listing"),
    _rule(950902, "leak-listing", 2, ["RESPONSE_STATUS"], "rx", "^5[0-9][0-9]$", [], "ERROR", "outbound", "Server error"),
    _rule(951901, "leak-sql", 1, ["RESPONSE_BODY"], "rx", r"ORA-[0-9]{5}|error in your SQL syntax", [], "CRITICAL", "sql_injection", "SQL error text"),
    _rule(952901, "leak-java", 1, ["RESPONSE_BODY"], "rx", r"java\.[a-z]+\.[A-Za-z]+Exception", [], "ERROR", "outbound", "Java error"),
    _rule(953901, "leak-php", 1, ["RESPONSE_BODY"], "rx", r"<b>(?:Warning|Fatal error)</b>:", [], "ERROR", "outbound", "PHP error"),
    _rule(954901, "leak-iis", 1, ["RESPONSE_BODY"], "contains", "Microsoft OLE DB Provider", [], "ERROR", "outbound", "IIS error"),
    _rule(955901, "web-shell", 1, ["RESPONSE_BODY"], "pmFromFile", "web-shells", [], "CRITICAL", "outbound", "Web shell"),
]

PHRASE_LISTS = {
    "scanner-agents": ["sqlmap", "nikto", "masscan", "wpscan", "dirbuster", "acunetix"],
    "web-shells": ["r57shell", "c99shell", "b374k", "uid=0(root)"],
}

# family number in the inventory -> family of the pack
FAMILIES = {
    "f01": "method", "f02": "scanner", "f03": "protocol", "f04": "protocol-attack", "f05": "multipart", "f06": "lfi",
    "f07": "rfi", "f08": "rce", "f09": "php", "f10": "generic", "f11": "xss", "f12": "sqli", "f13": "fixation",
    "f14": "java", "f15": "leak-listing", "f16": "leak-sql", "f17": "leak-java", "f18": "leak-php", "f19": "leak-iis",
    "f20": "web-shell",
}


def rules(spark: SparkSession, family: str | None = None) -> DataFrame:
    return spark.createDataFrame([r for r in PACK if family in (None, r["family"])], RULES)


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, p) for name, words in PHRASE_LISTS.items() for p in words], PHRASES)
