"""Projections of request records: URI, headers, addresses, labels, matched rules, score messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.features import header_values

# Header columns of the flat audit row, by header name.
NAMED_HEADERS = {
    "User-Agent": "UserAgent",
    "Referer": "Referer",
    "Accept-Encoding": "AcceptEncoding",
    "Content-Type": "ContentType",
    "Accept": "Accept",
    "Cookie": "Cookie",
    "Connection": "Connection",
}


def header_map(headers: dict[str, Column]) -> Column:
    """``map<name, array<value>>`` from optional value arrays; null arrays leave the header out."""
    pairs = [v for name, values in headers.items() for v in (F.lit(name), values.cast("array<string>"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def uri_path(uri: Column) -> Column:
    """Path of an absolute URL or of an origin-form URI."""
    return F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def uri_query(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)


def uri_host(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def split_uri(df: DataFrame, uri: str = "uri") -> DataFrame:
    return df.withColumns({"path": uri_path(F.col(uri)), "query": uri_query(F.col(uri))})


def categorise_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Seven named header columns (values joined ``, ``) and a map of the remaining headers."""
    named = {
        column: F.array_join(header_values(F.col(headers), name), ", ") for name, column in NAMED_HEADERS.items()
    }
    known = [n.lower() for n in NAMED_HEADERS]
    rest = F.map_filter(F.col(headers), lambda k, _: ~F.lower(k).isin(*known))
    return df.withColumns({**named, "other_headers": rest})


def flatten_headers(headers: Column) -> Column:
    """``name:v1,v2; name2:v`` sorted by name."""
    lines = F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))
    )
    return F.coalesce(F.array_join(F.array_sort(lines), "; "), F.lit(""))


def host_of(address: Column) -> Column:
    """Host part of ``host:port``, ``[v6]:port`` or a bare host."""
    return F.when(address.startswith("["), F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(address, r"^([^:]*)", 1)
    )


def port_of(address: Column, default: int = 80) -> Column:
    return F.coalesce(F.regexp_extract(address, r":([0-9]+)$", 1).try_cast("int"), F.lit(default))


def split_host_port(df: DataFrame, address: str, host: str, port: str, default: int = 80) -> DataFrame:
    return df.withColumns({host: host_of(F.col(address)), port: port_of(F.col(address), default)})


def stamp_labels(df: DataFrame, verdict: str, attack_type: str) -> DataFrame:
    """Mark every row of a recording with the labels of the recording."""
    return df.withColumns(
        {"AIVerdictLabel": F.lit(verdict), "AIVulnerabilityTypeLabel": F.lit(attack_type)}
    )


def explode_matched_rules(flat: DataFrame, key: str = "TransactionID") -> DataFrame:
    """One row per matched rule of a flat audit row: the i-th id with the i-th message."""
    ids = F.split(F.col("MatchedRulesIDs"), ";", -1)
    messages = F.split(F.col("MatchedRulesMessages"), ";", -1)
    zipped = F.arrays_zip(ids.alias("rule_id"), messages.alias("message"))
    return (
        flat.filter(F.col("MatchedRulesIDs") != "")
        .select(key, F.posexplode(zipped).alias("pos", "rule"))
        .select(key, "pos", F.col("rule.rule_id").alias("rule_id"), F.col("rule.message").alias("message"))
    )


# Names and order of the category scores in the report line.
REPORT_CATEGORIES = {
    "SQLI": "sql_injection",
    "XSS": "xss",
    "RFI": "rfi",
    "LFI": "lfi",
    "RCE": "rce",
    "PHPI": "php_injection",
    "HTTP": "http_violation",
    "SESS": "session_fixation",
}


def parse_score_message(df: DataFrame, message: str) -> DataFrame:
    """Read the scores back from a report line; null where the line holds none."""
    text = F.col(message)

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("int")

    out: dict[str, Column] = {}
    for side in ("inbound", "outbound"):
        head = rf"\({side.capitalize()} Scores: "
        out[f"{side}_blocking"] = number(head + r"blocking=([0-9]+)")
        out[f"{side}_detection"] = number(head + r"blocking=[0-9]+, detection=([0-9]+)")
        for level in range(1, 5):
            skip = "[0-9]+-" * (level - 1)
            out[f"{side}_pl{level}"] = number(head + rf"[^)]*per_pl={skip}([0-9]+)")
        out[f"{side}_threshold"] = number(head + r"[^)]*threshold=([0-9]+)")
    for short, name in REPORT_CATEGORIES.items():
        out[f"{name}_score"] = number(rf"\b{short}=([0-9]+)")
    out["combined_score"] = number(r"COMBINED_SCORE=([0-9]+)")
    return df.withColumns(out)


def union_audit(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; a column missing on one side becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
