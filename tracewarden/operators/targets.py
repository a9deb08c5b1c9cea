"""The parts of a request that rules look at, as one long table ``(req_id, collection, name, value)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.features import header_values
from tracewarden.functions.transforms import apply_chain, url_decode

_EMPTY = "cast(array() as array<struct<collection: string, name: string, value: string>>)"


def _target(collection: str, name: Column, value: Column) -> Column:
    return F.struct(
        F.lit(collection).alias("collection"), name.cast("string").alias("name"), value.cast("string").alias("value")
    )


def _single(collection: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(_target(collection, F.lit(""), value))).otherwise(F.expr(_EMPTY))


def _pairs(text: Column) -> Column:
    """Decoded ``name``/``value`` structs of a query or form body."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), "&", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            url_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"),
            url_decode(F.regexp_replace(p, r"(?s)^[^=]*=?", "")).alias("value"),
        ),
    )


def _json_members(body: Column) -> Column:
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    return F.transform(
        entries, lambda e: F.struct(F.concat(F.lit("json."), e["key"]).alias("name"), e["value"].alias("value"))
    )


def _none_pairs() -> Column:
    return F.expr("cast(array() as array<struct<name: string, value: string>>)")


def _content_type(df_headers: Column) -> Column:
    return F.lower(F.coalesce(F.get(header_values(df_headers, "Content-Type"), F.lit(0)), F.lit("")))


def _get_args() -> Column:
    return _pairs(F.col("query"))


def _post_args() -> Column:
    kind, body = _content_type(F.col("headers")), F.col("body")
    return (
        F.when(kind.contains("application/x-www-form-urlencoded"), _pairs(body))
        .when(kind.contains("json") & body.rlike(r"^\s*\{"), F.coalesce(_json_members(body), _none_pairs()))
        .otherwise(_none_pairs())
    )


def _as(collection: str, pairs: Column, of_names: bool = False) -> Column:
    return F.transform(
        pairs, lambda p: _target(collection, p["name"], p["name"] if of_names else p["value"])
    )


def _cookies(of_names: bool) -> Column:
    raw = F.array_join(header_values(F.col("headers"), "Cookie"), "; ")
    pieces = F.filter(F.split(raw, ";", -1), lambda p: F.trim(p) != "")
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"),
            F.regexp_replace(p, r"(?s)^[^=]*=?", "").alias("value"),
        ),
    )
    return _as("REQUEST_COOKIES_NAMES" if of_names else "REQUEST_COOKIES", parsed, of_names)


def _headers(collection: str, headers: str) -> Column:
    per_name = F.transform(
        F.map_entries(F.col(headers)), lambda e: F.transform(e["value"], lambda v: _target(collection, e["key"], v))
    )
    return F.coalesce(F.flatten(per_name), F.expr(_EMPTY))


def _header_names() -> Column:
    return F.coalesce(
        F.transform(F.map_keys(F.col("headers")), lambda k: _target("REQUEST_HEADERS_NAMES", k, k)), F.expr(_EMPTY)
    )


def _basename() -> Column:
    return F.regexp_extract(F.col("path"), r"([^/\\]*)$", 1)


def _request_line() -> Column:
    return F.concat_ws(" ", "method", "uri", "protocol")


_BUILDERS: dict[str, Callable[[], Column]] = {
    "ARGS": lambda: F.concat(_as("ARGS", _get_args()), _as("ARGS", _post_args())),
    "ARGS_GET": lambda: _as("ARGS_GET", _get_args()),
    "ARGS_POST": lambda: _as("ARGS_POST", _post_args()),
    "ARGS_NAMES": lambda: F.concat(
        _as("ARGS_NAMES", _get_args(), True), _as("ARGS_NAMES", _post_args(), True)
    ),
    "REQUEST_COOKIES": lambda: _cookies(False),
    "REQUEST_COOKIES_NAMES": lambda: _cookies(True),
    "REQUEST_HEADERS": lambda: _headers("REQUEST_HEADERS", "headers"),
    "REQUEST_HEADERS_NAMES": _header_names,
    "REQUEST_METHOD": lambda: _single("REQUEST_METHOD", F.col("method")),
    "REQUEST_PROTOCOL": lambda: _single("REQUEST_PROTOCOL", F.col("protocol")),
    "REQUEST_URI": lambda: _single("REQUEST_URI", F.col("uri")),
    "REQUEST_FILENAME": lambda: _single("REQUEST_FILENAME", F.col("path")),
    "REQUEST_BASENAME": lambda: _single("REQUEST_BASENAME", _basename()),
    "REQUEST_LINE": lambda: _single("REQUEST_LINE", _request_line()),
    "QUERY_STRING": lambda: _single("QUERY_STRING", F.col("query")),
    "REQUEST_BODY": lambda: _single("REQUEST_BODY", F.when(F.col("body") != "", F.col("body"))),
    "REMOTE_ADDR": lambda: _single("REMOTE_ADDR", F.col("client_ip")),
    "RESPONSE_STATUS": lambda: _single("RESPONSE_STATUS", F.col("status")),
    "RESPONSE_HEADERS": lambda: _headers("RESPONSE_HEADERS", "response_headers"),
    "RESPONSE_BODY": lambda: _single("RESPONSE_BODY", F.col("response_body")),
}


COLLECTIONS = list(_BUILDERS)


@cache
def target_array(collection: str) -> Column:
    """Targets of one collection as an array. Expressions do not depend on a session, so each is built once."""
    return _BUILDERS[collection]()


def count_name(collection: str, name_filter: str | None) -> str:
    """The collection under which the number of targets of ``collection`` appears."""
    return f"&{collection}:{name_filter}" if name_filter else f"&{collection}"


def _named(targets: Column, pattern: str | None) -> Column:
    return F.filter(targets, lambda t: t["name"].rlike(pattern)) if pattern else targets


def _checked(collections) -> None:
    unknown = set(collections) - set(COLLECTIONS)
    if unknown:
        raise ValueError(f"unknown collections: {sorted(unknown)}")


def target_column(collections: list[str], counted: list[tuple[str, str | None]] = ()) -> Column:
    """All targets of the named collections as one array, and one element per counted collection."""
    _checked([*collections, *(c for c, _ in counted)])
    arrays = [target_array(c) for c in COLLECTIONS if c in set(collections)]
    for collection, pattern in counted:
        arrays.append(F.array(_target(count_name(collection, pattern), F.lit(""), F.size(_named(target_array(collection), pattern)))))
    return F.concat(*arrays) if arrays else F.expr(_EMPTY)


def explode_targets(
    requests: DataFrame, collections: list[str] | None = None, key: str = "req_id", counted: list[tuple[str, str | None]] = ()
) -> DataFrame:
    """One row per scanned value. Only the named collections are built, so unused columns are never read.

    ``counted`` adds one row per request with the number of targets of a collection, zero included, whose name matches a
    pattern where one is given.
    """
    wanted = COLLECTIONS if collections is None else collections
    targets = target_column(wanted, counted)
    if not wanted and not counted:
        return requests.select(key).withColumns({"collection": F.lit(""), "name": F.lit(""), "value": F.lit("")}).limit(0)
    return requests.select(key, F.explode(targets).alias("t")).select(
        key, F.col("t.collection").alias("collection"), F.col("t.name").alias("name"), F.col("t.value").alias("value")
    )


def with_counts(targets: DataFrame, counted: list[tuple[str, str | None]], key: str = "req_id") -> DataFrame:
    """``targets`` and, for every key in them, one row per counted collection; map-side sums, one shuffle by key."""
    if not counted:
        return targets
    here = lambda c, p: (F.col("collection") == c) & (F.col("name").rlike(p) if p else F.lit(True))
    counts = targets.groupBy(key).agg(*(F.count_if(here(c, p)).alias(f"__n{i}") for i, (c, p) in enumerate(counted)))
    rows = F.array(*(_target(count_name(c, p), F.lit(""), F.col(f"__n{i}")) for i, (c, p) in enumerate(counted)))
    counts = counts.select(key, F.explode(rows).alias("t")).select(key, "t.collection", "t.name", "t.value")
    return targets.select(key, "collection", "name", "value").unionByName(counts)


def normalise_targets(targets: DataFrame, chain: list[str], out: str = "normalised") -> DataFrame:
    """Add the value after a transform chain; narrow, so no value is moved to be normalised."""
    return targets.withColumn(out, apply_chain(F.col("value"), chain))


def count_targets(targets: DataFrame, keys: DataFrame, collection: str, name: str | None = None, key: str = "req_id") -> DataFrame:
    """``&COLLECTION``: values per request, zero for requests that have none."""
    chosen = targets.filter(F.col("collection") == collection)
    if name is not None:
        chosen = chosen.filter(F.lower("name") == name.lower())
    counts = chosen.groupBy(key).agg(F.count("*").alias("n"))
    return keys.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
