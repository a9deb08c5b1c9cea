"""What a rule of the table asks: its collections, transform chains, scope, and texts that earlier links captured."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from tracewarden.functions import transforms as N
from tracewarden.functions.features import header
from tracewarden.operators.targets import COLLECTIONS, count_name, target_array

#: Links of a chain: the links seen are bits of one number.
MOST_LINKS = 31
#: Captured texts are kept under the numbers 0 (the whole match) to 9.
CAPTURES = 10

_MACRO = re.compile(r"%\{([^}]+)\}")


def rule_code(rule_id: int, link: int | None) -> int:
    if (link or 0) > MOST_LINKS:
        raise ValueError(f"rule {rule_id}: more than {MOST_LINKS} links in a chain")
    return rule_id * 100 + (link or 0)


def collections_of(rule: Row) -> list[str]:
    """The collections a rule looks at; a rule on counts looks at the counted collections instead of their values."""
    return [count_name(c, rule["name_filter"]) for c in rule["collections"]] if rule["is_count"] else rule["collections"]


def in_scope(rule: Row, collection: Column, name: Column) -> list[Column]:
    """Conditions on the target's name; the collection is settled by the dispatch."""
    if rule["is_count"]:
        return []
    scope = [name.rlike(rule["name_filter"])] if rule["name_filter"] else []
    return scope + [~((collection == out["collection"]) & name.rlike(out["name"])) for out in rule["excluded"] or ()]


def chains_of(rule: Row) -> list[tuple[str, ...]]:
    return N.chain_prefixes(rule["transforms"]) if rule["multi_match"] else [N.effective_chain(rule["transforms"])]


def captured_numbers(rule: Row) -> list[int]:
    """The captured texts a rule looks at: collections ``TX:1`` and the like."""
    return [int(c[3:]) for c in rule["collections"] if re.fullmatch("TX:[0-9]", c)]


def is_dynamic(rule: Row) -> bool:
    """Whether the argument names other parts of the request, or texts captured by an earlier link (``%{tx.1}``)."""
    return rule["operator"] != "rx" and bool(_MACRO.search(rule["argument"] or ""))


def uses_captures(rule: Row) -> bool:
    return is_dynamic(rule) or bool(captured_numbers(rule))


def group_count(pattern: str) -> int:
    """Capturing groups of a regular expression, at most as many as are kept."""
    plain = re.sub(r"\\Q.*?\\E|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return min(len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain)), CAPTURES - 1)


def captured_texts(value: Column, pattern: str) -> Column:
    """Texts of the groups 0 to 9 of the first place where the pattern matches; a group that took no part is empty."""
    groups = [F.regexp_extract(value, pattern, g) for g in range(group_count(pattern) + 1)]
    return F.array(*groups, *[F.lit("")] * (CAPTURES - len(groups)))


def _request_part(name: str, captured: Column) -> Column:
    collection, _, part = name.partition(".")
    collection = collection.upper()
    if collection == "TX":
        if not re.fullmatch("[0-9]", part):
            raise ValueError(f"unknown variable: {name}")
        return F.get(captured, F.lit(int(part)))
    if collection not in COLLECTIONS:
        raise ValueError(f"unknown variable: {name}")
    if collection == "REQUEST_HEADERS" and part:
        return header(F.col("headers"), part)
    targets = target_array(collection)
    if part:
        targets = F.filter(targets, lambda t: F.lower(t["name"]) == part.lower())
    return F.get(targets, F.lit(0))["value"]


def expanded(argument: str, captured: Column) -> Column:
    """The argument with each ``%{…}`` replaced by the first value of that name; a part that is absent is empty text."""
    pieces = []
    for i, piece in enumerate(_MACRO.split(argument)):
        pieces.append(F.coalesce(_request_part(piece, captured), F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*pieces)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


_DYNAMIC: dict[str, Callable[[Column, Column], Column]] = {
    "streq": lambda v, a: v == a,
    "contains": F.contains,
    "endsWith": F.endswith,
    "beginsWith": F.startswith,
    "within": lambda v, a: F.contains(a, v),
    "eq": lambda v, a: _number(v) == _number(a),
    "lt": lambda v, a: _number(v) < _number(a),
    "gt": lambda v, a: _number(v) > _number(a),
    "ge": lambda v, a: _number(v) >= _number(a),
    "le": lambda v, a: _number(v) <= _number(a),
}


def match_dynamic(rule: Row, value: Column, captured: Column) -> Column:
    """Predicate whose argument differs from request to request; null values never match."""
    if rule["operator"] not in _DYNAMIC:
        raise ValueError(f"rule {rule['rule_id']}: {rule['operator']} takes no argument from the request")
    hit = _DYNAMIC[rule["operator"]](value, expanded(rule["argument"], captured))
    return F.coalesce(~hit if rule["negate"] else hit, F.lit(False)) & value.isNotNull()
