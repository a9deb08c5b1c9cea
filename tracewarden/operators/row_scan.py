"""Rule scan inside the request row: matches are an array of the row, so chains and scores need no shuffle.

The targets of a request are an array; every rule is a predicate over its elements. The links of a chain are evaluated in
their order, one projection per link: a link is looked at only where the link before it matched, and sees the texts
which earlier links captured, as targets (``TX:1``) or within its argument (``%{tx.1}``).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracewarden.functions import transforms as N
from tracewarden.functions.predicates import match
from tracewarden.operators import rule_forms as R
from tracewarden.operators.targets import target_column

_OF_RULE = {"rule_id": "int", "chain_link": "int", "pl": "int", "direction": "string", "phase": "int", "score_var": "string", "severity": "string"}
_RULE = "struct<" + ", ".join(f"{n}: {t}" for n, t in _OF_RULE.items()) + ">"
_MATCH = _RULE[:-1] + ", collection: string, name: string, value: string>"


def _empty() -> Column:
    return F.expr(f"cast(array() as array<{_MATCH}>)")


def _forms(targets: Column, rules: list[Row]) -> tuple[Column, dict[tuple[str, ...], str]]:
    """Targets with one field per transform chain in use; a chain goes on from the longest one it starts with."""
    wanted: dict[tuple[str, ...], set[str]] = {}
    for rule in rules:
        for chain in R.chains_of(rule):
            wanted.setdefault(chain, set()).update(R.collections_of(rule))
    fields = {chain: f"v{i}" for i, chain in enumerate(sorted(wanted))}
    done: list[tuple[str, ...]] = []
    for length in sorted({len(chain) for chain in wanted}):
        level = [chain for chain in wanted if len(chain) == length]

        def longer(t: Column) -> Column:
            parts = [t[n].alias(n) for n in ("collection", "name", "value", *(fields[c] for c in done))]
            for chain in level:
                starts = [c for c in done if chain[: len(c)] == c and wanted[chain] <= wanted[c]]
                base = max(starts, key=len, default=None)
                text, rest = (t["value"], chain) if base is None else (t[fields[base]], chain[len(base) :])
                there = t["collection"].isin(*sorted(wanted[chain]))
                parts.append(F.when(there, N.apply_chain(text, rest)).alias(fields[chain]))
            return F.struct(*parts)

        targets = F.transform(targets, longer)
        done += level
    return targets, fields


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _facts(rules: list[Row]) -> Column:
    """One literal array for the facts of all rules; a match looks its own up by the rule's place."""
    rows = [{n: r[n] if n != "chain_link" else r[n] or 0 for n in _OF_RULE} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE}>")


def _match(t: Column, facts: Column) -> Column:
    return F.struct(*(facts[n].alias(n) for n in _OF_RULE), *(t[n].alias(n) for n in ("collection", "name", "value")))


def _test(rule: Row, text: Column, lists: dict[str, list[str]], captured: Column) -> Column:
    if R.is_dynamic(rule):
        return R.match_dynamic(rule, text, captured)
    return match(rule["operator"], text, rule["argument"], bool(rule["negate"]), lists)


def _plain_matches(rules: list[Row], forms: Column, fields: dict[tuple[str, ...], str], lists: dict[str, list[str]]) -> Column:
    """Matches of rules without chains. An element meets the rules of its collection only."""
    none, facts = F.lit(None).cast("array<string>"), _facts(rules)
    by_rules: dict[tuple[int, ...], list[str]] = {}
    for name in sorted({c for rule in rules for c in R.collections_of(rule)}):
        by_rules.setdefault(tuple(i for i, rule in enumerate(rules) if name in R.collections_of(rule)), []).append(name)

    def found(t: Column) -> Column:
        def hit(place: int) -> Column:
            rule = rules[place]
            tests = [_test(rule, t[fields[chain]], lists, none) for chain in R.chains_of(rule)]
            return F.when(_all([*R.in_scope(rule, t["collection"], t["name"]), _any(tests)]), F.lit(place))

        hits = {place: hit(place) for place in range(len(rules))}
        arms = [F.when(t["collection"].isin(*names), F.array_compact(F.array(*(hits[i] for i in group)))) for group, names in by_rules.items()]
        places = F.coalesce(*arms, F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda place: _match(t, F.get(facts, place)))

    return F.flatten(F.transform(forms, found))


def _link(rule: Row, forms: Column, fields: dict[tuple[str, ...], str], lists: dict[str, list[str]], captured: Column) -> Column:
    """Targets that match one link, each with the text in which it matched."""
    chains = R.chains_of(rule)

    def hits(targets: Column, form) -> Column:
        def look(t: Column) -> Column:
            scope = R.in_scope(rule, t["collection"], t["name"])
            texts = [F.when(_test(rule, form(t, chain), lists, captured), form(t, chain)) for chain in chains]
            text = F.coalesce(*texts)
            there = _all([*scope, text.isNotNull()])
            return F.when(there, F.struct(*(t[n].alias(n) for n in ("collection", "name", "value")), text.alias("text")))

        return F.array_compact(F.transform(targets, look))

    numbers = R.captured_numbers(rule)
    own = [c for c in R.collections_of(rule) if not c.startswith("TX:")]
    parts = []
    if own:
        parts.append(hits(F.filter(forms, lambda t: t["collection"].isin(*own)), lambda t, chain: t[fields[chain]]))
    if numbers:
        texts = [F.struct(F.lit("TX").alias("collection"), F.lit(str(n)).alias("name"), F.get(captured, F.lit(n)).alias("value")) for n in numbers]
        parts.append(hits(F.filter(F.array(*texts), lambda t: t["value"].isNotNull()), lambda t, chain: N.apply_chain(t["value"], chain)))
    return F.concat(*parts)


def with_matches(requests: DataFrame, rules: list[Row], lists: dict[str, list[str]] | None = None, out: str = "matches") -> DataFrame:
    """``requests`` and an array of the matches that score: of plain rules, and of the last links of whole chains.

    Every match carries the level, direction, phase, score and severity of its rule; a chain has those of its last link.
    A chain whose links are not numbered 1 to n never matches. ``capture`` keeps the groups of the last text an ``rx`` link
    matched; later links see them until another link captures. A request without matches has an empty array.
    """
    lists = lists or {}
    for rule in rules:
        R.rule_code(rule["rule_id"], rule["chain_link"])
    plain = [r for r in rules if (r["chain_len"] or 1) <= 1]
    chains: dict[int, list[Row]] = {}
    for rule in rules:
        if (rule["chain_len"] or 1) > 1:
            chains.setdefault(rule["rule_id"], []).append(rule)
    chains = {i: sorted(links, key=lambda r: r["chain_link"]) for i, links in chains.items()}
    chains = {i: links for i, links in chains.items() if [r["chain_link"] for r in links] == list(range(1, links[0]["chain_len"] + 1))}
    if any(R.captured_numbers(rule) for rule in plain):
        raise ValueError("only a link of a chain can look at captured texts")
    used = [*plain, *(link for links in chains.values() for link in links)]
    if not used:
        return requests.withColumn(out, _empty())
    values = sorted({c for r in used if not r["is_count"] for c in r["collections"] if not c.startswith("TX:")})
    counted = sorted({(c, r["name_filter"]) for r in used if r["is_count"] for c in r["collections"]}, key=str)
    forms, fields = _forms(target_column(values, counted), used)
    rows = requests.withColumn("__forms", forms)
    forms = F.col("__forms")
    deepest = max((len(links) for links in chains.values()), default=0)
    none = F.lit(None).cast("array<string>")
    for depth in range(deepest):
        found, texts = {}, {}
        for number, links in enumerate(chains.values()):
            if depth >= len(links):
                continue
            link, before = links[depth], F.col(f"__h{number}")
            captured = F.col(f"__t{number}") if depth else none
            hits = _link(link, forms, fields, lists, captured)
            # size of null is null: after a link without a match the rest of its chain stays null
            found[f"__h{number}"] = F.when(F.size(before) > 0, hits) if depth else hits
            if link["capture"] and link["operator"] == "rx" and not link["negate"]:
                text = F.try_element_at(F.col(f"__h{number}"), F.lit(-1))["text"]
                texts[f"__t{number}"] = F.coalesce(F.when(text.isNotNull(), R.captured_texts(text, link["argument"])), captured)
            elif depth == 0:
                texts[f"__t{number}"] = none
        rows = rows.withColumns(found).withColumns(texts) if texts else rows.withColumns(found)
    parts = [_plain_matches(plain, forms, fields, lists)] if plain else []
    for number, links in enumerate(chains.values()):
        facts = F.get(_facts(links[-1:]), F.lit(0))
        parts.append(F.coalesce(F.transform(f"__h{number}", lambda h: _match(h, facts)), _empty()))
    rows = rows.withColumn(out, F.concat(*parts))
    return rows.drop("__forms", *(f"__{kind}{n}" for n in range(len(chains)) for kind in "ht"))


def explode_matches(rows: DataFrame, key: str = "req_id", matches: str = "matches") -> DataFrame:
    """The matches as rows, in the columns of ``rule_scan``."""
    flat = rows.select(key, F.explode(matches).alias("m"))
    return flat.select(key, *(F.col(f"m.{n}").alias(n) for n in ("rule_id", "chain_link", "collection", "name", "value")))
