"""Rule scan: match every target against every rule of its collection.

A rule table is known when the job is planned, so it is compiled into projections: each transform chain is applied once
per value, each rule becomes a predicate with a literal pattern (compiled once per task, not once per value), and the
matching rules come out of one ``explode``. Targets are neither shuffled nor joined. A projection holds a batch of rules;
a larger table is the union of several, each by the same code, so any number of rules gives the same matches.

Only so many rules and phrases are compiled. Beyond that, phrase rules are found by joins with an inverted index
(``phrase_index``), with the same matches; other rules must be compiled, and too many of them are an error.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracewarden.config import ScanConfig
from tracewarden.functions import transforms as N
from tracewarden.functions.features import header, header_values
from tracewarden.functions.predicates import match
from tracewarden.operators import scoring
from tracewarden.operators.phrase_index import is_phrase_rule, phrase_rule_scan
from tracewarden.operators.row_scan import explode_matches, with_matches
from tracewarden.operators.rule_forms import chains_of, collections_of, in_scope, rule_code, uses_captures
from tracewarden.operators.targets import COLLECTIONS, explode_targets, with_counts
from tracewarden.session import bounded_rows

#: Rules of one projection.
RULE_BATCH = 2000
#: Rules that are compiled, and listed phrases that become literals. Beyond either, phrase rules go through the index.
MOST_COMPILED = 10_000
MOST_LITERALS = 10_000


def rules_for(rules: DataFrame, config: ScanConfig) -> DataFrame:
    """Rules of the configured detection level."""
    return rules.filter(F.col("pl") <= config.check().detection_level)


def exclude_rules(
    rules: DataFrame, ids: list[int] = (), tags: list[str] = (), targets: list[tuple[int, str, str]] = ()
) -> DataFrame:
    """Switch rules off by id or tag, or take one target (rule id, collection, name pattern) out of a rule."""
    if ids:
        rules = rules.filter(~F.col("rule_id").isin(*ids))
    if tags:
        rules = rules.filter(~F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    kind = "array<struct<collection: string, name: string>>"
    for rule_id, collection, name in targets:
        extra = F.array(F.struct(F.lit(collection).alias("collection"), F.lit(name).alias("name")))
        merged = F.concat(F.coalesce("excluded", F.expr(f"cast(array() as {kind})")), extra)
        rules = rules.withColumn("excluded", F.when(F.col("rule_id") == rule_id, merged).otherwise(F.col("excluded")))
    return rules


def phrase_lists(phrases: DataFrame | None) -> dict[str, list[str]]:
    """Phrases by list name, at most ``MOST_LITERALS``; they become literals of the plan, as the rules do."""
    lists: dict[str, list[str]] = {}
    for row in bounded_rows(phrases.filter("phrase IS NOT NULL"), MOST_LITERALS, "literal phrases") if phrases is not None else ():
        lists.setdefault(row["list_name"], []).append(row["phrase"])
    return lists


def split_rules(rules: DataFrame, phrases: DataFrame | None) -> tuple[list[Row], dict[str, list[str]], DataFrame | None]:
    """Rules to compile, their phrase lists, and the rules for the phrase index, if there are too many to compile.

    All rules are compiled while they and the listed phrases are few. Otherwise rules that look for phrases leave the
    plan; lists named by a negated rule stay literals.
    """
    few = rules.limit(MOST_COMPILED + 1).collect()
    listed = phrases is not None and any(r["operator"] == "pmFromFile" for r in few)
    if len(few) <= MOST_COMPILED and not (listed and len(phrases.select("list_name").take(MOST_LITERALS + 1)) > MOST_LITERALS):
        return few, phrase_lists(phrases) if listed else {}, None
    rest = bounded_rows(rules.filter(~F.coalesce(is_phrase_rule(), F.lit(False))), MOST_COMPILED, "rules other than phrase rules")
    named = sorted({name for r in rest if r["operator"] == "pmFromFile" for name in r["argument"].split()})
    lists = phrase_lists(phrases.filter(F.col("list_name").isin(*named))) if named and phrases is not None else {}
    handed = {r["rule_id"] for r in rest if uses_captures(r)}
    indexed = rules.filter(is_phrase_rule())
    if handed and indexed.filter(F.col("rule_id").isin(*handed)).take(1):
        raise ValueError("a chain that hands captured texts on cannot name phrase lists beyond the literal ones")
    return rest, lists, indexed


@cache
def _normalised(column: str, chain: tuple[str, ...]) -> Column:
    return N.apply_chain(F.col(column), chain)


def compile_scan(targets: DataFrame, rules: list[Row], phrases: dict[str, list[str]], key: str = "req_id") -> DataFrame:
    """``rule_scan`` with the rules already on the driver; used by the streaming form as well."""
    if any(uses_captures(rule) for rule in rules):
        raise ValueError("rules that use other parts of the request or captured texts need scan_requests")
    scanned: dict[tuple[str, ...], set[str]] = {}
    for rule in rules:
        for chain in chains_of(rule):
            scanned.setdefault(chain, set()).update(collections_of(rule))
    columns = {chain: f"__v{i}" for i, chain in enumerate(scanned)}
    used = sorted({c for rule in rules for c in collections_of(rule)})
    # longest shared prefix first: a chain starts from the column of its own prefix when that one is there for it
    prepared = targets.filter(F.col("collection").isin(*used))
    for chain in sorted(scanned, key=len):
        wanted = F.col("collection").isin(*sorted(scanned[chain]))
        base, rest = "value", chain
        for cut in range(len(chain) - 1, 0, -1):
            if chain[:cut] in columns and scanned[chain] <= scanned[chain[:cut]]:
                base, rest = columns[chain[:cut]], chain[cut:]
                break
        prepared = prepared.withColumn(columns[chain], F.when(wanted, _normalised(base, rest)))
    hits = []
    for rule in rules:
        tests = [
            match(rule["operator"], F.col(columns[chain]), rule["argument"], bool(rule["negate"]), phrases)
            for chain in chains_of(rule)
        ]
        code = F.lit(rule_code(rule["rule_id"], rule["chain_link"])).cast("long")
        conditions = [*in_scope(rule, F.col("collection"), F.col("name")), reduce(lambda a, b: a | b, tests)]
        hits.append(F.when(reduce(lambda a, b: a & b, conditions), code))
    # a target is tested against the rules of its own collection only; collections with the same rules share an array
    by_rules: dict[tuple[int, ...], list[str]] = {}
    for name in used:
        by_rules.setdefault(tuple(i for i, rule in enumerate(rules) if name in collections_of(rule)), []).append(name)
    codes = F.coalesce(
        *[
            F.when(F.col("collection").isin(*names), F.array_compact(F.array(*[hits[i] for i in group])))
            for group, names in by_rules.items()
        ]
    )
    return prepared.select(key, "collection", "name", "value", F.explode(codes).alias("code")).select(
        key,
        F.floor(F.col("code") / 100).cast("int").alias("rule_id"),
        F.pmod("code", F.lit(100)).cast("int").alias("chain_link"),
        "collection",
        "name",
        "value",
    )


def _scan_batches(targets: DataFrame, rules: list[Row], phrases: dict[str, list[str]], key: str, batch: int) -> DataFrame:
    parts = [compile_scan(targets, rules[at : at + batch], phrases, key) for at in range(0, len(rules), batch)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_scan(targets: DataFrame, rules: DataFrame, phrases: DataFrame | None = None, key: str = "req_id", batch: int = RULE_BATCH) -> DataFrame:
    """``(req_id, rule_id, chain_link, collection, name, value)``, one row per rule and matching target.

    Rules on counts (``is_count``) compare how many targets of a collection, by name where ``name_filter`` is set, a key
    has; the keys are those that have any target in ``targets``. Unknown operators are an error.
    """
    found, lists, indexed = split_rules(rules, phrases)
    counted = _counted(found)
    parts = [] if indexed is None else [phrase_rule_scan(targets, indexed, phrases, key)]
    if found:
        parts.append(_scan_batches(with_counts(targets, counted, key), found, lists, key, batch))
    if not parts:
        return targets.limit(0).select(
            key, F.lit(0).alias("rule_id"), F.lit(0).alias("chain_link"), "collection", "name", "value"
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counted(rules: list[Row]) -> list[tuple[str, str | None]]:
    return sorted({(c, r["name_filter"]) for r in rules if r["is_count"] for c in r["collections"]}, key=str)


def scan_requests(requests: DataFrame, rules: DataFrame, phrases: DataFrame | None = None, config: ScanConfig = ScanConfig(), key: str = "req_id") -> DataFrame:
    """Gate, explode, scan and complete chains: the matches that score."""
    chosen = rules_for(rules, config)
    gated = response_gate(scan_gate(requests, config, key), config)
    if config.skip_response:
        chosen = chosen.filter(F.col("direction") != "outbound")
    found, lists, indexed = split_rules(chosen, phrases)
    parts = []
    # chains that hand a captured text on are followed inside the request row
    handed = {r["rule_id"] for r in found if uses_captures(r)}
    if handed:
        parts.append(explode_matches(with_matches(gated, [r for r in found if r["rule_id"] in handed], lists), key))
        found = [r for r in found if r["rule_id"] not in handed]
    if indexed is not None:
        collections = [r[0] for r in indexed.select(F.explode("collections")).distinct().limit(len(COLLECTIONS) + 1).collect()]
        parts.append(phrase_rule_scan(explode_targets(gated, sorted(collections), key), indexed, phrases, key))
    if found:
        # the rules are on the driver: their collections and chains need no further jobs
        plain = sorted({c for r in found if not r["is_count"] for c in r["collections"]})
        parts.append(_scan_batches(explode_targets(gated, plain, key, _counted(found)), found, lists, key, RULE_BATCH))
    if not parts:
        return rule_scan(explode_targets(gated, None, key), chosen, phrases, key)
    matches = reduce(lambda a, b: a.unionByName(b), parts)
    chained = indexed is not None or any((r["chain_len"] or 1) > 1 for r in found)
    return complete_chains(matches, chosen.filter(~F.col("rule_id").isin(*handed)), key) if chained else matches


def score_in_rows(requests: DataFrame, rules: DataFrame, phrases: DataFrame | None = None, config: ScanConfig = ScanConfig(), key: str = "req_id") -> DataFrame:
    """Key and scores of every request, as ``complete_scores`` of ``score_requests`` of ``scan_requests`` gives them.

    Matches stay in the request's row, so nothing shuffles; only if phrase rules must go through the index, their matches
    are brought together by request. Each row is scored by itself, so the key should be unique.
    """
    chosen = rules_for(rules, config)
    if config.skip_response:
        chosen = chosen.filter(F.col("direction") != "outbound")
    found, lists, indexed = split_rules(chosen, phrases)
    if indexed is not None:
        scores = scoring.score_requests(scan_requests(requests, rules, phrases, config, key), rules, config, key)
        return scoring.complete_scores(requests, scores, key).select(key, *scoring.SCORE_COLUMNS)
    rows = with_matches(response_gate(requests, config), found, lists, "__matches")
    none = F.slice("__matches", 1, 0)
    rows = rows.withColumn("__matches", F.when(_looked_at(requests, config, key), F.col("__matches")).otherwise(none))
    return scoring.score_rows(rows, config, "__matches").select(key, *scoring.SCORE_COLUMNS)


def complete_chains(matches: DataFrame, rules: DataFrame, key: str = "req_id") -> DataFrame:
    """Keep plain matches, and matches of the last link of chains whose links all matched in the request.

    The scan is read once: matches are brought together by request, where the seen links of each rule are a bit mask.
    Aggregations by request that follow reuse this partitioning.
    """
    lengths = rules.filter(F.col("chain_len") > 1).select("rule_id", F.col("chain_len").alias("__len")).distinct()
    in_request = Window.partitionBy(key, "rule_id")
    seen = F.bit_or(F.expr("shiftleft(1, greatest(chain_link - 1, 0))")).over(in_request)
    whole = (F.col("__seen") == F.expr("shiftleft(1, __len) - 1")) & (F.col("chain_link") == F.col("__len"))
    return (
        matches.join(lengths, "rule_id", "left")
        .repartition(key)
        .withColumn("__seen", seen)
        .filter(F.col("__len").isNull() | whole)
        .select(matches.columns)
    )


def capture_chain(first: DataFrame, second: DataFrame, condition: Column, key: str = "req_id") -> DataFrame:
    """Two links that share a captured text: ``first`` carries ``captured``, the condition may use it."""
    return second.join(first.select(key, "captured"), key).filter(condition).drop("captured").distinct()


def exclude_targets(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop matches on targets a rule must not look at: (rule_id, collection, name pattern)."""
    x = excluded.select(
        F.col("rule_id").alias("x_rule"), F.col("collection").alias("x_collection"), F.col("name").alias("x_name")
    )
    same = (F.col("rule_id") == F.col("x_rule")) & (F.col("collection") == F.col("x_collection"))
    return matches.join(x, same & F.rlike(F.col("name"), F.col("x_name")), "left_anti")


def apply_exclusions(matches: DataFrame, rules: DataFrame, exclusions: DataFrame, key: str = "req_id") -> DataFrame:
    """Run-time exclusions of single requests: by rule id, by tag, or by rule or tag and target.

    ``exclusions`` has the key column and scope, rule_id, tag, collection, name; tags are resolved to rule ids first, so
    what remains is an anti join on request and rule.
    """
    by_id = exclusions.filter(F.col("rule_id").isNotNull()).select(key, "rule_id", "collection", "name")
    tagged = rules.select(F.col("rule_id"), F.explode("tags").alias("tag")).distinct()
    by_tag = (
        exclusions.filter(F.col("rule_id").isNull()).drop("rule_id").join(tagged, "tag").select(key, "rule_id", "collection", "name")
    )
    x = by_id.unionByName(by_tag).distinct().withColumnsRenamed(
        {key: "x_key", "rule_id": "x_rule", "collection": "x_collection", "name": "x_name"}
    )
    whole = F.col("x_collection").isNull()
    target = (F.col("x_collection") == F.col("collection")) & (
        F.col("x_name").isNull() | F.rlike(F.col("name"), F.col("x_name"))
    )
    on = (F.col(key) == F.col("x_key")) & (F.col("rule_id") == F.col("x_rule")) & (whole | target)
    return matches.join(x, on, "left_anti")


def is_internal(requests: DataFrame) -> Column:
    """Requests of the server itself: a bare ``GET /`` or the internal client, both from the loop-back address."""
    local = F.col("client_ip").isin("127.0.0.1", "::1")
    bare = (F.col("method") == "GET") & (F.col("uri") == "/") & F.coalesce(F.col("protocol"), F.lit("")).isin("")
    agent = F.coalesce(header(F.col("headers"), "User-Agent"), F.lit("")).endswith("(internal dummy connection)")
    line = F.concat_ws(" ", "method", "uri", "protocol").rlike(r"^(?:GET /|OPTIONS \*) HTTP/[12]\.[01]$")
    return F.coalesce(local & (bare | (agent & line)), F.lit(False))


def sampled(key: Column, pct: int) -> Column:
    """Deterministic sample: the first two decimal digits in the sha1 of the id are below ``pct``."""
    digest = F.sha1(key.cast("string"))
    pattern = r"^[a-f]*([0-9])[a-f]*([0-9])"
    number = F.concat(F.regexp_extract(digest, pattern, 1), F.regexp_extract(digest, pattern, 2))
    return F.when(number != "", number.try_cast("int") < pct).otherwise(F.lit(True))


def sample_requests(requests: DataFrame, pct: int, key: str = "req_id") -> DataFrame:
    return requests if pct >= 100 else requests.filter(sampled(F.col(key), pct))


def _looked_at(requests: DataFrame, config: ScanConfig, key: str) -> Column:
    """Requests that are scanned: none of the server itself, and the sample."""
    chosen = ~is_internal(requests)
    return chosen if config.sampling_pct >= 100 else chosen & sampled(F.col(key), config.sampling_pct)


def scan_gate(requests: DataFrame, config: ScanConfig, key: str = "req_id") -> DataFrame:
    return requests.filter(_looked_at(requests, config, key))


def is_compressed(headers: Column) -> Column:
    values = F.lower(F.array_join(header_values(headers, "Content-Encoding"), ","))
    return F.coalesce(values.rlike("gzip|compress|deflate|br|zstd"), F.lit(False))


def response_gate(requests: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Blank the response body where it must not be scanned: switched off, or sent compressed. A narrow projection."""
    if "response_body" not in requests.columns:
        return requests
    hidden = F.lit(True) if config.skip_response else is_compressed(F.col("response_headers"))
    return requests.withColumn("response_body", F.when(~hidden, F.col("response_body")))
