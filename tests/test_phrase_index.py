"""Phrase lists of any length, against plain containment and against the compiled plan."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import phrase_index, scan
from tracewarden.plans import rule_pack
from tracewarden.schemas import PHRASES, RULES

COLUMNS = ["req_id", "rule_id", "chain_link", "collection", "name", "value"]


def _found(spark, texts, phrases):
    rows = spark.createDataFrame(texts, "text_id long, text string").withColumn("text", phrase_index.folded(F.col("text")))
    listed = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    found = phrase_index.find_phrases(rows, listed).collect()
    assert len(found) == len({(r[0], bytes(r[1])) for r in found})
    return {(r["text_id"], bytes(r["phrase"]).decode()) for r in found}


def _contained(texts, phrases):
    return {(i, p.lower()) for i, t in texts for p in phrases if t is not None and p is not None and p.lower() in t.lower()}


def test_phrases_of_all_lengths_and_places(spark):
    """Short, long and overlapping phrases, at either end, across chunks, in long and empty texts, with nulls and repeats."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcé", k=n))
    texts = [(i, word(rng.randrange(0, 40))) for i in range(60)]
    long = word(5000)
    texts += [(100, long), (101, "x" * 255 + "needle"), (102, "x" * 253 + "needle" + "x" * 300), (103, ""), (104, None), (105, "NEEDLE")]
    phrases = ["needle", "Needle", "a", "é", "ab", "abc", "", None, long[100:900], long[:3000], long[-300:], "y" * 700, "aaaa", "needle"]
    phrases += [word(n) for n in (3, 4, 5, 6, 7) for _ in range(30)]
    assert _found(spark, texts, phrases) == _contained(texts, phrases)
    assert _found(spark, texts, [p for p in phrases if p and len(p.encode()) > 4]) == _contained(texts, [p for p in phrases if p and len(p.encode()) > 4])


def test_nothing_listed_and_nothing_to_search(spark):
    assert _found(spark, [(1, "abc")], []) == set() == _found(spark, [], ["abc"])
    assert _found(spark, [(1, "abc")], [None]) == set()


def test_bits_never_hide_a_phrase(spark, monkeypatch):
    """A full bit table only lets more through."""
    monkeypatch.setattr(phrase_index, "WORD_BITS", 1)
    rng = random.Random(2)
    phrases = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = [(i, "".join(rng.choices("abcdefgh", k=300))) for i in range(20)]
    assert _found(spark, texts, phrases) == _contained(texts, phrases)


def _rule(number, operator, argument, collections=("ARGS",), transforms=(), **extra):
    return rule_pack._rule(990000 + number, "phrases", 1, list(collections), operator, argument, list(transforms), "NOTICE", "inbound", operator, **extra)


def _targets(spark):
    rng = random.Random(4)
    values = ["Has%20Alpha and beta", "gamma", "none", None, "", "ALPHA", "del/**/ta"]
    rows = [(i, rng.choice(["ARGS", "REQUEST_URI", "REQUEST_HEADERS"]), rng.choice(["q", "note", "User-Agent"]), rng.choice(values)) for i in range(300)]
    return spark.createDataFrame([*rows, *rows[:40], rows[0]] + [(7, "ARGS", "q", "alpha gamma")] * 5, "req_id long, collection string, name string, value string")


RULE_ROWS = [
    _rule(1, "pm", "alpha gamma"),
    _rule(2, "pmFromFile", "one two", ["ARGS", "REQUEST_URI"], ["urlDecodeUni", "lowercase"]),
    _rule(3, "pmFromFile", "two", ["REQUEST_HEADERS"], name_filter="^User"),
    _rule(4, "pmFromFile", "one", ["ARGS", "REQUEST_URI"], ["urlDecodeUni", "replaceComments", "removeWhitespace"], multi_match=True),
    _rule(5, "pmFromFile", "one", negate=True),
    _rule(6, "pm", "alpha", ["ARGS", "REQUEST_HEADERS"], excluded=[("ARGS", "^note$")]),
    _rule(7, "pmFromFile", "no-such-list"),
    _rule(8, "rx", "^g"),
    _rule(9, "ge", "1", is_count=True),
    _rule(10, "pm", "beta", ["ARGS"], ["urlDecodeUni"], chain_link=2, chain_len=2),
]
LISTS = [("one", "alpha"), ("one", "has alpha"), ("two", "Beta"), ("two", "gam"), ("one", "delta"), ("one", "alpha"), ("two", None), ("unused", "n")]


def _plain(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS).collect())


def test_same_matches_as_the_compiled_plan(spark, monkeypatch):
    """All kinds of phrase rules, targets that are there several times, names and values that are null."""
    rules, lists, targets = spark.createDataFrame(RULE_ROWS, RULES), spark.createDataFrame(LISTS, PHRASES), _targets(spark)
    compiled = scan.rule_scan(targets, rules, lists)
    expected = _plain(compiled)
    assert {r[1] for r in expected} == {str(990000 + n) for n in (1, 2, 3, 4, 5, 6, 8, 9, 10)}
    monkeypatch.setattr(scan, "MOST_LITERALS", 7)
    indexed = scan.rule_scan(targets, rules, lists)
    assert _plain(indexed) == expected
    assert dict(indexed.dtypes) == dict(compiled.dtypes)
    assert scan.rule_scan(targets.limit(0), rules, lists).count() == 0


def test_two_hundred_thousand_phrases(spark, monkeypatch):
    """The words of a large list occur in a few texts; rules beyond the limit, one list each, are found as well."""
    phrases = spark.range(200_000).select(F.concat(F.lit("l"), F.col("id") % 3).alias("list_name"), F.concat(F.lit("Phrase-"), F.sha1(F.col("id").cast("string"))).alias("phrase"))
    planted = phrases.filter(F.xxhash64("phrase") % 2000 == 0).select("list_name", "phrase").collect()
    texts = [(i, "ARGS", "q", f"some text {p['phrase'].upper()} phrase-0123") for i, p in enumerate(planted)] + [(9999, "ARGS", "q", "phrase-" * 50)]
    targets = spark.createDataFrame(texts, "req_id long, collection string, name string, value string")
    rules = spark.createDataFrame([_rule(n, "pmFromFile", f"l{n}") for n in range(3)] + [_rule(3, "pmFromFile", "l0 l1 l2")], RULES)
    got = sorted((r["req_id"], r["rule_id"]) for r in scan.rule_scan(targets, rules, phrases).collect())
    assert len(planted) > 50
    assert got == sorted((i, 990000 + n) for i, p in enumerate(planted) for n in (int(p["list_name"][1]), 3))


def test_a_table_of_many_rules(spark, monkeypatch):
    monkeypatch.setattr(scan, "MOST_COMPILED", 20)
    rules = spark.createDataFrame([_rule(n, "pm", f"word{n}x other{n}x") for n in range(300)] + [_rule(900, "rx", "word1x")], RULES)
    targets = spark.createDataFrame([(n, "ARGS", "q", f"a WORD{n}x, other{n + 1}x") for n in range(300)], "req_id long, collection string, name string, value string")
    got = sorted((r["req_id"], r["rule_id"]) for r in scan.rule_scan(targets, rules).collect())
    assert got == sorted([(n, 990000 + m) for n in range(300) for m in (n, n + 1) if m < 300])
    with pytest.raises(ValueError, match="other than phrase rules"):
        scan.rule_scan(targets, spark.createDataFrame([_rule(n, "rx", "a") for n in range(30)], RULES))


def test_links_beyond_the_mask_are_an_error(spark):
    rules = spark.createDataFrame([_rule(1, "rx", "a", chain_link=40, chain_len=40)], RULES)
    with pytest.raises(ValueError, match="links"):
        scan.rule_scan(_targets(spark), rules)


def test_texts_of_one_list_are_not_gathered_by_it(spark, monkeypatch):
    """All texts that hold a phrase of the one list used to meet its rule in one task of a sort-merge join (F13)."""
    rule = dict(rule_pack._rule(990021, "operators", 1, ["ARGS"], "pmFromFile", "long short", [], "NOTICE", "inbound", "x"))
    rules = spark.createDataFrame([rule, {**rule, "rule_id": 990022, "argument": "short"}], RULES)
    listed = spark.createDataFrame([("long", "ab"), ("long", "b c"), ("short", "c"), ("short", "b c"), ("other", "x")], PHRASES)
    rows = [(i % 40, "ARGS", "n", ["zab", "b c", "xx", "C", "", None, "x"][i % 7]) for i in range(200)]
    targets = spark.createDataFrame(rows, "req_id long, collection string, name string, value string")
    want = []
    for r in rows:
        long, short = ("ab" in (r[3] or "") or "b c" in (r[3] or "")), "c" in (r[3] or "").lower()
        want += [(r[0], 990021, r[3])] * (long or short) + [(r[0], 990022, r[3])] * short
    for most in (10_000, 0):  # rules sent to every task, and joined with parts of the texts
        monkeypatch.setattr(phrase_index, "MOST_SENT", most)
        scanned = phrase_index.phrase_rule_scan(targets, rules, listed)
        assert sorted((r["req_id"], r["rule_id"], r["value"]) for r in scanned.collect()) == sorted(want)
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chain" not in plan.replace("hashpartitioning(chain#", "hashpartitioning(chain") or "salt" in plan
