"""Matches, chains with captured texts and scores inside the request row."""

import pytest
from pyspark.sql import functions as F

from tracewarden.config import ScanConfig
from tracewarden.operators import rule_forms, row_scan, scan, scoring
from tracewarden.plans import rule_pack, views
from tracewarden.schemas import RULES
from tracewarden.streaming import streams

COLUMNS = ["req_id", "rule_id", "chain_link", "collection", "name", "value"]


def _link(number, link, of, collection, operator, argument, transforms=(), **extra):
    return rule_pack._rule(990000 + number, "chains", 1, [collection], operator, argument, list(transforms), "NOTICE", "inbound", "m", chain_id=990000 + number, chain_link=link, chain_len=of, **extra)


def _requests(spark, rows):
    """``(req_id, query, headers)`` as requests with every column that targets are built from."""
    df = spark.createDataFrame(rows, "req_id long, query string, headers map<string, array<string>>")
    texts = {c: F.lit("") for c in ("method", "uri", "path", "protocol", "body", "response_body")}
    return df.withColumns({**texts, "client_ip": F.lit("10.0.0.1"), "status": F.lit(200), "response_headers": F.col("headers")})


def _ids(requests, rules, spark):
    return sorted((r["req_id"], r["rule_id"] - 990000, r["collection"], r["name"], r["value"]) for r in scan.scan_requests(requests, spark.createDataFrame(rules, RULES)).collect())


def _site(referer, host):
    return {k: [v] for k, v in (("Referer", referer), ("Host", host)) if v is not None}


def test_captured_text_reaches_the_next_links(spark):
    requests = _requests(spark, [
        (1, "id=7", _site("https://evil.test/x", "shop.test")), (2, "id=7", _site("https://www.shop.test/x", "shop.test")),
        (3, "", _site("https://evil.test/x", "shop.test")), (4, "id=7", _site(None, "shop.test")), (5, "id=7", _site("https://evil.test/x", None)),
        (6, "id=7", None),
    ])
    rules = [
        _link(1, 1, 3, "ARGS_NAMES", "streq", "id"),
        _link(1, 2, 3, "REQUEST_HEADERS", "rx", "^(https?)://(.*?)/", name_filter="^Referer$", capture=True),
        _link(1, 3, 3, "TX:2", "endsWith", "%{request_headers.host}", negate=True),
    ]
    # without a host the argument is empty, and every text ends with it
    assert _ids(requests, rules, spark) == [(1, 1, "TX", "2", "evil.test")]
    assert _ids(requests, [dict(rules[0]), {**rules[1], "capture": False}, rules[2]], spark) == []


def test_captures_of_the_transformed_text_and_of_the_last_match(spark):
    requests = _requests(spark, [(1, "a=X-ONE&b=x-two&c=two", None), (2, "a=x-one&c=two", None), (3, "a=x-one&c=pre%20one", None)])
    rules = [
        _link(2, 1, 2, "ARGS", "rx", "^x-([a-z]+)", ["lowercase"], capture=True),
        _link(2, 2, 2, "ARGS", "endsWith", "%{tx.1}", name_filter="^c$"),
        _link(3, 1, 2, "ARGS", "rx", "^x-([a-z]+)(z)?", ["lowercase"], capture=True),
        _link(3, 2, 2, "ARGS", "streq", "%{TX.0}|%{tx.1}|%{tx.2}|%{args.c}", negate=True, name_filter="^a$"),
        _link(4, 1, 2, "ARGS", "rx", "^x-(one)", capture=True),
        _link(4, 2, 2, "TX:1", "pm", "ONE"),
    ]
    found = _ids(requests, rules, spark)
    assert [f for f in found if f[1] == 2] == [(1, 2, "ARGS", "c", "two"), (3, 2, "ARGS", "c", "pre one")]
    assert [f[0] for f in found if f[1] == 3] == [1, 2, 3]
    assert [f for f in found if f[1] == 4] == [(i, 4, "TX", "1", "one") for i in (2, 3)]


def test_a_later_capture_replaces_an_earlier_one(spark):
    requests = _requests(spark, [(1, "a=k1&b=k2&c=2", None), (2, "a=k1&b=k2&c=1", None)])
    rules = [
        _link(5, 1, 3, "ARGS", "rx", "k([0-9])", name_filter="^a$", capture=True),
        _link(5, 2, 3, "ARGS", "rx", "k([0-9])", name_filter="^b$", capture=True),
        _link(5, 3, 3, "ARGS", "streq", "%{tx.1}", name_filter="^c$"),
        _link(6, 1, 3, "ARGS", "rx", "k([0-9])", name_filter="^a$", capture=True),
        _link(6, 2, 3, "ARGS", "rx", "k([0-9])", name_filter="^b$"),
        _link(6, 3, 3, "ARGS", "streq", "%{tx.1}", name_filter="^c$"),
    ]
    assert [f[:2] for f in _ids(requests, rules, spark)] == [(1, 5), (2, 6)]


def test_links_that_are_missing_or_misused(spark):
    requests = _requests(spark, [(1, "a=k1", None)])
    assert _ids(requests, [_link(7, 1, 3, "ARGS", "rx", "k(.)", capture=True), _link(7, 3, 3, "ARGS", "streq", "k%{tx.1}")], spark) == []
    with pytest.raises(ValueError, match="scan_requests"):
        scan.rule_scan(spark.createDataFrame([], "req_id long, collection string, name string, value string"), spark.createDataFrame([_link(8, 1, 1, "ARGS", "streq", "%{tx.1}")], RULES))
    with pytest.raises(ValueError, match="no argument from the request"):
        _ids(requests, [_link(9, 1, 2, "ARGS", "rx", "(k)", capture=True), _link(9, 2, 2, "ARGS", "pm", "%{tx.1}")], spark)
    with pytest.raises(ValueError, match="unknown variable"):
        _ids(requests, [_link(9, 1, 2, "ARGS", "rx", "(k)", capture=True), _link(9, 2, 2, "ARGS", "streq", "%{no.such}")], spark)


@pytest.mark.parametrize("pattern, groups", [("a", 0), ("(a)(b)", 2), (r"\((a)", 1), ("[(](?:a)(?i)(b)", 1), ("(?<x>a)(?<=b)(?<!c)", 1), (r"[\]()](a)", 1), ("()" * 20, 9)])
def test_group_count(pattern, groups):
    assert rule_forms.group_count(pattern) == groups


def _sorted(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_rows_agree_with_the_shuffled_scan(spark, sf_dir):
    requests, rules, phrases = views.requests(spark, sf_dir), rule_pack.rules(spark), rule_pack.phrases(spark)
    config = ScanConfig(blocking_pl=2, detection_pl=4, sampling_pct=60, skip_response=True)
    scores = scoring.complete_scores(requests, scoring.score_requests(scan.scan_requests(requests, rules, phrases, config), rules, config))
    in_rows = scan.score_in_rows(requests, rules, phrases, config)
    assert sorted(in_rows.collect()) == sorted(scores.select(*in_rows.columns).collect())
    plan = in_rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    every = row_scan.explode_matches(row_scan.with_matches(scan.response_gate(requests), rules.collect(), scan.phrase_lists(phrases)))
    assert _sorted(every) == _sorted(scan.scan_requests(requests, rules, phrases, ScanConfig(detection_pl=4)))


def test_scores_when_lists_are_too_long_to_compile(spark, sf_dir, monkeypatch):
    requests, rules, phrases = views.requests(spark, sf_dir), rule_pack.rules(spark), rule_pack.phrases(spark)
    expected = sorted(scan.score_in_rows(requests, rules, phrases).collect())
    monkeypatch.setattr(scan, "MOST_LITERALS", 3)
    assert sorted(scan.score_in_rows(requests, rules, phrases).select("req_id", *scoring.SCORE_COLUMNS).collect()) == expected


def test_no_rules(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    scores = scan.score_in_rows(requests, rule_pack.rules(spark, "no such family"))
    assert scores.count() == requests.count() and scores.agg(F.sum("blocking_inbound")).first()[0] == 0


def test_stream_decides_as_the_batch_does(spark, sf_dir, tmp_path, monkeypatch):
    """As a projection of the stream, and by micro-batch when lists are too long to compile."""
    views.requests(spark, sf_dir).filter("req_id < 400").write.parquet(str(tmp_path / "in"))
    requests, rules, phrases = spark.read.parquet(str(tmp_path / "in")), rule_pack.rules(spark), rule_pack.phrases(spark)
    expected = sorted(scoring.decide_waf(scan.score_in_rows(requests, rules, phrases)).collect(), key=str)
    for number, most in enumerate((scan.MOST_LITERALS, 3)):
        monkeypatch.setattr(scan, "MOST_LITERALS", most)
        stream = streams.stream_table(spark, str(tmp_path / "in"), requests.schema)
        out = str(tmp_path / f"out{number}")
        streams.stream_scan_score(stream, rules, phrases, ScanConfig(), out, str(tmp_path / f"state{number}")).awaitTermination()
        got = spark.read.parquet(out).select(*scoring.decide_waf(scan.score_in_rows(requests, rules, phrases)).columns)
        assert sorted(got.collect(), key=str) == expected
