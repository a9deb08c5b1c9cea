"""Hot groups and invariants, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.config import FeatureConfig, ScanConfig
from tracewarden.functions.predicates import ip_match
from tracewarden.operators import models, neighbours, ranking, running, scan, text_features, traffic
from tracewarden.plans import rule_pack
from tracewarden.schemas import PERCENTILES, RULES


def test_percentiles_with_a_hot_value_and_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", 5.0)] * 4000 + [("hot", round(rng.uniform(-50, 900), 2)) for _ in range(3000)]
    rows += [("b", round(rng.expovariate(0.01), 3)) for _ in range(500)] + [(None, 1.0), (None, 2.0), ("one", 3.0)]
    counts = ranking.value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    got = {r["g"]: r for r in ranking.exact_percentiles(counts, ["g"], PERCENTILES).collect()}
    for group in {g for g, _ in rows}:
        values = sorted(v for g, v in rows if g == group)
        for name, p in PERCENTILES.items():
            rank = max(1, math.ceil(round(p * len(values), 9)))
            assert got[group][name] == values[rank - 1], (group, name)


def test_ranks_match_a_plain_window(spark):
    rows = [(i, "hot" if i % 3 else "rare") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, label string").withColumn("o", ranking.shuffle_key(F.col("id"), 1))
    got = {r["id"]: r["rank"] for r in ranking.rank_by_hash(df, "label", "o", hex_digits=1).collect()}
    for label in ("hot", "rare"):
        ordered = [r["id"] for r in df.filter(F.col("label") == label).orderBy("o").collect()]
        assert [got[i] for i in ordered] == list(range(1, len(ordered) + 1))


def test_folds_are_balanced_and_split_is_stratified(spark):
    df = spark.createDataFrame([(i, "m" if i % 10 == 0 else "b") for i in range(2003)], "id long, label string")
    folds = ranking.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in ("m", "b"):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    split = ranking.stratified_split(df, "label", "id").groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert all(r["t"] == round(r["n"] * 0.2) for r in split.collect())


def test_nearest_over_many_blocks(spark):
    rng = random.Random(3)
    points = {i: [rng.random() for _ in range(4)] for i in range(120)}
    df = spark.createDataFrame([(i, v, i % 3) for i, v in points.items()], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest(df, df, k=4, block_rows=25).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"]))
    for i, v in points.items():
        order = sorted((math.dist(v, w), j) for j, w in points.items() if j != i)
        assert [n for _, n in sorted(got[i])] == [j for _, j in order[:4]]


def test_nearest_prunes_clusters_and_splits_equal_vectors(spark, monkeypatch):
    """Far clusters are not visited; a third of all rows is one vector; keys and vectors may be null."""
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 6)) * 100
    points = np.concatenate([centres[rng.integers(0, 10, 400)] + rng.normal(size=(400, 6)), np.repeat(centres[:1], 200, axis=0)])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(points)] + [(None, [0.0] * 6, 1), (9999, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen, kept = [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda visits, references, k: seen.append(visits.count()) or kept(visits, references, k))
    got = {}
    for r in neighbours.nearest(df, df, k=3, block_rows=20).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"]))
    for i, v in enumerate(points):
        distance = np.sqrt(((points - v) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(points)), distance)) if j != i]
        assert [n for _, n in sorted(got[i])] == order[:3]
    assert sorted(got) == list(range(600))
    _, _, blocks = neighbours._blocks(df.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("r_vec"), F.col("label").alias("r_label")).dropna(), 20)
    assert sum(seen) < 0.5 * 600 * sum(b["salts"] for b in blocks)
    few = neighbours.nearest(df.limit(3), df.limit(3), k=5)
    assert few.groupBy("vec_id").count().where("count = 2").count() == 3
    assert neighbours.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "block"), [(0.5, 50), (0.9, 3600), (0.0, 7)])
def test_running_quantile(spark, monkeypatch, share, block):
    """Two digits and several blocks; a value that holds a third of all rows; seconds without any value."""
    monkeypatch.setattr(running, "BLOCK_SECONDS", block)
    rng = random.Random(block)
    rows = [(rng.randrange(-200, 400), rng.choice([5.0, rng.uniform(-9, 99), round(rng.uniform(0, 9)) / 2]), rng.randrange(1, 4)) for _ in range(1500)]
    rows += [(999, None, 3), (-500, None, 1)]
    df = spark.createDataFrame(rows, "time long, value double, n long")
    got = {r["time"]: r["value"] for r in running.running_quantile(df, share).collect()}
    seen, want = [], {}
    for time in sorted({r[0] for r in rows}):
        seen += [v for t, v, n in rows if t == time and v is not None for _ in range(n)]
        if seen:
            want[time] = sorted(seen)[max(1, math.ceil(share * len(seen))) - 1]
    assert got == want


def test_ngrams_and_tfidf(spark):
    texts = ["GET  /a/b", "é😀x", "", "aaaa", "/a/b?x=1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    tokens = text_features.with_terms(df, "t", "terms", 1, 3)
    grams = {r["id"]: Counter(r["terms"]) for r in tokens.collect()}
    for i, text in enumerate(texts):
        s = text.lower().replace("  ", " ")
        assert grams[i] == Counter(s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1))
    model = text_features.tfidf_fit(tokens, "terms", 10)
    assert len(model.terms) == 10 and model.terms == sorted(model.terms)
    weights = text_features.sparse_entries(text_features.tfidf_transform(tokens, model, "terms"), "tfidf", "id", model.terms)
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_stored_pipeline_makes_the_same_grams(spark):
    df = spark.createDataFrame([(1, "Ab  c\n\n/é"), (2, "x")], "id long, t string")
    direct = [r["g"] for r in text_features.with_terms(df, "t", "g", 1, 3).orderBy("id").collect()]
    statement = text_features._ngram_statement("t", "g", 1, 3).replace("__THIS__", "{rows}")
    assert [r["g"] for r in spark.sql(statement.replace("]{2,}", "]{{2,}}"), rows=df).orderBy("id").collect()] == direct


def test_word_and_character_pipeline(spark):
    rows = [(1, "/a/b", "Mozilla Gecko x", "GET", 3), (2, "/a/c", "Mozilla curl", "POST", 5)]
    df = spark.createDataFrame(rows, "id long, path string, agent string, method string, n int")
    config = FeatureConfig(text=("path", "agent"), categorical=("method",), numeric=("n",), analyzer={"agent": "word"}, ngrams={"path": (1, 2)})
    model = text_features.feature_pipeline(df, config)
    out = model.transform(df).orderBy("id").collect()
    assert out[0]["agent_vec_terms"] == ["mozilla", "gecko"] and out[0]["path_vec_terms"] == ["/", "a", "/", "b", "/a", "a/", "/b"]
    assert out[0]["n_z"] == -1.0 and out[1]["n_z"] == 1.0
    unseen = spark.createDataFrame([(3, None, None, "PATCH", None)], df.schema)
    assert model.transform(unseen).first()["features"].numNonzeros() == 1  # the scaled number alone


def test_tokeniser_order_and_padding(spark):
    df = spark.createDataFrame([(1, "Abca"), (2, "cz")], "id long, t string")
    vocabulary = text_features.vocabulary_of(df, "t", "id")
    assert vocabulary == {"a": 2, "c": 3, "b": 4, "z": 5}
    unseen = spark.createDataFrame([(3, "aQc"), (4, None)], "id long, t string")
    rows = text_features.tokenise_pad(unseen, "t", vocabulary, 5, "s").orderBy("id").collect()
    assert [r["s"] for r in rows] == [[2, 1, 3, 0, 0], [0] * 5]


def _targets(spark, n_hot):
    rows = [(1, "ARGS", f"a{i}", "<script>x</script>") for i in range(n_hot)]
    rows += [(2, "ARGS", "q", "1 union  select 2"), (3, "ARGS_NAMES", "sessionid", "SessionID"), (4, "ARGS_NAMES", "sessionid", "sessionid"),
             (4, "REQUEST_HEADERS", "Referer", "https://other.example/x"), (5, "REQUEST_HEADERS", "Referer", "https://other.example/x")]
    return spark.createDataFrame(rows, "req_id long, collection string, name string, value string")


def test_scan_in_batches_agrees_for_every_rule(spark):
    targets, rules = _targets(spark, 3000), rule_pack.rules(spark)
    columns = ["req_id", "rule_id", "chain_link", "collection", "name", "value"]
    whole = scan.rule_scan(targets, rules, rule_pack.phrases(spark)).select(*columns)
    batches = scan.rule_scan(targets, rules, rule_pack.phrases(spark), batch=3).select(*columns)
    assert whole.count() > 3000
    assert whole.exceptAll(batches).count() == 0 and batches.exceptAll(whole).count() == 0


def test_more_rules_than_a_projection_holds(spark):
    pack = [rule_pack._rule(800000 + i, "x", 1, ["ARGS"], "streq", f"v{i}", [], "NOTICE", "inbound", "m") for i in range(2500)]
    targets = spark.createDataFrame([(i, "ARGS", "a", f"v{7 * i}") for i in range(400)], "req_id long, collection string, name string, value string")
    found = scan.rule_scan(targets, spark.createDataFrame(pack, RULES), batch=1000)
    assert sorted((r["req_id"], r["rule_id"]) for r in found.collect()) == [(i, 800000 + 7 * i) for i in range(358)]


def test_counts_by_key_include_zero(spark):
    rule = rule_pack._rule(1, "x", 1, ["ARGS"], "eq", "0", [], "NOTICE", "inbound", "m", is_count=True, name_filter="^a")
    rows = [(1, "ARGS", "a1", "x"), (2, "ARGS", "b", "x"), (3, "REQUEST_URI", "", "/")]
    targets = spark.createDataFrame(rows, "req_id long, collection string, name string, value string")
    assert sorted(r["req_id"] for r in scan.rule_scan(targets, spark.createDataFrame([rule], RULES)).collect()) == [2, 3]


def test_unknown_operator_is_an_error(spark):
    rule = rule_pack._rule(1, "x", 1, ["ARGS"], "noSuch", "", [], "NOTICE", "inbound", "m")
    with pytest.raises(ValueError):
        scan.rule_scan(_targets(spark, 1), spark.createDataFrame([rule], RULES))


@pytest.mark.parametrize(
    "address, inside",
    [("2001:db8::1", True), ("2001:DB8:1:2:3:4:5:6", True), ("2001:db9::", False), ("::1", True), ("::2", False), ("10.1.2.3", True), ("11.1.2.3", False), ("x", False), ("1:2", False), (None, False)]
    + [("::ffff:10.0.0.1", True), ("::FFFF:a00:1", True), ("::ffff:11.0.0.1", False), ("2001:db8::10.0.0.1", True), ("64:ff9b::10.0.0.1", False)]
    + [("10.300.0.1", False), ("::ffff:10.0.0.300", False), ("::0.0.0.1", True), ("192.168.7.7", True), ("::ffff:192.168.8.1", False), ("10.0.0.1:80", False)],
)
def test_ip_networks(spark, address, inside):
    df = spark.createDataFrame([(address,)], "v string").select(F.coalesce(ip_match(F.col("v"), "10.0.0.0/8,2001:db8::/32,::1,::ffff:192.168.7.0/120"), F.lit(False)))
    assert df.first()[0] == inside


def test_chain_needs_all_links(spark):
    rules = rule_pack.rules(spark, "fixation")
    done = scan.complete_chains(scan.rule_scan(_targets(spark, 1), rules), rules).collect()
    assert [(r["req_id"], r["rule_id"], r["chain_link"]) for r in done] == [(4, 943901, 2)]


def test_empty_rule_table(spark):
    assert scan.rule_scan(_targets(spark, 1), rule_pack.rules(spark, "no such family")).count() == 0


def test_history_totals_cross_days(spark):
    rows = [(f"2024-01-0{d} 23:59:5{s}", u, "GET", "x", float(d * s), 10, None) for d in (1, 2, 3) for s in (5, 7) for u in (1, 2)]
    df = spark.createDataFrame(rows, "ts string, user_id long, method string, name string, latency_ms double, size long, error string")
    out = traffic.traffic_history(df.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("Timestamp").collect()
    assert [r["Total Request Count"] for r in out] == [2, 4, 6, 8, 10, 12]
    assert out[-1]["Total Max Response Time"] == 21.0 and out[1]["Requests/s"] == 0.4 and out[1]["User Count"] == 2


def test_config_and_registry_errors(spark):
    with pytest.raises(ValueError):
        ScanConfig(blocking_pl=2, detection_pl=1).check()
    with pytest.raises(ValueError):
        models.get_model("no such kind")
    row = ScanConfig(max_num_args=5).to_frame(spark).first()
    assert row["detection_pl"] == 1 and row["max_num_args"] == 5 and "POST" in row["allowed_methods"]
    with pytest.raises(ValueError):
        text_features.assemble(spark.createDataFrame([(1,)], "id long"), FeatureConfig(mode="odd"), "id")


def test_grid_sizes():
    assert len(models.combinations(models.GRIDS["decision_tree"])) == 24
