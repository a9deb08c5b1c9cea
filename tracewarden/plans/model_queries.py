"""Feature extraction, nearest neighbours, classifiers, verdicts and evaluation, with check SQL where it applies."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tracewarden.config import FeatureConfig, ScanConfig
from tracewarden.functions.features import featurise
from tracewarden.operators import codes, evaluate, models, neighbours, ranking, scan, scoring, text_features, verdicts
from tracewarden.operators.cleaning import binary_label, scoring_gate
from tracewarden.plans import jobs, rule_pack, views
from tracewarden.plans.feature_queries import FEATURE_CTE
from tracewarden.plans.registry import register
from tracewarden.plans.scan_queries import SCORE_CTE
from tracewarden.session import scratch_path
from tracewarden.sources.audit_json import audit_records

_C = F.col
_DIALOG = views.cte("dialog")


def _grams_cte(longest: int) -> str:
    sizes = ", ".join(f"({n})" for n in range(1, longest + 1))
    return (
        _DIALOG
        + f""", t AS (SELECT row_id, regexp_replace(lower(text), '\\s{{2,}}', ' ', 'g') AS s FROM dialog),
grams AS (SELECT row_id, substr(s, i, n) AS term FROM (SELECT row_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM t, (VALUES {sizes}) v(n)) x)
"""
    )


_GRAMS_CTE = _grams_cte(6)
_TERMS = 5000


def _grams(spark, sf_dir, longest=6):
    rows = views.spread(views.view(spark, sf_dir, "dialog"))
    return text_features.with_terms(rows, "text", "terms", 1, longest).select("row_id", "terms")


@register("d1_char_ngrams", _grams_cte(3) + "SELECT row_id, term, count(*) AS n FROM grams GROUP BY ALL")
def d1(spark, sf_dir):
    return text_features.term_counts(views.view(spark, sf_dir, "dialog").select("row_id", "text"), "text", "terms", 1, 3)


_TOP = f"vocab AS (SELECT term, count(*) AS tf FROM grams GROUP BY term ORDER BY tf DESC, term LIMIT {_TERMS})"


@register("w4_top_terms", _GRAMS_CTE + f", {_TOP} SELECT term, tf FROM vocab")
def w4(spark, sf_dir):
    return text_features.top_terms(_grams(spark, sf_dir), "terms", _TERMS)


@register(
    "d2_tfidf",
    _GRAMS_CTE
    + f""", {_TOP}, c AS (SELECT row_id, term, count(*) AS n FROM grams SEMI JOIN vocab USING (term) GROUP BY ALL),
d AS (SELECT term, ln((1.0 + (SELECT count(*) FROM dialog)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term),
w AS (SELECT row_id, term, n * idf AS w FROM c JOIN d USING (term))
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w""",
)
def d2(spark, sf_dir):
    grams, rows = _grams(spark, sf_dir), views.spread(views.view(spark, sf_dir, "dialog"))
    model = text_features.tfidf_of(text_features.char_statistics(rows, "text", 1, 6), _TERMS, rows.count())
    entries = text_features.sparse_entries(text_features.tfidf_transform(grams, model, "terms"), "tfidf", "row_id", model.terms)
    return entries.select("row_id", "term", F.round("weight", 6).alias("weight"))


@register(
    "d2_tfidf_words",
    _DIALOG
    + """, w AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}')) AS term FROM dialog)
SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df FROM w GROUP BY term""",
)
def d2_words(spark, sf_dir):
    rows = text_features.with_terms(views.spread(views.view(spark, sf_dir, "dialog")), "text", "terms", 1, 1, "word")
    once = rows.select(text_features.each_term("terms").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    freq = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return once.join(freq, "term")


@register(
    "d3_one_hot",
    views.cte("requests")
    + """, known AS (SELECT DISTINCT method FROM requests WHERE req_id % 40 >= 20)
SELECT req_id, CASE WHEN method IN (SELECT method FROM known) THEN (SELECT count(*) FROM known k WHERE k.method < r.method) ELSE -1 END AS hot FROM requests r""",
)
def d3(spark, sf_dir):
    rows = views.requests(spark, sf_dir).select("req_id", "method", "label")
    model = text_features.one_hot_model(rows.filter("label = 'benign'"), "method", "vec")
    v = F.unwrap_udt(F.col("vec"))
    return model.transform(rows).select("req_id", F.coalesce(F.get(v["indices"], F.lit(0)), F.lit(-1)).cast("long").alias("hot"))


@register(
    "d4_standardise",
    """SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents), 6) AS n_chars_z FROM documents""",
)
def d4(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    scaled = text_features.standardise(docs, text_features.standardise_fit(docs, ["n_chars"]))
    return scaled.select("doc_id", F.round("n_chars_z", 6).alias("n_chars_z"))


@register("d5_label_encode", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS source_code FROM documents")
def d5(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    return text_features.label_encode(docs, "source").select("doc_id", F.col("source_code").cast("int").alias("source_code"))


@register("d5_label_encode_wide", "SELECT event_id, dense_rank() OVER (ORDER BY value) - 1 AS value_code FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, NULL FROM events WHERE value IS NULL")
def d5_wide(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", "value")
    return text_features.label_encode(events, "value").select("event_id", "value_code")


@register(
    "d3_one_hot_wide",
    """WITH known AS (SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') x)
SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM known) AS width, coalesce(code, -1) AS hot FROM lineitem LEFT JOIN known USING (l_partkey)""",
)
def d3_wide(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    known = codes.code_table(items.filter("l_returnflag = 'R'"), "l_partkey")
    v = F.unwrap_udt(F.col("vec"))
    hot = F.coalesce(F.get(v["indices"], F.lit(0)), F.lit(-1)).cast("long").alias("hot")
    return codes.one_hot(items, "l_partkey", known, "vec").select("l_orderkey", "l_linenumber", v["size"].cast("long").alias("width"), hot)


@register(
    "d6_tokenise_pad",
    _DIALOG
    + """, ch AS (SELECT row_id, i, substr(lower(text), i, 1) AS c FROM (SELECT row_id, text, unnest(range(1, length(text) + 1)) AS i FROM dialog) x),
seen AS (SELECT c, count(*) AS n, min(row_id * 1000000 + i) AS first FROM ch GROUP BY c),
vocab AS (SELECT c, row_number() OVER (ORDER BY n DESC, first) + 1 AS id FROM seen),
ids AS (SELECT row_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS s, count(*) AS n FROM ch JOIN vocab USING (c) WHERE i <= 50 GROUP BY row_id)
SELECT d.row_id, concat(coalesce(s, ''), CASE WHEN coalesce(n, 0) = 0 THEN ltrim(repeat(',0', 50), ',') ELSE repeat(',0', CAST(50 - n AS BIGINT)) END) AS ids
FROM dialog d LEFT JOIN ids USING (row_id)""",
)
def d6(spark, sf_dir):
    rows = views.spread(views.view(spark, sf_dir, "dialog"))
    vocabulary = text_features.vocabulary_of(rows, "text", "row_id")
    return text_features.tokenise_pad(rows, "text", vocabulary, 50, "ids").select("row_id", F.array_join("ids", ",").alias("ids"))


_FEATURES = FeatureConfig()


def _audit(spark, sf_dir):
    return audit_records(views.requests(spark, sf_dir))


@register("d7_assemble_sparse")
def d7(spark, sf_dir):
    out, _ = text_features.assemble(_audit(spark, sf_dir), _FEATURES, "TransactionID")
    v = F.unwrap_udt(F.col("features"))
    return out.select("TransactionID", v["size"].alias("width"), F.size(v["indices"]).alias("filled"))


@register(
    "d7_assemble_raw",
    FEATURE_CTE
    + """SELECT CAST(req_id AS VARCHAR) AS TransactionID, method AS RequestMethod, path AS RequestURIPath, query AS RequestURIQuery,
  body AS RequestBody, coalesce(user_agent, '') AS UserAgent, CAST(RequestLength AS INT) AS RequestLength, CAST(PathLength AS INT) AS PathLength,
  CAST(QueryLength AS INT) AS QueryLength FROM requests JOIN (SELECT req_id, RequestLength, PathLength, QueryLength FROM featured) USING (req_id)""",
)
def d7_raw(spark, sf_dir):
    out, _ = text_features.assemble(_audit(spark, sf_dir), FeatureConfig(mode="raw"), "TransactionID")
    return out


@register("d7_assemble_dense")
def d7_dense(spark, sf_dir):
    out, _ = text_features.assemble(_audit(spark, sf_dir), FeatureConfig(mode="dense"), "TransactionID")
    return out


_NEAREST_SQL = """WITH p AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbour, b.label AS label,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rk FROM p)
"""


@register("w6_k_nearest", _NEAREST_SQL + "SELECT vec_id, neighbour, round(distance, 6) AS distance, label, CAST(rk AS INT) AS rank FROM r WHERE rk <= 5")
def w6(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors).withColumn("distance", F.round("distance", 6))


@register(
    "d8_knn_classify",
    _NEAREST_SQL
    + """, v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rk <= 5 GROUP BY ALL)
SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS o FROM v) x WHERE o = 1""",
)
def d8(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return neighbours.knn_classify(vectors, vectors)


# ---- classifiers --------------------------------------------------------------------------------------------------


def _train(kind: str, params: dict, config: FeatureConfig = _FEATURES):
    def query(spark, sf_dir):
        result = jobs.train_job(_audit(spark, sf_dir), kind, params, config)
        return result.scored

    return query


register("d9_linear_svm")(_train("svm", {"C": 1.0, "max_iter": 20}))
register("d10_random_forest")(_train("random_forest", {"n_estimators": 10, "max_depth": 8}))
register("d11_decision_tree")(_train("decision_tree", {"max_depth": 10, "criterion": "entropy"}))
register("d12_naive_bayes")(_train("naive_bayes", {"alpha": 0.5}, FeatureConfig(scale_numeric=False)))
register("d13_mlp")(_train("mlp", {"hidden_layer_sizes": (8,), "max_iter": 20}))


def _numeric_vectors(spark, sf_dir, folds: int):
    """Numeric features only, with a fold per row."""
    names = ["NumSpecialChars", "NumKeywords", "NumEncodedChars", "NumUniqueChars", "QueryLength"]
    rows = featurise(views.requests(spark, sf_dir), names).withColumn("label", binary_label(_C("label")))
    folded = ranking.stratified_folds(rows.select("req_id", "label", *names), "label", "req_id", folds)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(folded).select("req_id", "label", "fold", "features")
    path = scratch_path(spark, "numeric-vectors")
    vectors.write.parquet(path)
    return spark.read.parquet(path)


@register("d14_get_model")
def d14(spark, sf_dir):
    """Every registered kind fitted once on the same rows."""
    train = _numeric_vectors(spark, sf_dir, 2)
    out = None
    for kind in sorted(models.MODELS):
        fixed = {"n_features": 5, "hidden_layer_sizes": (4,), "max_iter": 5, "n_estimators": 3, "max_depth": 4, "n_rows": 1000}
        scored = models.get_model(kind, fixed).fit(train).transform(train).select("label", F.col("prediction").cast("int").alias("prediction"))
        part = evaluate.metrics(scored).select(F.lit(kind).alias("kind"), "accuracy", "f1", "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("d15_tune_grid")
def d15(spark, sf_dir):
    train = _numeric_vectors(spark, sf_dir, 3)
    candidates = models.combinations({"max_depth": [2, 6], "criterion": ["gini", "entropy"]})
    _, search = models.tune_grid(train, "decision_tree", {"max_depth": [2, 6], "criterion": ["gini", "entropy"]})
    return models.search_table(spark, candidates, search.avgMetrics)


@register("d16_tune_random")
def d16(spark, sf_dir):
    train = _numeric_vectors(spark, sf_dir, 3)
    best, search = models.tune_random(train, "decision_tree", 2, {"max_depth": [2, 4, 6], "min_samples_leaf": [1, 4]})
    return spark.createDataFrame([(str(best), float(max(search.avgMetrics)))], "params string, f1 double")


@register("d17_cross_validate")
def d17(spark, sf_dir):
    per_fold, _, _ = models.cross_validate(_numeric_vectors(spark, sf_dir, 5), "decision_tree", {"max_depth": 5})
    return per_fold


@register(
    "w5_best_params",
    """SELECT event_type AS params, avg(value) AS mean_score FROM events GROUP BY event_type ORDER BY mean_score DESC, params LIMIT 1""",
)
def w5(spark, sf_dir):
    """Mean score per parameter text, over score rows taken from the event table."""
    rows = views.table(spark, sf_dir, "events").select(_C("event_type").alias("params"), _C("value").alias("f1"))
    return models.best_params(rows)


@register("s14_save_load_model")
def s14(spark, sf_dir):
    path = scratch_path(spark, "model")
    rows = _audit(spark, sf_dir)
    jobs.train_job(rows, "decision_tree", {"max_depth": 5}, _FEATURES, model_path=path)
    return models.load_model(spark, path).transform(rows).select("TransactionID", F.col("prediction").cast("int").alias("prediction"))


@register("d18_score_batch")
def d18(spark, sf_dir):
    rows = _audit(spark, sf_dir)
    model = jobs.train_job(rows, "random_forest", {"n_estimators": 5, "max_depth": 6}, _FEATURES).model
    gate = scoring_gate(_C("RequestMethod"), _C("RequestURIQuery"), _C("RequestBody"))
    return verdicts.score_batch(rows, model, gate, _FEATURES).select("TransactionID", "verdict", F.round("score", 6).alias("score"))


@register("d21_train_job")
def d21(spark, sf_dir):
    runs = scratch_path(spark, "runs")
    jobs.train_job(_audit(spark, sf_dir), "decision_tree", {"max_depth": 6}, _FEATURES, runs_path=runs, run_ts="20250710_200141")
    return evaluate.read_runs(spark, runs).select("run_ts", "model", "params", "metrics")


# ---- verdicts and decisions ---------------------------------------------------------------------------------------

_VERDICTS = "SELECT event_id AS req_id, CASE event_id % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'Not Evaluated' END AS verdict, CAST(event_id % 100 AS DOUBLE) / 100 AS score FROM events WHERE event_id % 7 > 0"


def _verdicts(spark, sf_dir):
    views.table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_VERDICTS)


_ATTACHED = f"""attached AS (SELECT r.req_id, CASE WHEN v.verdict IN ('malicious', 'benign') THEN v.verdict ELSE 'not evaluated' END AS verdict,
  coalesce(v.score, -1) AS score FROM requests r LEFT JOIN ({_VERDICTS}) v USING (req_id))"""


@register("j17_attach_verdicts", views.cte("requests") + f", {_ATTACHED} SELECT req_id, verdict, score FROM attached")
def j17(spark, sf_dir):
    rows = views.requests(spark, sf_dir).select("req_id")
    return verdicts.attach_verdicts(rows, _verdicts(spark, sf_dir))


@register(
    "d19_combine_verdicts",
    SCORE_CTE
    + f""", {_ATTACHED}, d AS (SELECT a.*, CASE WHEN blocking_inbound >= 5 THEN 949110 WHEN blocking_outbound >= 4 THEN 959100 END AS waf FROM attached a LEFT JOIN scores USING (req_id))
SELECT req_id, CASE WHEN waf IS NOT NULL OR verdict = 'malicious' THEN 'deny' ELSE 'pass' END AS final_action,
  CAST(coalesce(waf, CASE WHEN verdict = 'malicious' THEN 666 END) AS INT) AS final_rule,
  CAST(CASE WHEN waf IS NOT NULL OR verdict = 'malicious' THEN 403 END AS INT) AS final_status FROM d""",
)
def d19(spark, sf_dir):
    requests, config, rules = views.requests(spark, sf_dir), ScanConfig(blocking_pl=1, detection_pl=4), rule_pack.rules(spark)
    decided = scoring.decide_waf(scan.score_in_rows(requests, rules, rule_pack.phrases(spark), config), config)
    combined = verdicts.combine_verdicts(verdicts.attach_verdicts(decided, _verdicts(spark, sf_dir)))
    return combined.select("req_id", "final_action", "final_rule", "final_status")


@register("d19_decide_requests")
def d19_all(spark, sf_dir):
    """Rules, policy checks and verdicts in one decision per request."""
    out = jobs.decide_requests(
        views.requests(spark, sf_dir), rule_pack.rules(spark), rule_pack.phrases(spark), ScanConfig(detection_pl=2), _verdicts(spark, sf_dir)
    )
    return out.select("req_id", "blocking_inbound", "detection_inbound", "final_action", "final_rule")


@register(
    "d20_risk_tier",
    f"SELECT req_id, CAST(CASE WHEN score > 0.8 THEN 1001 WHEN score > 0.5 THEN 1002 END AS INT) AS tier_rule, CASE WHEN score > 0.8 THEN 'deny' WHEN score > 0.5 THEN 'alert' END AS tier_action FROM ({_VERDICTS}) v",
)
def d20(spark, sf_dir):
    tier = verdicts.risk_tier(_C("score"))
    return _verdicts(spark, sf_dir).select("req_id", tier["rule_id"].alias("tier_rule"), tier["action"].alias("tier_action"))


# ---- evaluation, on label and prediction columns taken from the labels table --------------------------------------

_PAIRS = "SELECT doc_id, CAST(toxic AS INT) AS label, CAST(CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END AS INT) AS prediction, CAST(doc_id % 5 AS INT) AS fold FROM labels"


def _pairs(spark, sf_dir):
    views.table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return spark.sql(_PAIRS)


_COUNTS = """c AS (SELECT {g} count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp,
  count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (label = prediction)::DOUBLE AS ok FROM p {by})"""
_METRICS = """round(ok / n, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, n FROM c"""
_MEASURES = ["accuracy", "precision", "recall", "f1"]


def _rounded(df):
    return df.withColumns({m: F.round(m, 9) for m in _MEASURES if m in df.columns})


@register("e1_metrics", f"WITH p AS ({_PAIRS}), {_COUNTS.format(g='', by='')} SELECT {_METRICS}")
def e1(spark, sf_dir):
    return _rounded(evaluate.metrics(_pairs(spark, sf_dir)))


@register("e1_metrics_by_fold", f"WITH p AS ({_PAIRS}), {_COUNTS.format(g='fold,', by='GROUP BY fold')} SELECT fold, {_METRICS}")
def e1_fold(spark, sf_dir):
    return _rounded(evaluate.metrics(_pairs(spark, sf_dir), ["fold"]))


@register(
    "e2_class_report",
    f"""WITH p AS ({_PAIRS}), k AS (SELECT * FROM (VALUES (0, 'benign'), (1, 'malicious')) v(id, class)),
s AS (SELECT class, sum((label = id AND prediction = id)::INT)::DOUBLE AS tp, sum((prediction = id)::INT)::DOUBLE AS given, sum((label = id)::INT)::DOUBLE AS support FROM p, k GROUP BY class),
r AS (SELECT class, CASE WHEN given = 0 THEN 0 ELSE tp / given END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
  CASE WHEN given + support = 0 THEN 0 ELSE 2 * tp / (given + support) END AS f1, support, tp FROM s),
u AS (SELECT class, precision, recall, f1, support FROM r
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM u""",
)
def e2(spark, sf_dir):
    return _rounded(evaluate.class_report(_pairs(spark, sf_dir)))


@register(
    "e3_confusion_matrix",
    f"""WITH p AS ({_PAIRS}) SELECT CASE WHEN label = 1 THEN 'Actual Malicious' ELSE 'Actual Benign' END AS actual,
  count(*) FILTER (prediction = 0) AS predicted_benign, count(*) FILTER (prediction = 1) AS predicted_malicious FROM p GROUP BY 1""",
)
def e3(spark, sf_dir):
    return evaluate.confusion_matrix(_pairs(spark, sf_dir))


@register(
    "e4_run_log",
    f"WITH p AS ({_PAIRS}), {_COUNTS.format(g='', by='')} SELECT '20250710_200141' AS run_ts, 'fixed' AS model, m.* FROM (SELECT {_METRICS}) m",
)
def e4(spark, sf_dir):
    """Metrics of the label table appended as a run and read back."""
    path = scratch_path(spark, "run-log")
    scores = evaluate.metrics(_pairs(spark, sf_dir)).first().asDict()
    evaluate.append_run(spark, path, "fixed", {"seed": 42}, scores, 1.0, "20250710_200141")
    runs = evaluate.read_runs(spark, path)
    measures = [F.round(F.col("metrics")[m], 9).alias(m) for m in _MEASURES]
    return runs.select("run_ts", "model", *measures, F.col("metrics")["n"].cast("long").alias("n"))


@register(
    "u3_config_table",
    FEATURE_CTE + "SELECT method, count(*) AS n FROM featured WHERE method NOT IN ('GET', 'HEAD', 'POST', 'OPTIONS') GROUP BY method",
)
def u3(spark, sf_dir):
    """Policy read from the one-row configuration table instead of the dataclass."""
    allowed = ScanConfig().to_frame(spark).select(F.explode("allowed_methods").alias("method"))
    rows = views.requests(spark, sf_dir).select("method")
    return rows.join(F.broadcast(allowed), "method", "left_anti").groupBy("method").agg(F.count("*").alias("n"))
