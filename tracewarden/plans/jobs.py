"""Whole jobs: train a classifier, and decide requests with rules, policy and model together."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.config import FeatureConfig, ScanConfig
from tracewarden.operators import cleaning, evaluate, policy, scan, scoring, verdicts
from tracewarden.operators.models import get_model, save_model
from tracewarden.operators.ranking import stratified_split
from tracewarden.operators.text_features import feature_pipeline
from tracewarden.session import scratch_path


@dataclass
class Training:
    model: PipelineModel
    metrics: dict[str, float]
    scored: DataFrame
    seconds: float


def train_job(
    audit: DataFrame, kind: str = "random_forest", params: dict | None = None, features: FeatureConfig = FeatureConfig(),
    key: str = "TransactionID", clean: bool = True, fit_on_all: bool = False, model_path: str | None = None,
    runs_path: str | None = None, run_ts: str = "",
) -> Training | None:
    """Clean, split, fit features on the training part (or on all rows), train, evaluate, store.

    ``key`` orders the split; it is kept beside the cleaned columns. Returns None for a table with one class or no rows.
    """
    start = time.time()
    rows = audit
    if clean:
        rows = cleaning.drop_error_rows(cleaning.dedup_exact(audit))
        rows = cleaning.uppercase_columns(cleaning.require_columns(cleaning.filter_label(rows, features.label, list(features.label_values))))
    wanted = [c for c in [key, *features.text, *features.categorical, *features.numeric] if c in rows.columns]
    table = rows.select(*wanted, cleaning.binary_label(F.col(features.label)).alias("label"))
    table = stratified_split(table, "label", key, features.test_size, features.seed).persist()
    guard = cleaning.training_guards(table, [*features.text, *features.categorical, *features.numeric]).first()
    if not guard["trainable"]:
        table.unpersist()
        return None
    train, test = table.filter(~F.col("is_test")), table.filter("is_test")
    prepared = feature_pipeline(table if fit_on_all else train, features)
    # vectors are some thirty times their texts: in memory they would leave no room for the blocks or bins that estimators cache
    vectors = prepared.transform(train).select("label", "features").persist(StorageLevel.DISK_ONLY)
    width = vectors.first()["features"].size
    fixed = {"n_features": width, "n_rows": train.count(), "random_state": features.seed}
    classifier = get_model(kind, {**fixed, **(params or {})}).fit(vectors)
    model = PipelineModel([prepared, classifier])
    path = scratch_path(audit.sparkSession, "scored")
    model.transform(test).select(key, "label", F.col("prediction").cast("int").alias("prediction")).write.parquet(path)
    scored = audit.sparkSession.read.parquet(path)
    scores = evaluate.metrics(scored).first().asDict()
    vectors.unpersist()
    table.unpersist()
    seconds = time.time() - start
    if model_path:
        save_model(model, model_path)
    if runs_path:
        evaluate.append_run(audit.sparkSession, runs_path, kind, params or {}, scores, seconds, run_ts)
    return Training(model, scores, scored, seconds)


def decide_requests(
    requests: DataFrame, rules: DataFrame, phrases: DataFrame | None = None, config: ScanConfig = ScanConfig(),
    scored: DataFrame | None = None, key: str = "req_id", exclusions: DataFrame | None = None,
) -> DataFrame:
    """One decision per request from rule scan, policy checks and, where given, model verdicts.

    ``exclusions`` (see ``scan.apply_exclusions``) takes rules, tags or targets out of the scan for single requests.
    """
    spark: SparkSession = requests.sparkSession
    matches = scan.scan_requests(requests, rules, phrases, config, key)
    if exclusions is not None:
        matches = scan.apply_exclusions(matches, rules, exclusions, key)
    checks = policy.policy_matches(scan.scan_gate(requests, config, key), config, key=key)
    columns = [key, "rule_id"]
    facts = ["rule_id", "pl", "severity", "score_var", "direction", "phase"]
    every = scoring.rule_facts(rules, *facts[1:]).unionByName(policy.policy_rules(spark).select(*facts))
    scores = scoring.score_requests(matches.select(*columns).unionByName(checks.select(*columns)), every, config, key)
    decided = scoring.decide_waf(scoring.complete_scores(requests, scores, key), config)
    if scored is None:
        decided = decided.withColumns({"verdict": F.lit(verdicts.NOT_EVALUATED), "score": F.lit(-1.0)})
    else:
        decided = verdicts.attach_verdicts(decided, scored, key)
    return verdicts.combine_verdicts(decided)
