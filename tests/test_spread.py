"""Tables of few files are spread by their rows before work begins."""

from tracewarden.plans import views


def test_tasks_grow_with_the_rows(spark, monkeypatch, tmp_path):
    """One compressed file used to give one task a core at most, however many rows it held."""
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = views.spread(spark.read.parquet(str(tmp_path / "t")))
    assert rows.rdd.getNumPartitions() == 40
    assert max(rows.rdd.glom().map(len).collect()) <= 150
    assert sorted(r[0] for r in rows.collect()) == list(range(4000))


def test_request_view_is_worked_out_by_many_tasks(spark, sf_dir):
    """The rows are dealt before the view's projection, not after it."""
    plan = views._request_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("Repartition") < plan.index("Relation")
    assert "regexp_extract" not in plan[plan.index("Repartition") :]


def test_stored_requests_are_dealt_again(spark, monkeypatch, tmp_path):
    """The stored table is small beside its rows: a split of it used to hold the rows of many files."""
    events = spark.range(3000).selectExpr(
        "id AS event_id", "timestamp'2025-07-10 20:00:00' AS ts", "id % 50 AS user_id", "'view' AS event_type", "1.5D AS value", "concat('{\"k\": ', id % 7, '}') AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    whole = views.requests(spark, str(tmp_path))
    monkeypatch.setattr(views, "TASK_ROWS", 50)
    rows = views.requests(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 60 > whole.rdd.getNumPartitions()
    assert max(rows.rdd.glom().map(len).collect()) <= 100
    assert sorted(r[0] for r in rows.select("req_id").collect()) == sorted(r[0] for r in whole.select("req_id").collect()) == list(range(3000))
