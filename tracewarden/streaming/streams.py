"""Stream forms of the batch operators. Rows are decided within their micro-batch, so no state is kept per request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.config import ScanConfig
from tracewarden.functions.features import featurise
from tracewarden.operators import scan, scoring, verdicts
from tracewarden.operators.traffic import exact_mean
from tracewarden.session import stored


def stream_table(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def stream_features(requests: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Stateless: the batch projection on a stream."""
    return featurise(requests, only)


def stream_scan_score(requests: DataFrame, rules: DataFrame, phrases: DataFrame | None, config: ScanConfig, path: str, checkpoint: str, key: str = "req_id", **trigger) -> StreamingQuery:
    """Scan, score and decide every request as it comes: a projection of the stream, planned once.

    Rules and phrases are read when the stream starts. Only if phrase rules must go through the index are micro-batches
    decided one by one, each into its own folder, so that a repeated batch replaces itself.
    """
    rules = stored(rules, "stream-rules")
    phrases = None if phrases is None else stored(phrases, "stream-phrases")

    def decided(rows: DataFrame) -> DataFrame:
        return scoring.decide_waf(scan.score_in_rows(rows, rules, phrases, config, key), config)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            decided(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    if scan.split_rules(scan.rules_for(rules, config), phrases)[2] is None:
        out = decided(requests).writeStream.format("parquet").option("path", path)
    else:
        out = requests.writeStream.foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_verdicts(requests: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Model verdict, risk tier and final action per row; ``score`` is ``score_batch`` or ``score_with`` bound to a model."""
    scored = score(requests)
    tier = verdicts.risk_tier(F.col("score"))
    return scored.withColumns({"tier_rule": tier["rule_id"], "tier_action": tier["action"]})


def stream_traffic(events: DataFrame, lateness: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Counts, failures and mean latency per second; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("failures"), exact_mean("latency_ms").alias("mean_latency"))
        .select(F.unix_seconds(F.col("w.start")).alias("second"), "requests", "failures", "mean_latency")
    )


def stream_dedup(events: DataFrame, columns: list[str], lateness: str = "1 hour") -> DataFrame:
    """Exact duplicates that arrive within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.dropDuplicatesWithinWatermark(columns)


def stream_alerts(rows: DataFrame, level: int = 3, column: str = "level") -> DataFrame:
    return rows.filter(F.col(column) >= level)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now into a Parquet folder."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now, writing the groups that each micro-batch changed to a folder of its own.

    Update mode lets the watermark drop old state; a repeated batch replaces its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last written row of every group."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return last.select("row.*")
