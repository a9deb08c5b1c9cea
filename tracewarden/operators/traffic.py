"""Traffic reports: per endpoint, per error, per second.

Input: ts, user_id, method, name, latency_ms, size, error (null when the request succeeded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.ranking import exact_percentiles, value_counts
from tracewarden.operators.running import running_quantile
from tracewarden.schemas import PERCENTILES


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def exact_sum(column: str) -> Column:
    """A sum as decimal with six places: no digit depends on the order of the rows."""
    return F.sum(F.col(column).cast("decimal(28,6)"))


def exact_mean(column: str) -> Column:
    return exact_sum(column).cast("double") / F.count(column)


def traffic_summary(events: DataFrame) -> DataFrame:
    """One row per (method, name) and a row ``Aggregated`` over all; rates are over the span of the whole run."""
    rows = events.select(F.col("method").alias("Type"), F.col("name").alias("Name"), "ts", "latency_ms", "size", "error")
    failed = F.col("error").isNotNull()
    totals = rows.rollup("Name", "Type").agg(
        F.grouping_id().alias("__g"),
        F.count("*").alias("Request Count"),
        F.count_if(failed).alias("Failure Count"),
        exact_mean("latency_ms").alias("Average Response Time"),
        F.min("latency_ms").alias("Min Response Time"),
        F.max("latency_ms").alias("Max Response Time"),
        exact_mean("size").alias("Average Content Size"),
    )
    totals = totals.filter(F.col("__g").isin(0, 3)).withColumn(
        "Name", F.when(F.col("__g") == 3, "Aggregated").otherwise(F.col("Name"))
    )
    first, last = (F.unix_micros(f(F.col("ts").cast("timestamp"))) for f in (F.min, F.max))
    span = rows.agg(F.greatest((last - first) / 1e6, F.lit(1.0))).scalar()
    totals = totals.withColumns(
        {"Requests/s": F.col("Request Count") / span, "Failures/s": F.col("Failure Count") / span}
    )
    counts = value_counts(rows, ["Type", "Name"], "latency_ms")
    everything = counts.groupBy("__value").agg(F.sum("__n").alias("__n")).select(
        F.lit(None).cast("string").alias("Type"), F.lit("Aggregated").alias("Name"), "__value", "__n"
    )
    percentiles = exact_percentiles(counts.unionByName(everything), ["Type", "Name"], PERCENTILES)
    same = F.col("t.Name").eqNullSafe(F.col("p.Name")) & F.col("t.Type").eqNullSafe(F.col("p.Type"))
    joined = totals.alias("t").join(percentiles.alias("p"), same, "left")
    order = [
        "Request Count", "Failure Count", "Median Response Time", "Average Response Time", "Min Response Time",
        "Max Response Time", "Average Content Size", "Requests/s", "Failures/s",
    ]
    source = lambda c: F.col("p.`50%`") if c == "Median Response Time" else F.col(f"t.`{c}`")
    return joined.select(
        F.col("t.Type"), F.col("t.Name"), *[source(c).alias(c) for c in order], *[F.col(f"p.`{c}`") for c in PERCENTILES]
    )


def failure_summary(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("error").isNotNull())
        .groupBy(F.col("method").alias("Method"), F.col("name").alias("Name"), F.col("error").alias("Error"))
        .agg(F.count("*").alias("Occurrences"))
    )


def _running_totals(per_second: DataFrame) -> DataFrame:
    """Totals up to each second: within its day, plus the days before. No task holds more than a day of seconds."""
    day = F.floor(F.col("second") / 86400)
    rows = per_second.withColumn("day", day)
    up_to = Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    sums, lows, highs = ["n", "failed", "latency", "bytes"], ["low"], ["high"]
    days = rows.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]
    )
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    carried = days.select(
        "day",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"prior_{c}") for c in sums],
        *[F.min(c).over(before).alias(f"prior_{c}") for c in lows],
        *[F.max(c).over(before).alias(f"prior_{c}") for c in highs],
    )
    inner = rows.select(
        "second", "day",
        *[F.sum(c).over(up_to).alias(c) for c in sums],
        *[F.min(c).over(up_to).alias(c) for c in lows],
        *[F.max(c).over(up_to).alias(c) for c in highs],
    )
    joined = inner.join(carried, "day")
    n = F.col("n") + F.col("prior_n")
    return joined.select(
        "second",
        n.cast("long").alias("Total Request Count"),
        (F.col("failed") + F.col("prior_failed")).cast("long").alias("Total Failure Count"),
        ((F.col("latency") + F.col("prior_latency")).cast("double") / n).alias("Total Average Response Time"),
        F.least("low", "prior_low").alias("Total Min Response Time"),
        F.greatest("high", "prior_high").alias("Total Max Response Time"),
        ((F.col("bytes") + F.col("prior_bytes")) / n).alias("Total Average Content Size"),
    )


def traffic_history(events: DataFrame, window_seconds: int = 10) -> DataFrame:
    """One row per second with traffic: users, rates and latency percentiles of the last seconds, totals and median so far."""
    rows = events.withColumn("second", _seconds(F.col("ts")))
    failed = F.count_if(F.col("error").isNotNull())
    per_second = rows.groupBy("second").agg(
        F.count("*").alias("n"), failed.alias("failed"), exact_sum("latency_ms").alias("latency"),
        F.sum("size").alias("bytes"), F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"),
    )
    present = per_second.select("second")
    later = F.explode(F.sequence(F.col("second"), F.col("second") + window_seconds - 1)).alias("at")

    def seen_from(table: DataFrame, *columns: str) -> DataFrame:
        """Each row at every second whose window covers it, for seconds that are reported."""
        spread = table.select(*columns, later).withColumnRenamed("at", "second")
        return spread.join(present, "second", "left_semi")

    rates = seen_from(per_second, "n", "failed").groupBy("second").agg(
        (F.sum("n") / window_seconds).alias("Requests/s"), (F.sum("failed") / window_seconds).alias("Failures/s")
    )
    users = seen_from(rows.select("second", "user_id").distinct(), "user_id").groupBy("second").agg(
        F.count_distinct("user_id").alias("User Count")
    )
    by_value = value_counts(rows, ["second"], "latency_ms")
    counts = seen_from(by_value, "__value", "__n")
    medians = running_quantile(by_value.select(F.col("second").alias("time"), F.col("__value").alias("value"), F.col("__n").alias("n")))
    medians = medians.select(F.col("time").alias("second"), F.col("value").alias("Total Median Response Time"))
    summed = counts.groupBy("second", "__value").agg(F.sum("__n").alias("__n"))
    percentiles = exact_percentiles(summed, ["second"], PERCENTILES)
    joined = rates.join(users, "second").join(percentiles, "second").join(_running_totals(per_second), "second")
    joined = joined.join(medians, "second", "left")
    return joined.select(
        F.col("second").alias("Timestamp"), "User Count", F.lit("Aggregated").alias("Name"), "Requests/s", "Failures/s",
        *[F.col(f"`{p}`") for p in PERCENTILES], "Total Request Count", "Total Failure Count",
        "Total Median Response Time", "Total Average Response Time", "Total Min Response Time", "Total Max Response Time", "Total Average Content Size",
    )
