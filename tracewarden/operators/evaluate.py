"""Model quality from (label, prediction) rows, both 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _count(test: Column) -> Column:
    return F.count_if(test).cast("double")


def metrics(df: DataFrame, groups: list[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class in one aggregation; 0 where a denominator is 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counted = df.groupBy(*groups).agg(
        F.count("*").alias("n"), _count(y & p).alias("tp"), _count(~y & p).alias("fp"), _count(y & ~p).alias("fn"),
        _count(y == p).alias("right"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    accuracy = ratio(F.col("right"), F.col("n").cast("double"))
    return counted.select(
        *groups, accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.col("n").cast("long").alias("n"),
    )


def class_report(df: DataFrame, names: list[str] = ("benign", "malicious"), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    pairs = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    classes = F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(name).alias("class")) for i, name in enumerate(names)]
    )
    spread = pairs.select(label, prediction, "n", F.explode(classes).alias("c"))
    own, given = F.col(label) == F.col("c.id"), F.col(prediction) == F.col("c.id")

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0)).cast("double")

    per_class = spread.groupBy(F.col("c.class").alias("class")).agg(
        total(own & given).alias("tp"), total(given).alias("predicted"), total(own).alias("support")
    )
    scored = per_class.select(
        "class", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp",
    )
    measures = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *measures, "support"
    )
    weighted = scored.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures], F.sum("support").alias("support")
    ).select(F.lit("weighted avg").alias("class"), *measures, "support")
    accuracy = scored.agg(ratio(F.sum("tp"), F.sum("support")).alias("f1"), F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("class"), F.col("f1").alias("precision"), F.col("f1").alias("recall"), "f1", "support"
    )
    out = scored.drop("tp").unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return out.withColumn("support", F.col("support").cast("long"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    counted = df.groupBy(label).pivot(prediction, [0, 1]).count().na.fill(0)
    actual = F.when(F.col(label) == 1, "Actual Malicious").otherwise("Actual Benign")
    return counted.select(
        actual.alias("actual"), F.col("0").alias("predicted_benign"), F.col("1").alias("predicted_malicious")
    )


def append_run(spark: SparkSession, path: str, model: str, params: dict, scores: dict, seconds: float, run_ts: str) -> None:
    """Add one run to the log table."""
    row = [(run_ts, model, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in scores.items()}, float(seconds))]
    schema = "run_ts string, model string, params map<string,string>, metrics map<string,double>, seconds double"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    schema = "run_ts string, model string, params map<string,string>, metrics map<string,double>, seconds double"
    return spark.read.schema(schema).json(path)
