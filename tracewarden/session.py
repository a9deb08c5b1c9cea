"""Session helpers: where scratch data may live, and how large a table may be before it is not broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints (spark.checkpoint.dir).

    A session on one machine may leave it unset and gets a folder of its own, removed when Python ends; a cluster must
    name one, as executors and driver do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tracewarden-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tracewarden/{name}-{uuid.uuid4().hex}"


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small (rules, vocabularies, statistics); fail when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is made once, and a lost executor costs no rework."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
