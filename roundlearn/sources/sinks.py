"""Sinks: heads per round, long metric table, history, label dictionary.

All are parquet tables in a shared folder. Heads are partitioned by
``round`` and written with dynamic partition overwrite, so re-running a
round replaces that round only (idempotent replay)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.session import scratch_path

METRIC_COLS = ("run", "split", "scope", "class", "metric", "value")
HISTORY_COLS = ("run", "epoch", "split", "metric", "value")


def save_heads(heads_long: DataFrame, path: str) -> None:
    """SNK1: ``(round, class, dim, value)`` rows, one folder per round."""
    (heads_long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("round").parquet(path))


def load_heads(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: read heads back; ``round`` comes from the folder name."""
    return spark.read.parquet(path).withColumn("round", F.col("round").cast("int"))


def append_metrics(metrics_long: DataFrame, path: str) -> None:
    """SNK2: append ``(run, split, scope, class, metric, value)`` rows."""
    metrics_long.select(*METRIC_COLS).write.mode("append").parquet(path)


def append_history(history: DataFrame, path: str) -> None:
    """SNK3: append ``(run, epoch, split, metric, value)`` rows."""
    history.select(*HISTORY_COLS).write.mode("append").parquet(path)


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.select("label_col", "label", "id").write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a dictionary fitted elsewhere."""
    return spark.read.parquet(path).select("label_col", "label", F.col("id").cast("int"))


def save_bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """A table in the shared folder, bucketed and sorted by ``key``: joins of
    two such tables on the key need no shuffle. The rows are dealt to their
    buckets by one exchange here, so that each bucket is one file. ``buckets``
    (default: the session's shuffle partitions) must be alike on both sides."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)
