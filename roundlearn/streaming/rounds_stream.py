"""Rounds as a stream: each micro-batch with a new class is a round.

File source -> ``foreachBatch``: the classes of the micro-batch that no
earlier batch registered become the next round's classes and are written to
the registry partition ``batch=<batch_id>`` with dynamic partition overwrite.
A micro-batch without a new class writes nothing and uses no round number. A
replayed batch id sees only batches before it and rewrites the same
partition, so replay changes nothing (idempotent sink).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundlearn.session import checked_broadcast, materialize

REGISTRY = "class string, pos int, round int, batch long"


def _read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry; without rows before the first batch has written it. Any
    other failure to read it is an error."""
    try:
        return spark.read.schema(REGISTRY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def register_batch(batch: DataFrame, batch_id: int, registry_path: str, class_col: str,
                   vec_col: str | None = None, heads_path: str | None = None) -> None:
    """One micro-batch: register the classes no earlier batch has as the next
    round, and (with ``vec_col``) fit their centroid heads on this batch's
    rows of those classes. Both tables are written to the partition
    ``batch=<batch_id>`` with dynamic overwrite, so a replay rewrites the
    same partition with the same content."""
    spark = batch.sparkSession
    earlier = _read_registry(spark, registry_path).where(F.col("batch") < batch_id)
    done = earlier.agg(F.countDistinct("round").cast("int")).first()[0]
    seen = batch.select(F.col(class_col).cast("string").alias("class")).where(F.col("class").isNotNull()).distinct()
    seen = seen.join(earlier.select("class"), "class", "left_anti")
    # distinct classes of one batch (the class universe, not the rows), found
    # once for the registry and the heads
    new = materialize(seen.withColumn("pos", F.row_number().over(Window.orderBy("class")).cast("int")))
    place = {"round": F.lit(done).cast("int"), "batch": F.lit(batch_id).cast("long")}
    if vec_col and heads_path:
        from roundlearn.operators.heads import centroid_heads
        rows = batch.withColumn(class_col, F.col(class_col).cast("string")).join(
            checked_broadcast(new.select(F.col("class").alias(class_col))), class_col, "left_semi")
        h = centroid_heads(rows, class_col, vec_col).select("class", "n_train", "bias", "mu").withColumns(place)
        (h.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(heads_path))
    (new.withColumns(place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").parquet(registry_path))


def run_rounds_stream(spark: SparkSession, stream: DataFrame, class_col: str, registry_path: str, checkpoint: str,
                      vec_col: str | None = None, heads_path: str | None = None) -> DataFrame:
    """Drive the stream to completion (``availableNow``) and return the
    registry ``(round, pos, class)``."""
    q = (stream.writeStream.foreachBatch(
            lambda df, bid: register_batch(df, bid, registry_path, class_col, vec_col, heads_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return _read_registry(spark, registry_path).select("round", "pos", "class")
