"""Evaluation as a stream: test rows arrive in micro-batches, every row is
scored by the heads of all rounds (constants of the projection), and a
stateful streaming aggregate keeps the confusion counts ``(y, pred, n)``
across batches (the reference accumulates predictions batch by batch).

The split boundaries and the heads come from batch jobs over the training
data; the stream itself only filters, projects and aggregates, so its
state is K*K counts whatever the input rate. The sink is ``foreachBatch``
overwriting a table with the complete counts (idempotent on replay), with
the query's checkpoint in the shared folder. Logits are compared as they are:
z-scores need whole batches or global statistics, which a stream has not.
``known``: the registered classes, whose test rows are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.functions.columns import argmax_first
from roundlearn.operators.heads import class_names, score_wide
from roundlearn.operators.sampling import split_label, with_order_key


def confusion_stream(spark: SparkSession, stream: DataFrame, key: str, class_col: str, vec_col: str,
                     heads: list, known: list[str], bounds: tuple, out_path: str, checkpoint: str, seed=42) -> DataFrame:
    names = class_names(heads)
    rows = with_order_key(stream, key, seed)
    rows = rows.where((split_label(key, bounds) == "test") & F.col(class_col).cast("string").isin(known))
    rows = score_wide(rows.select(F.col(class_col).cast("string").alias("y"), vec_col), heads, vec_col)
    scored = rows.select("y",
                         F.element_at(names, argmax_first(F.col("logits")) + 1).alias("pred"))
    counts = scored.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (counts.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)
