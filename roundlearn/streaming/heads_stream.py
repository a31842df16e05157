"""Mergeable heads and fused evaluation over micro-batches.

The state of a class head is what its centroid is made of: the number of its
rows and their sum, one row for each class and micro-batch, in the partition
``batch=<id>`` that a replay rewrites. Heads of any version are a sum over
batches, so late rows of a known class can update its head by a policy:
``merge`` adds up all batches, ``frozen`` takes the batch that brought the
class. A class belongs to the first batch that has rows of it; batches without
a new class use no round number.

The fused evaluation keeps the scores of each micro-batch's rows and, for each
class and batch, the moments of its scores (count, mean and squared deviations,
which merge exactly). The z-scores over all rows so far are a projection of the
kept scores by the merged moments: once all rows are in they are those of the
batch job (WIN6). Class statistics have one row a class and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.functions.columns import ZSCORE_EPS, to_double_array
from roundlearn.operators.heads import score_wide
from roundlearn.session import checked_broadcast, materialize


def _write(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))


def run_batches(stream: DataFrame, each, checkpoint: str) -> None:
    """Drive a stream to completion, one call of ``each`` a micro-batch."""
    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ---- heads

def add_statistics(batch: DataFrame, batch_id: int, path: str, class_col: str, vec_col: str) -> None:
    """One micro-batch: count and sum of the vectors of each class in it
    (partial aggregates, one row a class and dim), as the batch's partition."""
    rows = batch.where(F.col(class_col).isNotNull() & F.col(vec_col).isNotNull())
    long = rows.select(F.col(class_col).cast("string").alias("class"), F.posexplode(to_double_array(F.col(vec_col))).alias("dim", "v"))
    _write(long.groupBy("class", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum")), batch_id, path)


def heads_of(spark: SparkSession, path: str, policy: str = "merge", upto: int | None = None) -> DataFrame:
    """``(round, pos, class, class_order, n_train, mu, bias)`` of the classes
    that the batches (up to number ``upto``) have brought."""
    if policy not in ("merge", "frozen"):
        raise ValueError(f"unknown policy {policy}")
    st = spark.read.parquet(path)
    if upto is not None:
        st = st.where(F.col("batch") <= upto)
    first = st.groupBy("class").agg(F.min("batch").alias("first"))             # one row a class
    reg = first.selectExpr("class", "first", "CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS round",
                           "CAST(row_number() OVER (PARTITION BY first ORDER BY class) AS INT) AS pos",
                           "CAST(row_number() OVER (ORDER BY first, class) AS INT) AS class_order")
    st = st.join(checked_broadcast(reg), "class")
    if policy == "frozen":
        st = st.where(F.col("batch") == F.col("first"))
    mu = st.groupBy("round", "pos", "class", "class_order", "dim").agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("m"))
    g = mu.groupBy("round", "pos", "class", "class_order").agg(
        F.max("n").alias("n_train"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mu"))
    return g.withColumn("bias", F.lit(-0.5) * F.aggregate("mu", F.lit(0.0), lambda a, x: a + x * x))


# ---- evaluation

def add_scores(batch: DataFrame, batch_id: int, path: str, heads: list, class_col: str, vec_col: str, keep: list[str]) -> None:
    """One micro-batch: the scores of its rows, and the moments of each
    class's scores, as the batch's partitions of two tables."""
    scored = materialize(score_wide(batch.select(*keep, F.col(class_col).cast("string").alias("y"), vec_col), heads, vec_col).drop(vec_col))
    lg = F.col("logits")
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.count(lg[i]).alias("n"), F.avg(lg[i]).alias("mean"),
                               (F.var_pop(lg[i]) * F.count(lg[i])).alias("m2")) for i in range(len(heads))])
    _write(scored.agg(lines.alias("x")).select(F.explode("x").alias("x")).select("x.*").where("n > 0"), batch_id, f"{path}/moments")
    _write(scored, batch_id, f"{path}/scores")


def merged_moments(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """(mean, stddev_pop) of each class over all batches, from one row a
    class and batch: squared deviations add up with those of the means."""
    st = spark.read.parquet(f"{path}/moments")
    whole = st.groupBy("i").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    d = F.col("mean") - F.col("m")
    rows = st.join(checked_broadcast(whole), "i").groupBy("i", "m").agg((F.sum(F.col("m2") + F.col("n") * d * d) / F.sum("n")).alias("v"))
    return [(r["m"], r["v"] ** 0.5) for r in rows.orderBy("i").collect()]


def fused(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The kept rows with ``z`` by the merged moments and ``pred``, the first
    class on ties."""
    rows = spark.read.parquet(f"{path}/scores")
    st = merged_moments(spark, path)
    z = F.array(*[(F.col("logits")[i] - F.lit(m)) / (F.lit(s) + F.lit(ZSCORE_EPS)) for i, (m, s) in enumerate(st)])
    rows = rows.withColumn("z", F.when(F.col("logits").isNotNull(), z))
    at = F.array_position("z", F.array_max("z")).cast("int")
    return rows.withColumn("pred", F.element_at(F.array(*[F.lit(c) for c in names]), at))
