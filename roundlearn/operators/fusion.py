"""Score fusion over a wide ``logits`` array (class order).

* per batch (WIN4, parity): ``(logit_k - avg_k) / (stddev_pop_k + 1e-6)`` with
  the statistics of class k over the rows of the same batch. Computed as
  2K window aggregates over ``partitionBy(batch_id)``: one exchange of the
  rows, each group is one batch (32 rows), no explode and no join.
* per row (WIN5): over the classes of one row, no shuffle at all.
* global (WIN6): statistics of each class over all rows, a one-row partial
  aggregate, then a constant in the projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundlearn.functions.columns import ZSCORE_EPS, argmax_first, logsumexp


def _z(logits: Column, means: list[Column], stds: list[Column], eps: float) -> Column:
    return F.array(*[(logits[k] - means[k]) / (stds[k] + F.lit(eps)) for k in range(len(means))])


def zscore_batch(df: DataFrame, n_classes: int, batch_col: str = "batch_id",
                 logits: str = "logits", out: str = "z", eps: float = ZSCORE_EPS) -> DataFrame:
    """One form for any number of classes; a row without logits keeps its
    place with null scores."""
    lg = F.col(logits)
    w = Window.partitionBy(batch_col)
    means = [F.avg(lg[k]).over(w) for k in range(n_classes)]
    stds = [F.stddev_pop(lg[k]).over(w) for k in range(n_classes)]
    return df.withColumn(out, F.when(lg.isNotNull(), _z(lg, means, stds, eps)))


def zscore_row(df: DataFrame, logits: str = "logits", out: str = "z", eps: float = ZSCORE_EPS) -> DataFrame:
    lg = F.col(logits)
    n = F.size(lg).cast("double")
    mean = F.aggregate(lg, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.zip_with(lg, F.array_repeat(mean, F.size(lg)), lambda x, m: x - m)
    sd = F.sqrt(F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x) / n)
    return df.withColumn(out, F.zip_with(dev, F.array_repeat(sd, F.size(lg)), lambda x, s: x / (s + F.lit(eps))))


def class_stats(df: DataFrame, n_classes: int, logits: str = "logits") -> list[tuple[float, float]]:
    """(mean, stddev_pop) per class over all rows: K numbers on the driver."""
    lg = F.col(logits)
    aggs = []
    for k in range(n_classes):
        aggs += [F.avg(lg[k]).alias(f"m{k}"), F.stddev_pop(lg[k]).alias(f"s{k}")]
    r = df.agg(*aggs).first()
    return [(r[f"m{k}"], r[f"s{k}"]) for k in range(n_classes)]


def zscore_global(df: DataFrame, n_classes: int, logits: str = "logits", out: str = "z",
                  eps: float = ZSCORE_EPS) -> DataFrame:
    st = class_stats(df, n_classes, logits)
    lg = F.col(logits)
    return df.withColumn(out, _z(lg, [F.lit(m) for m, _ in st], [F.lit(s) for _, s in st], eps))


def argmax_predict(df: DataFrame, names: Column, z: str = "z", out: str = "pred",
                   idx_out: str | None = None) -> DataFrame:
    """SRT6: class with the largest score, first in class order on ties."""
    i = argmax_first(F.col(z))
    df = df.withColumn(out, F.element_at(names, i + 1))
    return df.withColumn(idx_out, i) if idx_out else df


def row_ce(z: Column, y_index: Column) -> Column:
    """Cross-entropy of one row over its scores; null when y is not scored."""
    return F.when(y_index >= 0, logsumexp(z) - F.element_at(z, y_index + 1))


def to_long(df: DataFrame, keep: list[str], names: Column, arr: str = "z", value: str = "z") -> DataFrame:
    """Wide scores -> ``(keep..., class_order, class, value)`` rows."""
    return (df.select(*keep, F.posexplode(F.arrays_zip(names.alias("class"), F.col(arr).alias(value))))
              .select(*keep, (F.col("pos") + 1).cast("int").alias("class_order"),
                      F.col("col.class").alias("class"), F.col(f"col.{value}").alias(value)))
