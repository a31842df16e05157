"""Classification metrics as small aggregate tables.

Every multi-class metric is derived from the confusion counts
``(y, pred, n)``: at most K*K rows, built with a partial (map-side)
aggregate, so class skew never lands on one task and nothing but K*K
counts crosses the network. Zero division gives 0.0 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundlearn.functions.columns import F1_EPS
from roundlearn.session import checked_broadcast


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """AGG5 ``(y, pred, n)``."""
    return (df.select(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("pred"))
              .groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n")))


def per_class(conf: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """AGG6 ``(class, tp, pp, support, precision, recall, f1)``.

    Universe = ``labels`` (JN6, a ``class`` column) when given, else every
    class seen as true or predicted (JN5, open universe)."""
    # one pass over the K*K cells: each cell counts as support of its true
    # class, as a prediction of its predicted class, and as tp when equal
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("pp"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("pp"),
                 F.lit(0).cast("bigint").alias("tp")))
    cnt = (conf.select(F.explode(sides).alias("s")).select("s.*")
               .groupBy("class").agg(F.sum("support").alias("support"), F.sum("pp").alias("pp"), F.sum("tp").alias("tp")))
    if labels is None:
        t = cnt
    else:
        t = labels.join(cnt, "class", "left").fillna(0, ["support", "pp", "tp"])
    return (t.withColumn("precision", _div(F.col("tp"), F.col("pp")))
             .withColumn("recall", _div(F.col("tp"), F.col("support")))
             .withColumn("f1", _div(2 * F.col("tp"), F.col("pp") + F.col("support"))))


def macro(pc: DataFrame, where: Column | None = None) -> DataFrame:
    """AGG7 (all classes of the universe) / AGG14 (``where support > 0``)."""
    t = pc.where(where) if where is not None else pc
    return t.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"),
                 F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))


def weighted(pc: DataFrame) -> DataFrame:
    """AGG8: support-weighted means."""
    s = F.sum("support")
    return pc.agg(*[_div(F.sum(F.col(m) * F.col("support")), s).alias(m) for m in ("precision", "recall", "f1")])


def accuracy(conf: DataFrame) -> DataFrame:
    """AGG16 from the confusion counts."""
    return conf.agg(_div(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)),
                         F.sum("n")).alias("accuracy"))


def binary(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """AGG9: positive class = 1, one pass of conditional sums."""
    yy, pp = F.col(y).cast("int"), F.col(pred).cast("int")
    tp = F.sum(F.when((yy == 1) & (pp == 1), 1).otherwise(0))
    fp = F.sum(F.when((yy == 0) & (pp == 1), 1).otherwise(0))
    fn = F.sum(F.when((yy == 1) & (pp == 0), 1).otherwise(0))
    t = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
               F.sum(F.when(yy == pp, 1).otherwise(0)).alias("eq"), F.count(F.lit(1)).alias("n"))
    return t.select(_div(F.col("eq"), F.col("n")).alias("accuracy"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def cell_sums(df: DataFrame, y: str, p: str, width: int) -> DataFrame:
    """Per multi-hot column j: tp, fp, fn, support. Cells are exploded and
    summed by ``j`` (partial aggregation: W rows per task reach the shuffle);
    every known column has a row, also on empty input."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("j", "c"))
    yy, pp = F.col("c.y"), F.col("c.p")
    sums = cells.groupBy(F.col("j").cast("int").alias("j")).agg(
        F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp == 0)).alias("fn"))
    known = df.sparkSession.range(width).select(F.col("id").cast("int").alias("j"))
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")}
    return (known.join(sums, "j", "left").select("j", *n.values())
            .withColumn("support", F.col("tp") + F.col("fn")))


def cell_sums_of_sets(df: DataFrame, y: str, p: str, width: int) -> DataFrame:
    """``cell_sums`` from label sets given as lists of positions: a row gives
    one cell for each label it has or is given, none for the others, so cost
    grows with the labels that are set and not with ``width``."""
    cell = lambda arr, hit, got, sup: F.transform(arr, lambda j: F.struct(
        j.cast("int").alias("j"), F.lit(hit).alias("hit"), F.lit(got).alias("got"), F.lit(sup).alias("sup")))
    both = F.array_intersect(F.col(y), F.col(p))
    cells = df.select(F.explode(F.concat(cell(F.col(y), 0, 0, 1), cell(F.col(p), 0, 1, 0), cell(both, 1, 0, 0))).alias("c"))
    sums = cells.groupBy("c.j").agg(F.sum("c.hit").alias("tp"), F.sum("c.got").alias("got"), F.sum("c.sup").alias("support"))
    known = df.sparkSession.range(width).select(F.col("id").cast("int").alias("j"))
    t = known.join(sums, "j", "left").select("j", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "got", "support")])
    return t.select("j", "tp", (F.col("got") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")


def accuracy_cells_of_sets(df: DataFrame, y: str, p: str, width: int) -> DataFrame:
    """AGG15 from lists of positions: all cells but those in one set only."""
    apart = F.size(F.col(y)) + F.size(F.col(p)) - F.lit(2) * F.size(F.array_intersect(F.col(y), F.col(p)))
    return df.agg((F.lit(100.0) * (F.lit(1.0) - F.sum(apart) / (F.count(apart) * F.lit(width)))).alias("accuracy_cells"))


def multilabel(cells: DataFrame) -> DataFrame:
    """AGG11: per column precision/recall/F1/support (binary per column)."""
    return (cells.withColumn("precision", _div(F.col("tp"), F.col("tp") + F.col("fp")))
                 .withColumn("recall", _div(F.col("tp"), F.col("tp") + F.col("fn")))
                 .withColumn("f1", _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def micro(cells: DataFrame, eps: float = F1_EPS) -> DataFrame:
    """AGG10: precision/recall over all cells, F1 = 2pr/(p+r+eps)."""
    t = cells.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select(p.alias("precision"), r.alias("recall"),
                    (F.lit(2.0) * p * r / (p + r + F.lit(eps))).alias("f1"))


def accuracy_cells(df: DataFrame, y: str, p: str) -> DataFrame:
    """AGG15: share of equal cells x 100 (Hamming accuracy)."""
    eq = F.aggregate(F.zip_with(F.col(y), F.col(p), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return df.agg((F.lit(100.0) * F.sum(eq) / F.sum(F.size(F.col(y)))).alias("accuracy_cells"))


def accuracy_exact(df: DataFrame, y: str, p: str, scale: float = 1.0) -> DataFrame:
    """AGG16: share of equal rows (x100 for the text-to-text scripts)."""
    return df.agg((F.lit(scale) * F.avg((F.col(y) == F.col(p)).cast("double"))).alias("accuracy"))


def batch_mean_loss(df: DataFrame, batch_col: str, loss_col: str) -> DataFrame:
    """AGG20: mean of per-batch means (short last batch over-weighted)."""
    return (df.groupBy(batch_col).agg(F.avg(loss_col).alias("_bl"))
              .agg(F.avg("_bl").alias("loss_batch_mean")))


def report(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """AGG23: one table with per-class, per-block and overall lines:
    ``GROUPING SETS ((block, class), (block), ())`` over the per-column
    counts; ``scope`` from ``grouping_id``. ``blocks`` maps column j to
    ``(block, class)``."""
    t = multilabel(cells).join(checked_broadcast(blocks), "j")
    g = t.groupingSets([["block", "class"], ["block"], []], "block", "class").agg(
        F.grouping_id().alias("_gid"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    scope = F.when(F.col("_gid") == 0, "class").when(F.col("_gid") == 1, "block").otherwise("all")
    return g.withColumn("scope", scope).drop("_gid")


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns -> ``(keys..., metric, value)`` (SNK2 layout)."""
    st = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(st).alias("_m")).select(*keys, "_m.metric", "_m.value")
