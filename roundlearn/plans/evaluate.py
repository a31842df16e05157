"""Round-incremental evaluation (ML6/ML7/ML11): the flagship plan.

rows -> exact seeded 60/40 split -> registry from the round config ->
a head per registered class (centroid, or softmax trained to a tolerance over
its round's classes) -> test rows of known classes in seeded order, batches of
32 -> every head scores every row once -> z-score per (batch, class)
-> argmax (first in class order on ties) -> confusion counts -> per-class
P/R/F1/support, accuracy, weighted P/R/F1, cross-entropy loss.

Shuffles: bucket counts for the split (tiny) and for the batches (from the
keys, before scoring), the class-mean aggregate (partial, one vector per class
per task) or one aggregate a training pass, the batch rank, one exchange on
``batch_id`` for the z-score, and K*K confusion counts. With more classes than
``WIDE_CLASSES`` (or ``block`` given) rows are fused block by block of heads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundlearn.operators import fusion, metrics, rounds, sampling
from roundlearn.operators.heads import WIDE_CLASSES, class_names, collect_heads, fuse_blocks, score_wide
from roundlearn.session import checked_broadcast, local_frame, materialize, small_local

LONG_SCHEMA = ("scope", "class", "class_order", "metric", "value")


def prepare(emb: DataFrame) -> DataFrame:
    return emb.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("y"), "embedding")


def round_heads_of(spark: SparkSession, train: DataFrame, cfg_rounds: Sequence, kinds: dict[int, str] | None = None):
    """``(heads, fit)`` of all rounds: centroid heads (``kinds`` None, no
    fit) or trained ones of the given kinds."""
    if kinds is None:
        return collect_heads(rounds.round_heads(train, rounds.registry_frame(spark, cfg_rounds), "y", "embedding")), None
    return rounds.trained_round_heads(train, rounds.registry_rows(cfg_rounds), "y", "embedding", kinds)


def fused_scores(spark: SparkSession, data: DataFrame, cfg_rounds: Sequence, zscore: str = "batch",
                 seed=42, test: float = 0.4, batch_size: int = 32, batches: bool = True, heads: list | None = None,
                 parts: DataFrame | None = None) -> tuple[DataFrame, list, DataFrame]:
    """ML6: scored test rows ``(key, y, batch_id, logits, z, pred, y_index)``,
    the heads (local model) and the registry. Rows are scored once; without
    ``batches`` they are not ranked and have no ``batch_id``. ``heads`` and
    ``parts`` (the split rows) are made here unless given."""
    # the round config is a driver parameter: its registry is a local relation
    reg = rounds.registry_frame(spark, cfg_rounds)
    s = parts if parts is not None else sampling.split(data, "key", test=test, seed=seed)
    if heads is None:
        heads, _ = round_heads_of(spark, s.where(F.col("split") == "train"), cfg_rounds)
    k = len(heads)
    names = class_names(heads)
    rows = rounds.known_rows(s.where(F.col("split") == "test"), reg, "y").select("key", "y", "embedding")
    # scored where they are read: the exchanges below carry K scores, no vectors
    t = score_wide(rows, heads, "embedding").drop("embedding")
    if batches:
        t = sampling.with_batches(t, "key", seed, batch_size, keys=rows).select("key", "y", "batch_id", "logits")
    if zscore == "batch":
        t = fusion.zscore_batch(t, k)
    elif zscore == "row":
        t = fusion.zscore_row(t)
    elif zscore == "global":
        t = fusion.zscore_global(materialize(t), k)       # read twice: for the statistics and for the scores
    else:
        t = t.withColumn("z", F.col("logits"))
    t = fusion.argmax_predict(t, names)
    return t.withColumn("y_index", (F.array_position(names, F.col("y")) - 1).cast("int")), heads, reg


def fused_blocks(spark: SparkSession, data: DataFrame, cfg_rounds: Sequence, block: int = WIDE_CLASSES, seed=42, test: float = 0.4,
                 batch_size: int = 32) -> tuple[DataFrame, int]:
    """ML6/JN8 for any number of classes: test rows ``(key, y, batch_id, pred,
    pred_order, loss)`` z-scored per batch, and the number of heads. One block
    of heads is on the driver and in a task at a time; rows cross the
    exchanges with their vectors, which are narrower than so many scores."""
    reg = rounds.registry_frame(spark, cfg_rounds)
    s = sampling.split(data, "key", test=test, seed=seed)
    heads = materialize(rounds.round_heads(s.where(F.col("split") == "train"), reg, "y", "embedding"))
    rows = rounds.known_rows(s.where(F.col("split") == "test"), reg, "y").select("key", "y", "embedding")
    rows = sampling.with_batches(rows, "key", seed, batch_size).select("key", "y", "batch_id", "embedding")
    order = checked_broadcast(heads.select(F.col("class").alias("_c"), F.col("class_order").alias("y_order")))
    rows = rows.join(order, F.col("y") == F.col("_c"), "left").drop("_c")
    return fuse_blocks(rows, heads, "embedding", block), heads.count()


def evaluate_rounds(spark: SparkSession, emb: DataFrame, cfg_rounds: Sequence = rounds.EMBEDDING_ROUNDS,
                    zscore: str = "batch", seed=42, kinds: dict[int, str] | None = None, block: int | None = None) -> DataFrame:
    """ML7 over the ``embeddings`` table."""
    return evaluate_frame(spark, prepare(emb), cfg_rounds, zscore, seed, kinds, block)


def evaluate_frame(spark: SparkSession, data: DataFrame, cfg_rounds: Sequence = rounds.STANDARD_ROUNDS,
                   zscore: str = "batch", seed=42, kinds: dict[int, str] | None = None, block: int | None = None) -> DataFrame:
    """ML7: rows ``(key, y, embedding)`` -> long metric table
    ``(scope, class, class_order, metric, value)``. With ``kinds`` the heads
    are trained, and lines of scope ``fit`` tell for each trained round its
    objective and whether the fit reached its tolerance."""
    known = rounds.registry_rows(cfg_rounds)
    fit_lines: list[tuple] = []
    if block or (kinds is None and len(known) > WIDE_CLASSES):
        if zscore != "batch":
            raise ValueError("blocks of heads are fused by the z-scores of batches")
        t, n_heads = fused_blocks(spark, data, cfg_rounds, block or WIDE_CLASSES, seed)
        loss, has_head = F.col("loss"), F.col("loss").isNotNull()
    else:
        parts = sampling.split(data, "key", test=0.4, seed=seed)
        heads = None
        if kinds is not None:
            heads, fit = round_heads_of(spark, parts.where(F.col("split") == "train"), cfg_rounds, kinds)
            trained = sorted({h["round"] for h in heads if h["kind"] == "softmax"})
            fit_lines = [("fit", str(r), None, m, v) for i, r in enumerate(trained) for m, v in (
                ("objective", round(fit.penalised(i), 4)), ("converged", float(fit.converged)))]
        t, heads, _ = fused_scores(spark, data, cfg_rounds, zscore, seed, heads=heads, parts=parts)
        n_heads = len(heads)
        loss, has_head = fusion.row_ce(F.col("z"), F.col("y_index")), F.col("y_index") >= 0
    if n_heads < len(known):
        # a batch that holds a true class without a head has no loss (AGG21)
        loss = F.when(F.min(has_head).over(Window.partitionBy("batch_id")), loss)
    t = t.withColumn("loss", loss)
    # one pass over the scored rows: K*K counts plus the loss sums ride along
    conf = (t.groupBy(F.col("y").cast("string").alias("y"), F.col("pred").cast("string").alias("pred"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss_sum"), F.count("loss").alias("loss_n")))
    # K*K rows: materialize once so every metric below reads the small table
    # instead of re-planning the scoring lineage per branch
    conf = small_local(conf)
    # every registered class has its line, one without training rows too
    labels = local_frame(spark, [(c, order) for _, _, c, order in known], "class string, class_order int")
    pc = metrics.per_class(conf, labels)
    per = metrics.long_metrics(pc.withColumn("scope", F.lit("class")), ["scope", "class", "class_order"],
                               ["precision", "recall", "f1", "support"])
    # every true and every predicted class is registered, so the weighted
    # means over the registered classes equal the open-universe ones
    s = F.sum("support")
    wt = pc.agg(*[(F.sum(F.col(m) * F.col("support")) / s).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])
    cv = conf.agg((F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
                  (F.sum("loss_sum") / F.sum("loss_n")).alias("loss"))
    ov = (metrics.long_metrics(wt, [], ["weighted_precision", "weighted_recall", "weighted_f1"])
          .unionByName(metrics.long_metrics(cv, [], ["accuracy", "loss"])))
    ov = ov.select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("class"),
                   F.lit(None).cast("int").alias("class_order"), "metric", "value")
    out = per.unionByName(ov)
    if fit_lines:
        out = out.unionByName(local_frame(spark, fit_lines, "scope string, class string, class_order int, metric string, value double"))
    return out.select("scope", "class", F.col("class_order").cast("int"), "metric",
                      F.round(F.col("value").cast("double"), 6).alias("value"))
