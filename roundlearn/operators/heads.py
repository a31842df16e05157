"""Class heads over a fixed feature vector.

Centroid head: per class the mean vector ``mu`` of its training rows,
``logit(x) = x . mu - 0.5 * |mu|^2`` (nearest centroid). It only ever reads
rows of its own class, so adding a round never changes an earlier head.
The mean is a partial (map-side) aggregate: the shuffle carries one
vector per class per task, whatever the class skew.

Trainable heads (``gradient``) have the same form, weights and a bias a class,
so heads of both kinds are scored and fused alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundlearn.functions.columns import ZSCORE_EPS, to_double_array
from roundlearn.session import materialize

HEAD_COLS = ("round", "class", "pos", "class_order", "mu", "bias", "n_train")


def centroid_heads(train: DataFrame, class_col: str, vec_col: str) -> DataFrame:
    """ML1: ``(class, mu array<double>, bias, n_train)``, one row per class."""
    v = train.select(F.col(class_col).alias("class"), array_to_vector(to_double_array(F.col(vec_col))).alias("_v"))
    agg = v.groupBy("class").agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s"))
    mu = vector_to_array(F.col("_s.mean"))
    return agg.select("class", mu.alias("mu"),
                      (F.lit(-0.5) * F.aggregate(mu, F.lit(0.0), lambda a, x: a + x * x)).alias("bias"),
                      F.col("_s.count").cast("bigint").alias("n_train"))


def centroid_heads_long(heads: DataFrame) -> DataFrame:
    """Head weights as ``(class, dim, value)`` rows (saved/loaded form)."""
    return heads.select("class", F.posexplode("mu").alias("dim", "value"))


def heads_from_long(long: DataFrame) -> DataFrame:
    """Inverse of ``centroid_heads_long`` (SRC4): dims put back in order."""
    g = long.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_d"))
    mu = F.transform("_d", lambda s: s["value"])
    return g.select("class", mu.alias("mu"),
                    (F.lit(-0.5) * F.aggregate(mu, F.lit(0.0), lambda a, x: a + x * x)).alias("bias"))


WIDE_CLASSES = 10_000      # heads that a driver holds at once: more are scored block by block


def collect_heads(heads: DataFrame, max_classes: int = WIDE_CLASSES) -> list:
    """The heads as a small local model, in class order. One row per class:
    the size is checked, never the data. ``fuse_blocks`` takes any number."""
    rows = heads.orderBy("class_order").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes do not make one local model: score them with fuse_blocks")
    return rows


def head_blocks(heads: DataFrame, block: int = WIDE_CLASSES):
    """The heads block by block in class order, each read when asked for:
    ``(class_order of each, names, weights (classes x dims), biases)``. Class
    orders need have no gaps filled: blocks are ranges of them."""
    top = heads.agg(F.max("class_order").alias("m")).first()["m"] or 0
    for a in range(0, top + 1, block):
        rows = heads.where(F.col("class_order").between(a, a + block - 1)).orderBy("class_order").collect()
        if rows:
            yield (np.array([r["class_order"] for r in rows]), [str(r["class"]) for r in rows],
                   np.array([list(r["mu"]) for r in rows], np.float64), np.array([float(r["bias"]) for r in rows]))


def fuse_blocks(rows: DataFrame, heads: DataFrame, vec_col: str, block: int = WIDE_CLASSES, zscore: bool = True,
                eps: float = ZSCORE_EPS) -> DataFrame:
    """Fused scores for any number of classes. ``rows``: any columns with
    ``batch_id``, ``y_order`` (class order of the true class, null if it has
    no head) and the vector; ``heads``: class, class_order, mu, bias.

    One block of heads is held at a time: every batch is scored by it in one
    task (z-scores per batch and class need no other class), and a row keeps
    its best score, the first in class order on ties, the logarithm of its
    summed exponentials and the score of its true class. Each block is a pass
    whose narrow state is written before the next. Returns ``rows`` without
    the vector, with ``pred``, ``pred_order`` and ``loss`` (null without a
    head for ``y``); all null for a null vector, which takes no part in the
    batch's statistics."""
    state = (rows.withColumns({"pred": F.lit(None).cast("string"), "pred_order": F.lit(None).cast("int"), "best": F.lit(None).cast("double"),
                               "lse": F.lit(None).cast("double"), "z_true": F.lit(None).cast("double")})
             .repartition("batch_id").sortWithinPartitions("batch_id"))
    schema, passes = state.schema, 0
    for order, names, mu, bias in head_blocks(heads, block):
        if passes:
            state = materialize(state).repartition("batch_id").sortWithinPartitions("batch_id")

        def score(pdf, order=order, names=names, mu=mu, bias=bias):
            there = pdf[vec_col].notna().to_numpy()
            if not there.any():
                return pdf
            own = np.flatnonzero(there)
            z = np.stack(pdf[vec_col].iloc[own].to_numpy()).astype(np.float64) @ mu.T + bias
            if zscore:
                batch = pdf["batch_id"].to_numpy()[own]
                first = np.flatnonzero(np.append(True, batch[1:] != batch[:-1]))
                n = np.diff(np.append(first, len(own)))
                mean = np.add.reduceat(z, first) / n[:, None]
                z = z - np.repeat(mean, n, axis=0)
                std = np.sqrt(np.add.reduceat(z * z, first) / n[:, None])
                z /= np.repeat(std, n, axis=0) + eps
            i = z.argmax(axis=1)
            top = z[np.arange(len(own)), i]
            best, lse = pdf["best"].to_numpy(float, na_value=-np.inf), pdf["lse"].to_numpy(float, na_value=-np.inf)
            pred, pred_order = (pdf[c].astype(object).where(pdf[c].notna(), None).to_numpy(copy=True) for c in ("pred", "pred_order"))
            better = top > best[own]
            for k, c in zip(own[better].tolist(), i[better].tolist(), strict=True):
                pred[k], pred_order[k] = names[c], int(order[c])
            best[own] = np.maximum(best[own], top)
            lse[own] = np.logaddexp(lse[own], top + np.log(np.exp(z - top[:, None]).sum(axis=1)))
            z_true = pdf["z_true"].to_numpy(float, na_value=np.nan)
            y = pdf["y_order"].to_numpy(float, na_value=-1)[own]
            at = np.minimum(np.searchsorted(order, y), len(order) - 1)
            hit = order[at] == y
            z_true[own[hit]] = z[np.flatnonzero(hit), at[hit]]
            nothing = lambda x, empty: [None if e else float(v) for v, e in zip(x, empty, strict=True)]      # noqa: E731
            return pdf.assign(pred=pred, pred_order=pred_order, best=nothing(best, ~there), lse=nothing(lse, ~there),
                              z_true=nothing(z_true, np.isnan(z_true)))

        def run(batches, score=score):
            import pandas as pd
            kept = None                       # rows whose batch may go on in the next Arrow batch
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
                last = (pdf["batch_id"] == pdf["batch_id"].iloc[-1]).to_numpy()
                kept = pdf[last]
                if not last.all():
                    yield score(pdf[~last].reset_index(drop=True))
            if kept is not None:
                yield score(kept.reset_index(drop=True))
        state = state.mapInPandas(run, schema)
        passes += 1
    return state.withColumn("loss", F.col("lse") - F.col("z_true")).drop(vec_col, "best", "lse", "z_true")


def score_wide(rows: DataFrame, heads: list, vec_col: str, out_col: str = "logits") -> DataFrame:
    """JN8: every row meets every head of every round. The heads (one row per
    class) go to each task once, and Arrow batches are scored by a matrix
    product: no join, no shuffle. ``logits`` is in class order; a row with a
    null vector gets null logits."""
    mu = np.array([[float(v) for v in h["mu"]] for h in heads], dtype=np.float64)
    bias = np.array([float(h["bias"]) for h in heads], dtype=np.float64)
    fields = [f for f in rows.schema.fields if f.name != out_col]
    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in fields]

    def score(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            there = pdf[vec_col].notna().to_numpy()
            out = np.full(len(pdf), None, dtype=object)
            if there.any():
                x = np.stack(pdf.loc[there, vec_col].to_numpy()).astype(np.float64)
                for i, z in zip(np.flatnonzero(there), x @ mu.T + bias, strict=True):
                    out[i] = z
            pdf = pdf[names].copy()
            pdf[out_col] = out
            yield pdf

    return rows.mapInPandas(score, schema)


def class_names(heads: list) -> Column:
    return F.array(*[F.lit(str(r["class"])) for r in heads])
