"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores the logistic of a bias and
the weights of its distinct words; the document's score is the noisy-or of its
sentences, 1 - prod(1 - p). Only documents are labelled; the weights minimise
the log loss of the noisy-or, so the sentences that offend are found without
sentence labels.

Words are compared by a 64-bit hash of their lower-cased letters. Which words
become features is decided on all labelled learnable rows: the ``FEATURES``
words with the largest chi-square between documents that have them and the
label; for them the distinct words of documents are joined with the labels,
no texts. The weights are fitted on a sample of at most about ``PER_LABEL``
documents of each label (kept by a hash of their id), weighted back to the
label's whole count, until the loss settles (``losses`` of the model).

Cases: null and empty texts score 0 (no sentence); with no labelled row, or
only one label, every text scores 0; texts of any length are scored whole;
repeated rows score alike, labels given more than once count as toxic if one
says so; null ids are never labelled; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import written
from roundlearn.llm.ngram_join import key_bitmap, marked, word_starts
from roundlearn.llm.subword import portions
from roundlearn.operators.gradient import lbfgs_direction
from roundlearn.session import bounded_broadcast, ship_package

FEATURES = 4_096
PER_LABEL = 10_000          # expected most training documents of a label
MIN_DOCS = 5                # of a feature
RIDGE = 1e-3
STEPS = 200                 # at most
TOLERANCE = 1e-4
FLAG = 0.3                  # sentences of this score or more are reported

_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
# A-Z become a-z; ASCII characters that are no letters or digits become spaces
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Bags:
    """Words of many texts with their sentence and text."""

    def __init__(self, texts: list[str | None]):
        self.raw = [t.encode() if t else b"" for t in texts]
        begin = np.cumsum([0, *(len(x) + 1 for x in self.raw)])
        data = b"\n".join(self.raw)
        starts, self.words = word_starts(np.frombuffer(data.translate(_TABLE), np.uint8))
        ends = np.cumsum(_END[np.frombuffer(data, np.uint8)])
        self.doc = np.searchsorted(begin, starts, side="right") - 1
        gap = ends[starts] if len(starts) else np.empty(0, np.int64)      # line ends part texts too
        fresh = np.ones(len(starts), bool)
        fresh[1:] = gap[1:] != gap[:-1]
        self.sentence = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)                     # first word of each sentence
        self.doc_of = self.doc[self.first]
        self.begin, self.starts = begin, starts

    def cells(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, feature) cells for a sorted vocabulary."""
        if not len(vocab) or not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        f = np.minimum(np.searchsorted(vocab, self.words), len(vocab) - 1)
        hit = vocab[f] == self.words
        cell = np.unique(self.sentence[hit] * len(vocab) + f[hit])
        return cell // len(vocab), cell % len(vocab)


def fit_weights(doc: np.ndarray, cells: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray,
                n_features: int, steps: int = STEPS, ridge: float = RIDGE,
                tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, list[float]]:
    """Feature weights and bias that minimise the weighted log loss of the
    noisy-or by L-BFGS, and the loss after each step. ``doc``: the document of
    each sentence. Steps end when one lowers the loss by less than
    ``tolerance`` of it, or after ``steps``."""
    sent, feat = cells
    total = weight.sum()

    def look(theta: np.ndarray) -> tuple[float, np.ndarray]:
        a = np.full(len(doc), theta[-1]) + np.bincount(sent, theta[feat], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(a, -30, 30)))
        keep = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))      # ln of "no sentence offends"
        none = np.exp(keep)
        some = -np.expm1(keep)
        loss = -(weight * np.where(y, np.log(np.maximum(some, 1e-12)), keep)).sum() / total
        g_doc = np.where(y, -none / np.maximum(some, 1e-9), 1.0) * weight / total
        g_sent = g_doc[doc] * p
        g = np.append(np.bincount(feat, g_sent[sent], minlength=n_features), g_sent.sum())
        g[:-1] += ridge * theta[:-1] / max(n_features, 1)
        return float(loss + 0.5 * ridge * (theta[:-1] @ theta[:-1]) / max(n_features, 1)), g

    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    value, g = look(theta)
    losses, moves = [value], []
    while len(losses) <= steps:
        d = lbfgs_direction(g, moves)
        size = 1.0 if moves else 1.0 / max(float(np.linalg.norm(g)), 1e-12)
        while True:
            value2, g2 = look(theta + size * d)
            if value2 <= value + 1e-4 * size * float(g @ d) or size < 1e-10:
                break
            size *= 0.5
        if value2 >= value:
            break
        if float((g2 - g) @ d) > 0:
            moves = [*moves, (size * d, g2 - g)][-10:]
        theta, done = theta + size * d, value - value2 < tolerance * value
        value, g = value2, g2
        losses.append(value)
        if done:
            break
    return theta[:-1], float(theta[-1]), losses


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic", per_label: int = PER_LABEL, features: int = FEATURES) -> dict | None:
    """The model, or None if the labels do not hold both classes."""
    spark = df.sparkSession
    ship_package(spark)
    key = lambda c: F.xxhash64(F.col(c).cast("string"))
    lab = written(labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
                  .groupBy(key(label_id).alias("k")).agg((F.max(label_col) == 1).alias("y")), "toxicity-labels")
    src = df.where(learn & F.col(id_col).isNotNull()).select(key(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    labelled = spark.sparkContext.broadcast(key_bitmap(lab))

    # of the rows that may be labelled only the distinct words move to their labels, no text
    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marked(labelled.value, b.column(0).to_numpy())))
            for p in portions(b, 1):
                if p.num_rows:
                    bags = Bags(p.column(1).to_pylist())
                    order = np.lexsort((bags.words, bags.doc))
                    w, d = bags.words[order], bags.doc[order]
                    fresh = np.ones(len(w), bool)
                    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
                    cuts = np.searchsorted(d[fresh], np.arange(p.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([p.column(0), pa.ListArray.from_arrays(
                        pa.array(cuts, pa.int32()), pa.array(w[fresh].view(np.int64)))], names=["k", "words"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents and toxic documents of each word, and (w null) of all."""
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            toxic = np.repeat(y, b.column(0).value_lengths().to_numpy())
            u, at, c = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True, return_counts=True)
            bad = np.bincount(at, toxic, minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*u.tolist(), None], pa.int64()), pa.array(np.append(c, len(y))),
                                              pa.array(np.append(bad, y.sum()))], names=["w", "docs", "toxic"])

    joined = src.mapInArrow(bags_of, "k long, words array<bigint>").join(lab.hint("merge"), "k")      # one plan at every size
    tally = written(joined.select("words", "y").mapInArrow(words, "w long, docs long, toxic long").groupBy("w")
                    .agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
                    .where(F.col("w").isNull() | (F.col("docs") >= MIN_DOCS)), "toxicity-words")
    total = tally.where("w is null").first()
    n = {True: total["toxic"], False: total["docs"] - total["toxic"]} if total else {True: 0, False: 0}
    if not n[True] or not n[False]:
        return None

    # words of one document only, most of them, cannot be features
    counts = tally.where("w is not null")
    all_, bad = float(n[True] + n[False]), float(n[True])
    expected = F.col("docs") * bad / all_
    chi = (F.col("toxic") - expected) ** 2 / expected * all_ / (all_ - bad)
    best = counts.withColumn("chi", chi).orderBy(F.desc("chi"), "w").limit(features).select("w").toArrow()
    vocab = np.sort(np.ascontiguousarray(best.column(0).to_numpy()).view(np.uint64))

    rate = {y: min(1.0, per_label / n[y]) for y in n}
    spread = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    # about 2 * per_label keys of the labels that learnable rows have; all labels are looked at, so there may be more of them
    chosen = lab.where(spread < F.when(F.col("y"), rate[True]).otherwise(rate[False]))
    picked = src.join(bounded_broadcast(chosen, chosen.count()), "k").select("text", "y", F.xxhash64("k", "text").alias("h"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in portions(b, 0):
                bags = Bags(p.column(0).to_pylist())
                sent, feat = bags.cells(vocab)
                n_sent = np.bincount(bags.doc_of, minlength=p.num_rows)
                first = np.cumsum(n_sent) - n_sent
                by = np.searchsorted(bags.doc_of[sent], np.arange(p.num_rows + 1)) if len(sent) else np.zeros(p.num_rows + 1, int)
                raw = [np.stack([sent[a:z] - f, feat[a:z]]).astype(np.int32).tobytes()
                       for a, z, f in zip(by[:-1].tolist(), by[1:].tolist(), first.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(1), p.column(2), pa.array(n_sent, pa.int64()), pa.array(raw, pa.binary())],
                                                 names=["y", "h", "sentences", "cells"])

    # the bounded sample is fitted in one task
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: r[1])
        y = np.array([r[0] for r in got], bool)
        if y.all() or not y.any():
            return
        weight = np.where(y, 1 / rate[True], 1 / rate[False])
        doc = np.repeat(np.arange(len(got)), [r[2] for r in got])
        base = np.cumsum([0, *(r[2] for r in got)])
        parts = [np.frombuffer(r[3], np.int32).reshape(2, -1) + [[s], [0]] for r, s in zip(got, base.tolist(), strict=False)]
        sent, feat = np.concatenate(parts, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_weights(doc, (sent, feat), y, weight, len(vocab)))], pa.binary())],
                                         names=["model"])

    fitted = picked.mapInArrow(cells, "y boolean, h long, sentences long, cells binary").repartition(1).mapInArrow(one, "model binary").collect()
    if not fitted:
        return None
    w, bias, losses = pickle.loads(fitted[0]["model"])
    return {"vocab": vocab, "w": w, "bias": bias, "losses": losses}


def score_texts(model: dict | None, texts: list[str | None], flag: float = FLAG) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of texts, and the code point ranges and scores of the sentences
    that reach ``flag``."""
    spans: list[list[dict]] = [[] for _ in texts]
    if model is None:
        return np.zeros(len(texts)), spans
    bags = Bags(texts)
    sent, feat = bags.cells(model["vocab"])
    a = np.full(len(bags.first), model["bias"]) + np.bincount(sent, model["w"][feat], minlength=len(bags.first))
    p = 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    out = -np.expm1(np.bincount(bags.doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)))
    for s in np.flatnonzero(p >= flag).tolist():
        d = int(bags.doc_of[s])
        raw, at = bags.raw[d], int(bags.starts[bags.first[s]] - bags.begin[d])
        last = bags.first[s + 1] - 1 if s + 1 < len(bags.first) else len(bags.starts) - 1
        end = int(bags.starts[last] - bags.begin[d])
        while end < len(raw) and _TABLE[raw[end]] != 32:
            end += 1
        a0 = len(raw[:at].decode())
        spans[d].append({"start": a0, "end": a0 + len(raw[at:end].decode()), "score": float(p[s])})
    return np.clip(out, 0.0, 1.0), spans


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", flag: float = FLAG) -> DataFrame:
    """One row per document: doc_id, score and the offending sentences."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)        # FEATURES numbers
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in portions(b, 1):
                s, spans = score_texts(shared.value, p.column(1).to_pylist(), flag)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(s, pa.float64()), pa.array(spans, kind)],
                                                 names=["doc_id", "score", "sentences"])
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, score double, "
                               "sentences array<struct<start:int,end:int,score:double>>")
