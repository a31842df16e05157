"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of lower-cased letters (runs of
anything else count as one space), weighted by log term frequency times the
inverse document frequency over all learnable documents, scaled to length 1.
Weights are trained by follow-the-regularised-leader with elastic-net
penalties on a sample of at most about ``PER_LABEL`` documents of each label
(kept by a hash of their id with a probability that gives that number); the
document frequencies and label counts come from all learnable rows. A fifth of
the sample is left out of training: it chooses the penalty, the largest of
``L1`` whose log loss lies within one standard error of the least, and then
sets the temperature that calibrates the scores. The model tells the chosen
penalty, the share of weights that are not zero and the held-back log loss.

Cases: a text that is null or has no letter gets ``und`` with score 0; rows
with a null label are not learned from; with no learnable row at all every
text gets ``und``; texts of any length count whole; equal texts get equal
predictions; null ids stay null and are learnable only if ``learn`` says so;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import written
from roundlearn.llm.subword import portions
from roundlearn.session import ship_package

SIZE = 1 << 15              # hashed features
PER_LABEL = 2_000           # expected most training documents of a label
EPOCHS = 3
ALPHA, BETA, L2 = 1.0, 1.0, 1e-4
L1 = (0.01, 0.1, 0.5)       # penalties to choose from
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


def _is_letter_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


_letters: list[np.ndarray] = []


def grams(text: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of one text."""
    if not _letters:
        _letters.append(_is_letter_table())
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                     # the first of a run of other characters stays, as a space
    keep[0] = True
    c = np.where(letter, codes, 32)[keep].astype(_U)
    feats = [c * _U(0x9E3779B97F4A7C15)]
    feats.append((c[:-1] * _U(0xBF58476D1CE4E5B9)) ^ (c[1:] * _U(0x94D049BB133111EB)) * _U(3))
    if len(c) > 2:
        feats.append((c[:-2] * _U(0xD6E8FEB86659FD93)) ^ (c[1:-1] * _U(0xA0761D6478BD642F)) * _U(5) ^ (c[2:] * _U(0xE7037ED1A0B428DB)) * _U(7))
    h = np.concatenate(feats)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    n = np.bincount((h >> _U(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)
    at = np.flatnonzero(n)
    return at, n[at]


def _weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / (np.sqrt(np.dot(x, x)) or 1.0)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, size: int = SIZE, epochs: int = EPOCHS,
          alpha: float = ALPHA, beta: float = BETA, l1: float = L1[0], l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and biases by FTRL-proximal updates."""
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))
    bias, bias_n = np.zeros(n_labels), np.zeros(n_labels)

    def solve(z, n):
        w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    order = np.arange(len(examples))
    for e in range(epochs):
        np.random.default_rng(e).shuffle(order)
        for i in order.tolist():
            at, x, y = examples[i]
            w = solve(z[at], n[at])
            p = _softmax(x @ w + bias)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    return solve(z, n), bias


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def log_losses(logits: np.ndarray, labels: np.ndarray, t: float = 1.0) -> np.ndarray:
    a = logits / t
    a = a - a.max(1, keepdims=True)
    return np.log(np.exp(a).sum(1)) - a[np.arange(len(labels)), labels]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on ln T."""
    if not len(logits):
        return 1.0
    lo, hi, g = -6.0, 6.0, (5 ** 0.5 - 1) / 2
    loss = lambda u: float(log_losses(logits, labels, np.exp(u)).mean())
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def choose(examples: list, left: list, n_labels: int, size: int = SIZE, penalties: tuple[float, ...] = L1) -> dict:
    """Weights, biases and temperature under the largest penalty whose
    held-back log loss is within one standard error of the least."""
    y = np.array([y for _, _, y in left], np.int64)
    touched = np.unique(np.concatenate([at for at, _, _ in examples]))
    tried = []
    for l1 in penalties if len(left) else penalties[:1]:
        w, bias = train(examples, n_labels, size, l1=l1)
        logits = np.array([x @ w[at] + bias for at, x, _ in left]).reshape(len(left), n_labels)
        t = temperature(logits, y)
        loss = log_losses(logits, y, t) if len(left) else np.zeros(1)
        tried.append({"l1": l1, "w": w.astype(np.float32), "bias": bias, "t": t, "loss": float(loss.mean()),
                      "error": float(loss.std() / np.sqrt(len(loss))), "nonzero": float((w[touched] != 0).mean())})
    least = min(tried, key=lambda m: m["loss"])
    return max((m for m in tried if m["loss"] <= least["loss"] + least["error"]), key=lambda m: m["l1"])


def fit(df: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
        per_label: int = PER_LABEL, size: int = SIZE) -> dict | None:
    """The model as a dictionary of arrays, or None if nothing can be learned."""
    src = df.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"),
        F.xxhash64(F.col(id_col).cast("string"), F.length(F.col(text_col))).alias("h"))
    labels = {r["label"]: r["count"] for r in src.groupBy("label").count().orderBy("label").collect()}   # one row a label
    if not labels:
        return None
    names = sorted(labels)
    rate = F.lit(0.0)
    for x in names:
        rate = F.when(F.col("label") == x, min(1.0, per_label / labels[x])).otherwise(rate)
    spread = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    rows = src.select("text", "label", "h", (spread < rate).alias("picked"))

    # one pass: document frequencies of all rows, the features of the sample
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            out = []
            for t, y, h, pick in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not _LETTER.search(t):
                    continue
                at, n = grams(t, size)
                seen[at] += 1
                if pick:
                    out.append((y, h, at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
            if out:
                y, h, at, n = (list(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y, pa.string()), pa.array(h, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary()),
                     pa.nulls(len(y), pa.int32()), pa.nulls(len(y), pa.int64())], names=["label", "h", "at", "n", "feature", "docs"])
        got = np.flatnonzero(seen)
        if len(got):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(got), pa.string()), pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.binary()),
                 pa.nulls(len(got), pa.binary()), pa.array(got.astype(np.int32)), pa.array(seen[got])],
                names=["label", "h", "at", "n", "feature", "docs"])

    found = written(rows.mapInArrow(features, "label string, h long, at binary, n binary, feature int, docs long"), "langid")
    counts = found.where("feature is not null").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()   # SIZE rows at most
    seen = np.zeros(size)
    seen[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    idf = np.log((1 + sum(labels.values())) / (1 + seen)) + 1

    # the bounded sample is trained in one task
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        examples, left = [], []
        for i, (y, _, at, n) in enumerate(sorted(rows, key=lambda r: (r[1], r))):
            at = np.frombuffer(at, np.int32)
            x = (at, _weighted(at, np.frombuffer(n, np.int32), idf), names.index(y))
            (left if i % 5 == 4 else examples).append(x)
        if not examples:
            return
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(choose(examples, left, len(names), size))], pa.binary())], names=["model"])

    # only the sample moves to that task, whatever else the files hold
    model = found.where("label is not null").select("label", "h", "at", "n").repartition(1).mapInArrow(one, "model binary").collect()
    if not model:
        return None
    return pickle.loads(model[0]["model"]) | {"labels": names, "idf": idf.astype(np.float32), "size": size}


def score(model: dict | None, text: str | None) -> tuple[str, float]:
    if not text or model is None or not _LETTER.search(text):
        return UNKNOWN, 0.0
    at, n = grams(text, model["size"])
    p = _softmax((_weighted(at, n, model["idf"]) @ model["w"][at] + model["bias"]) / model["t"])
    i = int(p.argmax())
    return model["labels"][i], float(p[i])


def predict(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)          # SIZE x labels numbers
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in portions(b, 1):
                got = [score(shared.value, t) for t in p.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([x for x, _ in got], pa.string()),
                                                  pa.array([s for _, s in got], pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, lang_pred string, score double")
