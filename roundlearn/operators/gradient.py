"""Trainable class heads: multinomial logistic regression with a ridge
penalty, fitted to a tolerance.

An objective is a label column with its number of classes; its loss is the mean
cross-entropy of its rows (those whose label lies in ``0 .. n_classes - 1``)
plus ``ridge / 2`` times the squared weights, biases included, so it has one
minimum. Several objectives over the same features are fitted together: their
losses are summed, and one pass over the rows gives the gradients of all. Heads
of rounds with different classes are such a set (a row belongs to the one that
knows its class), and so are the two parts of a dual head.

A pass is one Spark job: every task adds up the gradient and the loss of its
rows under the present weights (matrix products over Arrow batches) and gives
its sums once, ``classes x (dims + 1)`` numbers; the sums of the tasks meet in
one aggregate. ``fit`` drives the passes by L-BFGS until the gradient is below
a tolerance; ``descend`` takes plain steps with momentum, one an epoch, whose
losses and confusion counts are kept for every split. Weights start at zero, so
runs are repeatable; ``descent_sql`` is the same descent in SQL.

Features are an array of numbers, or for sparse ones a struct of ``idx`` and
``val`` arrays with ``dims`` given. A row with null features takes no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundlearn.session import local_frame

RIDGE = 0.01
TOLERANCE = 1e-10          # norm of the gradient, by which the weights lie within TOLERANCE / RIDGE of the minimum
MAX_PASSES = 400
MEMORY = 10                # steps that L-BFGS remembers
SUMS = "obj int, split string, a int, b int, n bigint, value double"


@dataclass(frozen=True)
class Objective:
    label: str
    n_classes: int


@dataclass
class SoftmaxHead:
    """Weights ``(class, dim)`` with the bias last."""
    weights: np.ndarray


@dataclass
class Fit:
    """Fitted heads, one for each objective, and how the fit went: the summed
    objective and the norm of its gradient after every pass, the passes, and
    the loss without penalty and the rows of each objective."""
    heads: list[SoftmaxHead]
    objective: list[float] = field(default_factory=list)
    gradient: list[float] = field(default_factory=list)
    passes: int = 0
    converged: bool = False
    losses: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    epochs: list[dict] = field(default_factory=list)

    def penalised(self, i: int, ridge: float = RIDGE) -> float:
        return self.losses[i] + 0.5 * ridge * float((self.heads[i].weights ** 2).sum())


class Features:
    """The features of a batch with a constant 1 as their last column."""

    def __init__(self, column, dims: int):
        self.dims = dims
        rows = column.to_list()
        if rows and isinstance(rows[0], dict):
            size = np.array([len(r["idx"]) + 1 for r in rows])
            self.ptr = np.cumsum(size) - size
            self.idx = np.concatenate([x for r in rows for x in (np.asarray(r["idx"], np.int64), [dims - 1])])
            self.val = np.concatenate([x for r in rows for x in (np.asarray(r["val"], np.float64), [1.0])])
            self.row = np.repeat(np.arange(len(rows)), size)
            self.x = None
        else:
            x = np.stack(rows).astype(np.float64) if rows else np.zeros((0, dims - 1))
            self.x = np.hstack([x, np.ones((len(x), 1))])

    def scores(self, w: np.ndarray) -> np.ndarray:
        if self.x is not None:
            return self.x @ w.T
        return np.stack([np.add.reduceat(self.val * wk[self.idx], self.ptr) for wk in w], axis=1)

    def back(self, p: np.ndarray) -> np.ndarray:
        """The sum over rows of ``p[row, class] * features``."""
        if self.x is not None:
            return p.T @ self.x
        return np.stack([np.bincount(self.idx, self.val * pk[self.row], minlength=self.dims) for pk in p.T])


def _pass(rows: DataFrame, objectives: Sequence[Objective], vec: str, dims: int, weights: list[np.ndarray],
          split: str | None = None) -> list:
    """Sums over all rows: ``(obj, null, class, dim, null, gradient)`` and
    ``(obj, null, null, null, n, loss)`` over the training rows, and with
    ``split`` also ``(obj, split, y, pred, n, loss)`` over every split."""
    import pandas as pd
    labels = [o.label for o in objectives]

    def run(batches):
        gradient = [np.zeros_like(w) for w in weights]
        loss, count, cells = np.zeros(len(weights)), np.zeros(len(weights), np.int64), {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = Features(pdf[vec], dims)
            train = (pdf[split] == "train").to_numpy() if split else np.ones(len(pdf), bool)
            for i, (o, w) in enumerate(zip(objectives, weights, strict=True)):
                y = pdf[o.label].fillna(-1).to_numpy().astype(np.int64)
                own = (y >= 0) & (y < o.n_classes)
                at = np.flatnonzero(own)
                z = x.scores(w)
                top = z.argmax(axis=1)
                z = z - z.max(axis=1, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=1, keepdims=True)
                ce = np.log(total[at, 0]) - z[at, y[at]]
                if split:
                    for key, s in pd.Series(ce).groupby([pdf[split].to_numpy()[at], y[at], top[at]]):
                        n, v = cells.get((i, *key), (0, 0.0))
                        cells[(i, *key)] = (n + len(s), v + float(s.sum()))
                p /= total
                p[at, y[at]] -= 1.0
                p[~(own & train)] = 0.0
                gradient[i] += x.back(p)
                loss[i] += ce[train[at]].sum()
                count[i] += int(train[at].sum())
        for i, g in enumerate(gradient):
            if count[i]:
                k, d = g.shape
                yield pd.DataFrame({"obj": i, "split": None, "a": np.repeat(np.arange(k), d), "b": np.tile(np.arange(d), k), "n": None,
                                    "value": g.ravel()})
                yield pd.DataFrame({"obj": [i], "split": [None], "a": [None], "b": [None], "n": [count[i]], "value": [loss[i]]})
        if cells:
            yield pd.DataFrame([(*k, *v) for k, v in cells.items()], columns=["obj", "split", "a", "b", "n", "value"])

    cols = [*([split] if split else []), *labels, vec]
    return (rows.select(*cols).mapInPandas(run, SUMS).groupBy("obj", "split", "a", "b")
            .agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect())      # classes x (classes + dims) sums


def _usable(rows: DataFrame, objectives: Sequence[Objective], vec: str, dims: int | None, split: str | None):
    """The rows that take part in some objective, and the number of weights
    of a class (features and bias)."""
    known = F.lit(False)
    for o in objectives:
        known = known | F.coalesce(F.col(o.label).between(0, o.n_classes - 1), F.lit(False))
    rows = rows.where(F.col(vec).isNotNull() & known).select(
        *([split] if split else []), *[F.col(o.label).cast("int").alias(o.label) for o in objectives], vec)
    if dims is None:
        first = rows.select(F.size(vec).alias("d")).first()
        dims = first["d"] if first else 0
    return rows, dims + 1


def _sums(rows: DataFrame, objectives: Sequence[Objective], vec: str, weights: list[np.ndarray], ridge: float,
          split: str | None = None) -> tuple[list[tuple[float, np.ndarray, float, int]], dict]:
    """One pass: for each objective its value, gradient, loss and rows, and
    with ``split`` the cells ``(objective, split) -> [(y, pred, n, loss)]``."""
    gradient = [np.zeros_like(w) for w in weights]
    loss, count, cells = [0.0] * len(weights), [0] * len(weights), {}
    for r in _pass(rows, objectives, vec, weights[0].shape[1], weights, split):
        if r["split"] is not None:
            cells.setdefault((r["obj"], r["split"]), []).append((r["a"], r["b"], r["n"], r["value"]))
        elif r["a"] is None:
            loss[r["obj"]], count[r["obj"]] = r["value"] / r["n"], r["n"]
        else:
            gradient[r["obj"]][r["a"], r["b"]] = r["value"]
    return [(v + 0.5 * ridge * float((w * w).sum()), g / max(n, 1) + ridge * w, v, n)
            for w, g, v, n in zip(weights, gradient, loss, count, strict=True)], cells


class _Lbfgs:
    """The way of one objective to its minimum: ``trial`` is where it wants
    its value and gradient next, ``tell`` takes them."""

    def __init__(self, shape: tuple[int, int], tolerance: float):
        self.w = self.trial = np.zeros(shape)
        self.tolerance, self.steps, self.value, self.done = tolerance, [], None, False

    def tell(self, value: float, g: np.ndarray, loss: float, rows: int) -> None:
        if self.value is None:
            self.first = value
        else:
            norm = float(np.linalg.norm(g))
            # near the minimum the objective's change drowns in rounding: there the gradient decides
            if not (value <= self.value + 1e-4 * self.size * float((self.g * self.d).sum()) or (
                    abs(value - self.value) <= 1e-13 * max(1.0, abs(self.value)) and norm < self.norm)):
                self.size *= 0.5
                self.done = self.size < 1e-10
                self.trial = self.w + self.size * self.d
                return
            s, y = self.trial - self.w, g - self.g
            if float((s * y).sum()) > 1e-300:
                self.steps = [*self.steps, (s.ravel(), y.ravel())][-MEMORY:]
        self.w, self.value, self.g, self.loss, self.rows = self.trial, value, g, loss, rows
        self.norm = float(np.linalg.norm(g))
        self.done = self.norm <= self.tolerance
        self.d = lbfgs_direction(g.ravel(), self.steps).reshape(g.shape)
        self.size = 1.0 if self.steps else min(1.0, 1.0 / max(self.norm, 1e-12))
        self.trial = self.w + self.size * self.d


def fit(rows: DataFrame, objectives: Sequence[Objective], vec: str, dims: int | None = None, ridge: float = RIDGE,
        tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> Fit:
    """The heads that minimise the summed objectives over ``rows`` (training
    rows only), by L-BFGS until each one's gradient has a norm of at most
    ``tolerance`` (or no step lowers it any more in double precision). The
    features are fixed, so each objective has weights and curvature of its
    own, and the sum goes down as each part does; a pass serves all that are
    not done, so there are as many as the slowest one needs."""
    rows, width = _usable(rows, objectives, vec, dims, None)
    ways = [_Lbfgs((o.n_classes, width), tolerance) for o in objectives]
    out = Fit([])
    while out.passes < max_passes and (open_ := [i for i, w in enumerate(ways) if not w.done]):
        sums, _ = _sums(rows, [objectives[i] for i in open_], vec, [ways[i].trial for i in open_], ridge)
        for i, got in zip(open_, sums, strict=True):
            ways[i].tell(*got)
        out.passes += 1
        out.objective.append(sum(w.value for w in ways))
        out.gradient.append(float(np.sqrt(sum(w.norm ** 2 for w in ways))))
    out.heads = [SoftmaxHead(w.w.copy()) for w in ways]
    out.losses, out.rows = [w.loss for w in ways], [w.rows for w in ways]
    out.converged = all(w.norm <= tolerance for w in ways)
    return out


def lbfgs_direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion of L-BFGS."""
    d, alphas = -g, []
    for s, y in reversed(steps):
        a = float(s @ d) / float(s @ y)
        alphas.append(a)
        d = d - a * y
    if steps:
        s, y = steps[-1]
        d = d * (float(s @ y) / float(y @ y))
    for (s, y), a in zip(steps, reversed(alphas), strict=True):
        d = d + (a - float(y @ d) / float(s @ y)) * s
    return d


def momentum(curvature: float, ridge: float = RIDGE) -> tuple[float, float]:
    """(rate, momentum) of the descent for objectives whose curvature lies
    between ``ridge`` and ``curvature`` (half the largest squared length of a
    row's features and the constant, plus the ridge)."""
    a, b = curvature ** 0.5, ridge ** 0.5
    return 4.0 / (a + b) ** 2, ((a - b) / (a + b)) ** 2


def descend(rows: DataFrame, objective: Objective, vec: str, curvature: float, split: str = "split", dims: int | None = None,
            ridge: float = RIDGE, change: float = 1e-4, max_epochs: int = 200) -> Fit:
    """Full-batch steps with momentum on the rows whose ``split`` is
    ``train``, until the objective changes by at most ``change`` of itself.
    ``epochs[t]`` is ``{split: (loss, {(y, pred): n})}`` after t steps."""
    rows, width = _usable(rows, [objective], vec, dims, split)
    rate, beta = momentum(curvature, ridge)
    w = before = np.zeros((objective.n_classes, width))
    out = Fit([])
    while True:
        ((value, g, loss, n),), cells = _sums(rows, [objective], vec, [w], ridge, split)
        out.objective.append(value)
        out.gradient.append(float(np.linalg.norm(g)))
        out.epochs.append({s: (sum(v for *_, v in c) / sum(n for _, _, n, _ in c), {(y, p): n for y, p, n, _ in c})
                           for (_, s), c in cells.items()})
        out.losses, out.rows = [loss], [n]
        out.passes += 1
        out.converged = out.passes > 1 and abs(out.objective[-1] - out.objective[-2]) <= change * abs(out.objective[-1])
        if out.converged or out.passes > max_epochs or not n:
            break
        w, before = w - rate * g + beta * (w - before), w
    out.heads = [SoftmaxHead(w)]
    return out


def evaluate(rows: DataFrame, objectives: Sequence[Objective], vec: str, heads: Sequence[SoftmaxHead], split: str = "split") -> list[dict]:
    """For each objective ``{split: (loss, {(y, pred): n})}`` in one pass."""
    dims = heads[0].weights.shape[1]
    rows, _ = _usable(rows, objectives, vec, dims - 1, split)
    out: list[dict] = [{} for _ in objectives]
    for r in _pass(rows, objectives, vec, dims, [h.weights for h in heads], split):
        if r["split"] is not None:
            out[r["obj"]].setdefault(r["split"], []).append(r)
    return [{s: (sum(r["value"] for r in rs) / sum(r["n"] for r in rs), {(r["a"], r["b"]): r["n"] for r in rs}) for s, rs in seen.items()}
            for seen in out]


def confusion_rows(cells: dict) -> list[tuple[str, str, int]]:
    """``(y, pred, n)`` rows of ``{(y, pred): n}``."""
    return [(str(y), str(p), int(n)) for (y, p), n in cells.items()]


def to_frame(spark: SparkSession, head: SoftmaxHead, round_no: int) -> DataFrame:
    """The weights as ``(round, class, dim, value)`` rows, the form in which
    heads are saved."""
    rows = [(round_no, c, j, float(v)) for c, w in enumerate(head.weights) for j, v in enumerate(w)]
    return local_frame(spark, rows, "round int, class int, dim int, value double")


def from_rows(saved: DataFrame) -> SoftmaxHead:
    """One round's head from its saved rows (classes x dims numbers)."""
    got = saved.select("class", "dim", "value").toPandas()
    return SoftmaxHead(got.pivot(index="class", columns="dim", values="value").sort_index().sort_index(axis=1).to_numpy())


def predict(rows: DataFrame, head: SoftmaxHead, vec: str, keep: list[str]) -> DataFrame:
    """``keep`` and the class of the largest score (the first on ties), with
    all scores; null for null features."""
    weights = head.weights
    kept = rows.select(*keep, vec)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("pred", T.IntegerType()),
                           T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            there = pdf[vec].notna().to_numpy()
            out = pdf[keep].copy()
            pred, logits = np.full(len(pdf), None, dtype=object), np.full(len(pdf), None, dtype=object)
            if there.any():
                z = Features(pdf.loc[there, vec], weights.shape[1]).scores(weights)
                for i, row in zip(np.flatnonzero(there), z, strict=True):
                    pred[i], logits[i] = int(row.argmax()), row
            out["pred"], out["logits"] = pred, logits
            yield out

    return kept.mapInPandas(run, schema)


def descent_sql(rows: str, dims: str, n_classes: str, steps: int, curvature: float, ridge: float = RIDGE, name: str = "") -> str:
    """The descent as CTEs of a ``WITH RECURSIVE``: ``rows`` is a query of
    (id, split, y), ``dims`` one of (id, j, v) with the bias as a dimension of
    its own, ``n_classes`` an expression. ``w<name>`` holds the weights (t, k,
    j, w) of all steps, ``l<name>`` the last ones' (id, split, y, k, l, p), and
    ``o<name>`` the objective after them (loss, objective)."""
    r, x, w = f"rw{name}", f"xs{name}", f"w{name}"
    rate, beta = momentum(curvature, ridge)
    return f"""{r} AS MATERIALIZED ({rows}), {x} AS MATERIALIZED ({dims}),
fit{name} AS MATERIALIZED (SELECT x.* FROM {x} x JOIN {r} r ON x.id = r.id WHERE r.split = 'train'),
{w} AS (SELECT 0 AS t, k, j, CAST(0.0 AS DOUBLE) AS w, CAST(0.0 AS DOUBLE) AS was
  FROM (SELECT unnest(range({n_classes})) AS k) CROSS JOIN (SELECT DISTINCT j FROM {x})
  UNION ALL SELECT w.t + 1, w.k, w.j, w.w - {rate!r} * (coalesce(g.g, 0.0) + {ridge!r} * w.w) + {beta!r} * (w.w - w.was), w.w
  FROM {w} w LEFT JOIN (SELECT p.k, x.j, sum((p.p - CAST(p.k = p.y AS INTEGER)) * x.v) / (SELECT count(*) FROM {r} WHERE split = 'train') AS g
    FROM (SELECT l.id, r.y, l.k, exp(l.l - l.m) / sum(exp(l.l - l.m)) OVER (PARTITION BY l.id) AS p
      FROM (SELECT id, k, l, max(l) OVER (PARTITION BY id) AS m FROM
        (SELECT x.id, w.k, sum(w.w * x.v) AS l FROM fit{name} x JOIN {w} w ON x.j = w.j GROUP BY x.id, w.k)) l JOIN {r} r ON l.id = r.id) p
    JOIN fit{name} x ON p.id = x.id GROUP BY p.k, x.j) g ON w.k = g.k AND w.j = g.j WHERE w.t < {steps}),
l{name} AS MATERIALIZED (SELECT l.t, l.id, r.split, r.y, l.k, l.l, exp(l.l - l.m) / sum(exp(l.l - l.m)) OVER (PARTITION BY l.t, l.id) AS p
  FROM (SELECT *, max(l) OVER (PARTITION BY t, id) AS m FROM (SELECT w.t, x.id, w.k, sum(w.w * x.v) AS l
    FROM {x} x JOIN {w} w ON x.j = w.j WHERE {{at}} GROUP BY w.t, x.id, w.k)) l JOIN {r} r ON l.id = r.id),
o{name} AS (SELECT a.t, a.loss, a.loss + {0.5 * ridge!r} * b.w2 AS objective FROM
  (SELECT t, avg(-ln(p)) AS loss FROM l{name} WHERE k = y AND split = 'train' GROUP BY t) a
  JOIN (SELECT t, sum(w * w) AS w2 FROM {w} GROUP BY t) b ON a.t = b.t)""".replace("{at}", f"w.t = {steps}")


def epochs_sql(ctes: str, steps: int) -> str:
    """``descent_sql``'s CTEs with the scores of every step kept."""
    return ctes.replace(f"WHERE w.t = {steps} GROUP BY", "GROUP BY")


def predictions_sql(src: str, where: str = "true", keys: str = "id, split, y") -> str:
    """(id, split, y, pred, loss) of a table of scores."""
    return (f"(SELECT {keys}, arg_max(k, (l, -k)) AS pred, max(CASE WHEN k = y THEN -ln(p) END) AS loss "
            f"FROM {src} WHERE {where} GROUP BY {keys})")
