"""Trained heads to a tolerance, sparse text features, heads in blocks, and
plans that score once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundlearn.functions import columns as C
from roundlearn.operators import gradient, heads, rounds, text_features
from roundlearn.operators import sampling as S
from roundlearn.operators.gradient import Objective
from roundlearn.plans import evaluate

SF_SMALL = "/root/testdata/sf0.001"


def newton(x, y, k, ridge=gradient.RIDGE, steps=60):
    """The minimum by Newton's method on the whole Hessian, damped."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n, d = x.shape
    w = np.zeros((k, d))

    def value(w):
        z = x @ w.T
        z = z - z.max(1, keepdims=True)
        return (np.log(np.exp(z).sum(1)) - z[np.arange(n), y]).mean() + 0.5 * ridge * (w ** 2).sum()
    for _ in range(steps):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(k)[y]).T @ x / n + ridge * w).ravel()
        h = ridge * np.eye(k * d)
        for a in range(k):
            for b in range(k):
                q = p[:, a] * ((a == b) - p[:, b])
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] += (x * q[:, None]).T @ x / n
        step, size = np.linalg.solve(h, g).reshape(k, d), 1.0
        while value(w - size * step) > value(w) and size > 1e-8:
            size /= 2
        w = w - size * step
    return w


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    return rng.normal(size=(300, 4)) + np.eye(4)[y] * 1.5, y, rng.integers(0, 2, 300)


def test_fit_reaches_the_minimum(spark, points):
    x, y, _ = points
    rows = [(int(c), [float(v) for v in r]) for r, c in zip(x, y)] + [(1, None), (None, [1.0] * 4), (7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "y int, v array<double>").repartition(5)       # the last three take no part
    fit = gradient.fit(df, [Objective("y", 3)], "v")
    assert fit.converged and fit.gradient[-1] <= gradient.TOLERANCE and fit.rows == [300]
    assert np.allclose(fit.heads[0].weights, newton(x, y, 3), atol=1e-7)
    assert all(b <= a + 1e-12 for a, b in zip(fit.objective, fit.objective[1:])) and math.isclose(fit.objective[0], math.log(3))
    assert math.isclose(fit.penalised(0), fit.objective[-1], rel_tol=1e-12)
    got = gradient.predict(df, fit.heads[0], "v", ["y"]).collect()
    assert sum(r["pred"] is None for r in got) == 1
    back = gradient.from_rows(gradient.to_frame(spark, fit.heads[0], 0))
    assert np.array_equal(back.weights, fit.heads[0].weights)


def test_joint_objectives_share_their_passes(spark, points):
    """Two objectives in one fit give what two fits give, in fewer passes."""
    x, y, t = points
    df = spark.createDataFrame([(int(a), int(b), [float(v) for v in r]) for r, a, b in zip(x, y, t)], "y int, t int, v array<double>")
    both = gradient.fit(df, [Objective("y", 3), Objective("t", 2)], "v")
    one, two = gradient.fit(df, [Objective("y", 3)], "v"), gradient.fit(df, [Objective("t", 2)], "v")
    assert np.allclose(both.heads[0].weights, one.heads[0].weights, atol=1e-7)
    assert np.allclose(both.heads[1].weights, two.heads[0].weights, atol=1e-7)
    assert both.converged and both.passes <= max(one.passes, two.passes) + 2
    assert math.isclose(both.objective[-1], one.objective[-1] + two.objective[-1], rel_tol=1e-10)


def test_sparse_features_equal_dense_ones(spark, points):
    x, y, _ = points
    x = np.where(np.abs(x) > 0.8, x, 0.0)
    rows = [(int(c), [float(v) for v in r], {"idx": [int(i) for i in np.flatnonzero(r)], "val": [float(v) for v in r[r != 0]]})
            for r, c in zip(x, y)]
    df = spark.createDataFrame(rows, "y int, v array<double>, s struct<idx: array<int>, val: array<double>>").repartition(3)
    a, b = gradient.fit(df, [Objective("y", 3)], "v"), gradient.fit(df, [Objective("y", 3)], "s", 4)
    assert np.allclose(a.heads[0].weights, b.heads[0].weights, atol=1e-8)
    p, q = (sorted((r["y"], r["pred"]) for r in gradient.predict(df, b.heads[0], c, ["y"]).collect()) for c in ("v", "s"))
    assert p == q


def test_task_sums_do_not_grow_with_batches(spark, points):
    """A task gives its sums once, however many Arrow batches it reads."""
    x, y, _ = points
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for r, c in zip(x, y)], "y int, v array<double>").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        real = type(df).mapInPandas
        type(df).mapInPandas = lambda self, f, s, *a, **k: made.append(real(self, f, s, *a, **k)) or made[-1]
        gradient._pass(df, [Objective("y", 3)], "v", 5, [np.zeros((3, 5))])
    finally:
        type(df).mapInPandas = real
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert made[0].count() == 3 * 5 + 1


def test_no_training_rows(spark):
    df = spark.createDataFrame([("test", 0, [1.0])], "split string, y int, v array<double>")
    fit = gradient.fit(df.where("false"), [Objective("y", 2)], "v")
    assert not fit.heads[0].weights.any() and fit.converged
    fit = gradient.descend(df, Objective("y", 2), "v", 1.0)
    assert not fit.heads[0].weights.any() and "train" not in fit.epochs[-1] and fit.epochs[-1]["test"][1] == {(0, 0): 1}


def test_descent_comes_near_the_minimum(spark, points):
    x, y, _ = points
    rows = [("train" if i % 3 else "val", int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "split string, y int, v array<double>")
    curvature = 0.5 * float((x ** 2).sum(1).max() + 1) + gradient.RIDGE
    fit = gradient.descend(df, Objective("y", 3), "v", curvature, change=1e-9)
    keep = np.arange(300) % 3 > 0
    assert fit.converged and np.allclose(fit.heads[0].weights, newton(x[keep], y[keep], 3), atol=1e-2)
    assert sum(n for n in fit.epochs[-1]["val"][1].values()) == 100
    assert fit.epochs[-1]["train"][0] < fit.epochs[0]["train"][0] - 0.3


def test_text_vectors(spark):
    texts = ["a b a", "", None, " lead and trail ", "\ttab\nline x y z", "é ü é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in text_features.text_vectors(df, "t", ["i"], dims=64).collect()}
    ids = {r.i: r.ids for r in df.select("i", C.tokenise_hash(F.col("t"), text_features.VOCAB).alias("ids")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        n = np.bincount(np.array(ids[i]) % 64, minlength=64)
        v = np.log1p(n)
        assert got[i].idx == np.flatnonzero(n).tolist()
        assert np.allclose(got[i].val, (v / np.sqrt((v * v).sum()))[n > 0])


def test_round_heads_of_two_kinds(spark):
    """Trained heads see only their round's rows; a round with one class and
    one that is asked for get centroids; adding a round changes no head."""
    rng = np.random.default_rng(5)
    label = rng.integers(0, 6, 240)
    x = rng.normal(size=(240, 3)) + np.eye(6)[label][:, :3] * 2
    df = spark.createDataFrame([(i, str(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, label))],
                               "key int, y string, embedding array<double>")
    cfg = [(0, ["0", "1"]), (1, ["2"]), (2, ["3", "4"]), (3, ["5", "0"])]
    got, fit = rounds.trained_round_heads(df, rounds.registry_rows(cfg), "y", "embedding", {2: "centroid"})
    assert [(h["class"], h["kind"]) for h in got] == [("0", "softmax"), ("1", "softmax"), ("2", "centroid"), ("3", "centroid"),
                                                      ("4", "centroid"), ("5", "centroid")]
    m = label < 2
    w = newton(x[m], label[m], 2)
    assert fit.converged and fit.rows == [int(m.sum())]
    assert np.allclose([h["mu"] for h in got[:2]], w[:, :-1], atol=1e-7) and np.allclose([h["bias"] for h in got[:2]], w[:, -1], atol=1e-7)
    assert np.allclose(got[2]["mu"], x[label == 2].mean(0))
    few, _ = rounds.trained_round_heads(df, rounds.registry_rows(cfg[:1]), "y", "embedding")
    assert np.allclose([h["mu"] for h in few], [h["mu"] for h in got[:2]], atol=1e-7)


def plain_fusion(x, batch, mu, bias, y):
    z = x @ mu.T + bias
    for b in np.unique(batch):
        m = batch == b
        z[m] = (z[m] - z[m].mean(0)) / (z[m].std(0) + C.ZSCORE_EPS)
    top = z.max(1)
    lse = top + np.log(np.exp(z - top[:, None]).sum(1))
    return z.argmax(1), lse - z[np.arange(len(x)), np.maximum(y, 0)]


@pytest.mark.parametrize("classes,block,per_batch", [(20_000, 8_192, 16), (9, 4, 32), (5, 5, 7)])
def test_any_number_of_classes(spark, classes, block, per_batch):
    rng = np.random.default_rng(classes)
    mu, bias = rng.normal(size=(classes, 3)), rng.normal(size=classes)
    x, y = rng.normal(size=(64, 3)), rng.integers(-1, classes, 64)
    batch = np.arange(64) // per_batch
    hd = spark.createDataFrame([(f"c{k}", k + 1, m, float(b)) for k, (m, b) in enumerate(zip(mu.tolist(), bias))],
                               "class string, class_order int, mu array<double>, bias double")
    rows = [(i, int(b), int(c) + 1 if c >= 0 else None, v) for i, (b, c, v) in enumerate(zip(batch, y, x.tolist()))] + [(99, 0, 1, None)]
    df = spark.createDataFrame(rows, "key int, batch_id int, y_order int, v array<double>").repartition(5)
    got = {r.key: r for r in heads.fuse_blocks(df, hd, "v", block).collect()}
    pred, loss = plain_fusion(x, batch, mu, bias, y)
    assert len(got) == 65 and got[99].pred is None and got[99].loss is None
    for i in range(64):
        assert got[i].pred == f"c{pred[i]}" and got[i].pred_order == pred[i] + 1
        assert got[i].loss is None if y[i] < 0 else math.isclose(got[i].loss, loss[i], rel_tol=1e-9, abs_tol=1e-9)
    assert sum(1 for _ in heads.head_blocks(hd, block)) == -(-(classes + 1) // block)


def test_ties_over_blocks_take_the_first_class(spark):
    rng = np.random.default_rng(1)
    mu, bias, x = rng.integers(-2, 3, (40, 2)), rng.integers(-1, 2, 40), rng.integers(-3, 4, (50, 2))     # whole numbers: exact ties
    hd = spark.createDataFrame([(f"c{k}", k, [float(v) for v in m], float(b)) for k, (m, b) in enumerate(zip(mu, bias))],
                               "class string, class_order int, mu array<double>, bias double")
    df = spark.createDataFrame([(i, i // 8, 0, [float(v) for v in r]) for i, r in enumerate(x)],
                               "key int, batch_id int, y_order int, v array<double>")
    want = (x @ mu.T + bias).argmax(1)
    for block in (3, 7, 100):
        assert {r.key: r.pred_order for r in heads.fuse_blocks(df, hd, "v", block, zscore=False).collect()} == dict(enumerate(want.tolist()))


def test_evaluation_with_more_classes_than_one_model_holds(spark, monkeypatch):
    """The evaluation goes by blocks above the bound and gives the same."""
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = sorted(map(tuple, evaluate.evaluate_rounds(spark, emb).collect()), key=str)
    monkeypatch.setattr(evaluate, "WIDE_CLASSES", 4)
    assert sorted(map(tuple, evaluate.evaluate_rounds(spark, emb).collect()), key=str) == want


@pytest.mark.parametrize("key", ["fused_predict", "score_by_heads", "zscore_batch", "zscore_global", "argmax_class"])
def test_rows_are_scored_once(spark, key):
    import __spark_entry__ as E
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == (0 if key == "zscore_global" else 1)      # the global variant reads written scores


def test_rank_from_keys_is_the_rank(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2).repartition(7)
    a = {r.id: r.r for r in S.hash_rank(df, "id", rank_col="r").collect()}
    b = {r.id: r.r for r in S.hash_rank(df, "id", rank_col="r", keys=spark.range(5000)).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 5001))


def test_fused_kinds_agree_with_plain_numpy(spark):
    emb = evaluate.prepare(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    parts = S.split(emb, "key", test=0.4)
    hs, fit = evaluate.round_heads_of(spark, parts.where("split = 'train'"), rounds.EMBEDDING_ROUNDS, {})
    t, _, _ = evaluate.fused_scores(spark, emb, rounds.EMBEDDING_ROUNDS, heads=hs, parts=parts)
    rows = {r.key: r for r in parts.collect()}
    got = t.select("key", "batch_id", "pred").collect()
    x, batch = np.array([rows[r.key].embedding for r in got]), np.array([r.batch_id for r in got])
    pred, _ = plain_fusion(x, batch, np.array([h["mu"] for h in hs]), np.array([h["bias"] for h in hs]), np.zeros(len(got), int))
    assert fit.converged and [r.pred for r in got] == [hs[i]["class"] for i in pred]


# ---- stored tables, saved models, streams, wide label sets

def test_stored_tables_pair_without_a_shuffle(spark):
    import __spark_entry__ as E
    df = E.queries()["pair_predictions"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "Join" in plan


def test_a_worker_unpacks_a_version_once(spark):
    from roundlearn.operators import scorer
    from roundlearn.session import scratch_path, ship_package
    from roundlearn.sources import sinks
    ship_package(spark)
    hd = [("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 0.0), ("b", 1, 1.0)]
    long = spark.createDataFrame(hd, "class string, dim int, value double").withColumn("round", F.lit(0))
    df = spark.createDataFrame([(i, [float(i % 2), float((i + 1) % 2)] if i % 50 else None) for i in range(2000)],
                               "i int, v array<double>").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        seen = {}
        for version in ("v1", "v2", "v1"):
            path = scratch_path(spark, version)
            sinks.save_heads(long, path)
            packed = spark.sparkContext.broadcast(scorer.pack(spark, path, {"b": 1, "a": 2}))
            got = scorer.score(df, version, packed, "v", ["i"]).collect()
            assert {r.i: r.pred for r in got} == {i: None if i % 50 == 0 else "a" if i % 2 else "b" for i in range(2000)}
            assert len({r.loads for r in got}) == 1         # forty batches, no load in between
            seen[version] = got[0].loads
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    import inspect
    assert "LinearModel" not in inspect.getsource(scorer.score)


def _batches(spark, n=4):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 3 + b)), [float(v) for v in rng.normal(size=3)], b) for b in range(n) for i in range(b * 30, b * 30 + 30)]
    df = spark.createDataFrame(rows, "key int, label int, embedding array<double>, b int")
    return rows, [df.where(F.col("b") == b).drop("b") for b in range(n)]


def test_merged_heads_are_the_batch_heads_and_replay_changes_nothing(spark):
    from roundlearn.session import scratch_path
    from roundlearn.streaming import heads_stream as H
    rows, parts = _batches(spark)
    path = scratch_path(spark, "state")
    for i in (0, 1, 2, 2, 3, 1):                       # replayed and late repeated ones
        H.add_statistics(parts[i], i, path, "label", "embedding")
    first = {c: min(b for _, k, _, b in rows if k == c) for c in {k for _, k, _, _ in rows}}
    for policy in ("merge", "frozen"):
        got = {r["class"]: r for r in H.heads_of(spark, path, policy).collect()}
        assert set(got) == {str(c) for c in first}
        rounds_ = {b: i for i, b in enumerate(sorted(set(first.values())))}
        for c, b0 in first.items():
            own = np.array([v for _, k, v, b in rows if k == c and (policy == "merge" or b == b0)])
            assert got[str(c)].n_train == len(own) and np.allclose(got[str(c)].mu, own.mean(0)) and got[str(c)]["round"] == rounds_[b0]
    assert {r["class"] for r in H.heads_of(spark, path, upto=0).collect()} == {str(c) for c, b in first.items() if b == 0}
    with pytest.raises(ValueError):
        H.heads_of(spark, path, "newest")


def test_merged_moments_are_those_of_all_rows(spark):
    from roundlearn.session import scratch_path
    from roundlearn.streaming import heads_stream as H
    rows, parts = _batches(spark)
    hs = [{"class": c, "mu": m, "bias": b} for c, m, b in (("0", [1.0, 0.0, 2.0], 0.5), ("1", [0.0, -1.0, 1.0], 1000.0), ("2", [2.0, 1.0, 0.0], 0.0))]
    path = scratch_path(spark, "scores")
    for i in (0, 1, 2, 3, 2, 0):
        H.add_scores(parts[i], i, path, hs, "label", "embedding", ["key"])
    x = np.array([v for _, _, v, _ in rows])
    z = x @ np.array([h["mu"] for h in hs]).T + np.array([h["bias"] for h in hs])
    assert np.allclose(H.merged_moments(spark, path), np.stack([z.mean(0), z.std(0)], 1), rtol=1e-10)
    want = ((z - z.mean(0)) / (z.std(0) + C.ZSCORE_EPS)).argmax(1)
    got = {r.key: r.pred for r in H.fused(spark, path, ["0", "1", "2"]).collect()}
    assert got == {rows[i][0]: str(want[i]) for i in range(len(rows))}


def test_wide_label_sets(spark):
    """Ten thousand labels, a few set in a row: sums and accuracies equal
    those of the whole matrix, and rows give cells for set labels only."""
    from roundlearn.operators import metrics as M
    width, rng = 10_000, np.random.default_rng(4)
    rows = [(i, *[sorted({int(v) for v in rng.integers(0, width, rng.integers(0, 6))} | ({7} if i % 2 else set())) for _ in range(2)])
            for i in range(400)] + [(900, [], []), (901, [3], [3])]
    df = spark.createDataFrame(rows, "i int, y array<int>, p array<int>")
    y, p = np.zeros((402, width), int), np.zeros((402, width), int)
    for k, (_, a, b) in enumerate(rows):
        y[k, a], p[k, b] = 1, 1
    got = np.array([[r.j, r.tp, r.fp, r.fn, r.support] for r in M.cell_sums_of_sets(df, "y", "p", width).orderBy("j").collect()])
    assert np.array_equal(got, np.stack([np.arange(width), (y & p).sum(0), ((1 - y) & p).sum(0), (y & (1 - p)).sum(0), y.sum(0)], 1))
    assert math.isclose(M.accuracy_cells_of_sets(df, "y", "p", width).first()[0], 100.0 * (y == p).mean())
    small = spark.createDataFrame([([1, 0, 1], [1, 1, 0], [0, 2], [0, 1])], "y array<int>, p array<int>, ys array<int>, ps array<int>")
    assert M.cell_sums(small, "y", "p", 3).orderBy("j").collect() == M.cell_sums_of_sets(small, "ys", "ps", 3).orderBy("j").collect()


def test_hashed_ids_are_the_expression(spark):
    df = spark.createDataFrame([(1, "a b  a\tc\n"), (2, ""), (3, None), (4, " x é 日本")], "i int, t string")
    want = {r.i: r.ids for r in df.select("i", C.tokenise_hash(F.col("t")).alias("ids")).collect()}
    assert {r.i: r.ids for r in text_features.hashed_ids(df, "t", ["i"]).collect()} == want


def test_dictionary_orders_like_the_engine(spark):
    from roundlearn.operators import labels as L
    vals = [float("nan"), -2.5, 10.0, 1e300, 0.0, float("inf"), -float("inf")]
    df = spark.createDataFrame([(v, s, i) for v, s, i in zip(vals, ["b", "a", "é", "Z", "日", "aa", "B"], [10, 2, -1, 33, 4, 5, 6])], "d double, s string, i int")
    got = {(r.label_col, r.label): r.id for r in L.fit_dictionary(df, ["d", "s", "i"]).collect()}
    for c in ("d", "s", "i"):
        order = [str(r[0]) for r in df.orderBy(c).select(F.col(c).cast("string")).collect()]
        assert [k for (col_, k), _ in sorted(((x, n) for x, n in got.items() if x[0] == c), key=lambda t: t[1])] == order


def test_texts_are_cut_and_remembered_in_bounds(monkeypatch):
    import re

    import pyarrow as pa
    rnd, plain = np.random.default_rng(3), re.compile(r"[ \t\n\x0b\f\r]+")
    for _ in range(300):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice(list("a é\t\n\x0b"), rnd.integers(9))) for _ in range(rnd.integers(6))]
        tokens, n = text_features.cut(pa.array(texts, pa.string()))
        want = [[] if t is None else plain.split(t) for t in texts]
        assert tokens.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]
    monkeypatch.setattr(text_features, "CACHED", 50)
    monkeypatch.setattr(text_features, "PART_BYTES", 1_000)
    known = text_features._Ids(text_features.VOCAB)
    for part in range(20):
        words = [f"w{part}x{i}" for i in range(500)]
        tokens, _ = text_features.cut(pa.array([" ".join(words)]))
        assert known.of(tokens).tolist() == [text_features.token_id(w) for w in words]
        assert len(known.young) + len(known.old) <= 4 * 50 + 2
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 400, None, "", "y" * 3_000, "z"] * 9)], names=["t"])
    got = list(text_features._portions(b.slice(1), 0))
    assert pa.Table.from_batches(got).column("t").to_pylist() == b.column("t").to_pylist()[1:]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 1_000 for p in got)
