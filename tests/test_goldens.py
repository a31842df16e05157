"""Hand-worked goldens for the metric and fusion operators."""

import math

import pytest
from pyspark.sql import functions as F

from roundlearn.functions import columns as C
from roundlearn.operators import fusion
from roundlearn.operators import metrics as M


def _pc(spark, rows, universe=None):
    df = spark.createDataFrame(rows, "row_id bigint, y string, pred string")
    u = spark.createDataFrame([(c,) for c in universe], "class string") if universe else None
    return {r["class"]: r for r in M.per_class(M.confusion(df), u).collect()}


def test_prf_open_universe_counts_predicted_only_class(spark):
    # 'c' is predicted but never true: precision 0, support 0, still in the universe
    pc = _pc(spark, [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "c")])
    assert set(pc) == {"a", "b", "c"}
    assert pc["a"]["precision"] == 1.0 and pc["a"]["recall"] == 0.5
    assert pc["b"]["precision"] == 0.5 and pc["b"]["recall"] == 0.5
    assert pc["c"]["precision"] == 0.0 and pc["c"]["support"] == 0 and pc["c"]["f1"] == 0.0
    assert pc["a"]["f1"] == pytest.approx(2 / 3)


def test_prf_fixed_universe_absent_class_is_zero(spark):
    pc = _pc(spark, [(1, "a", "a"), (2, "b", "a")], universe=["a", "b", "z"])
    assert set(pc) == {"a", "b", "z"}
    assert pc["z"]["support"] == 0 and pc["z"]["precision"] == 0.0 and pc["z"]["recall"] == 0.0
    assert pc["b"]["recall"] == 0.0 and pc["b"]["precision"] == 0.0      # never predicted


def test_macro_weighted_and_supported(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b")], "row_id bigint, y string, pred string")
    u = spark.createDataFrame([("a",), ("b",), ("z",)], "class string")
    pc = M.per_class(M.confusion(df), u)
    mac = M.macro(pc).first()
    sup = M.macro(pc, F.col("support") > 0).first()
    w = M.weighted(pc).first()
    # a: p=1 r=.5 f=2/3 ; b: p=.5 r=1 f=2/3 ; z: 0
    assert mac["precision"] == pytest.approx(1.5 / 3) and sup["precision"] == pytest.approx(0.75)
    assert w["recall"] == pytest.approx(2 / 3)          # weighted recall = accuracy
    assert M.accuracy(M.confusion(df)).first()["accuracy"] == pytest.approx(2 / 3)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.49,)], "p double")
    got = [r[0] for r in df.select(C.threshold_predict(F.col("p"))).collect()]
    assert got == [0, 1, 0]


def test_argmax_first_wins_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 2.0, 2.0],), ([0.0, -1.0, 5.0],)], "z array<double>")
    got = [r[0] for r in df.select(C.argmax_first(F.col("z"))).collect()]
    assert got == [1, 0, 2]


def test_binary_and_micro_epsilon(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, pred int")
    b = M.binary(df).first()
    assert (b["accuracy"], b["precision"], b["recall"], b["f1"]) == (0.5, 0.5, 0.5, 0.5)
    cells = spark.createDataFrame([(0, 1, 1, 1)], "j int, tp bigint, fp bigint, fn bigint")
    m = M.micro(cells).first()
    assert m["f1"] == pytest.approx(2 * 0.25 / (1.0 + 1e-7))


def test_single_row_batch_zscore_is_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0]), (1, [1.0, 1.0])], "batch_id int, logits array<double>")
    z = {tuple(r["logits"]): r["z"] for r in fusion.zscore_batch(df, 2).collect()}
    assert z[(1.0, 2.0)] == [0.0, 0.0]
    assert z[(3.0, 5.0)][0] == pytest.approx(1 / (1 + 1e-6)) and z[(1.0, 1.0)][1] == pytest.approx(-2 / (2 + 1e-6))


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 0.0)], "x double, z double")
    got = [r[0] for r in df.select(C.bce_with_logits(F.col("x"), F.col("z"))).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == pytest.approx(2 + math.log(1 + math.exp(-2)))
    ce = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 0.0],)], "l array<double>").select(
        C.ce_from_logits(F.col("l"), F.lit(0))).collect()
    assert ce[0][0] == pytest.approx(math.log(2)) and ce[1][0] == pytest.approx(0.0)


def test_accuracy_cells_is_hamming(spark):
    df = spark.createDataFrame([([1, 0, 0, 1], [1, 1, 0, 1])], "y array<int>, p array<int>")
    assert M.accuracy_cells(df, "y", "p").first()[0] == pytest.approx(75.0)


def test_empty_input_gives_empty_metrics(spark):
    df = spark.createDataFrame([], "row_id bigint, y string, pred string")
    assert M.per_class(M.confusion(df)).count() == 0


def test_tokens_mask_pad(spark):
    df = spark.createDataFrame([("a b  c",), ("",)], "t string")
    r = df.select(C.tokenise_hash(F.col("t")).alias("ids")).select(
        "ids", C.pad_truncate(F.col("ids"), 5).alias("p"), C.attention_mask(F.col("ids"), 5).alias("m")).collect()
    assert len(r[0]["ids"]) == 3 and r[0]["m"] == [1, 1, 1, 0, 0] and r[0]["p"][3:] == [0, 0]
    assert r[1]["m"] == [1, 0, 0, 0, 0]          # '' splits to one empty token


def test_scores_of_null_vectors_and_many_classes(spark):
    from roundlearn.operators.heads import score_wide
    heads = [{"class": str(c), "class_order": c + 1, "mu": [0.1 * c, -0.2, 0.3 + c], "bias": -0.5 * c} for c in range(300)]
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "key long, v array<float>")
    got = {r["key"]: r["logits"] for r in score_wide(rows, heads, "v").collect()}
    assert got[2] is None
    assert got[1] == pytest.approx([0.1 * c - 0.4 + 3 * (0.3 + c) - 0.5 * c for c in range(300)], abs=1e-5)
    assert score_wide(rows.where("key = 9"), heads, "v").count() == 0


def test_zscore_batch_keeps_rows_without_logits(spark):
    for k in (4, 300):
        rows = [(i, i // 3, [float((i * 7 + j * 3) % 11) for j in range(k)]) for i in range(10)] + [(99, 0, None)]
        df = spark.createDataFrame(rows, "key long, batch_id int, logits array<double>")
        got = {r["key"]: r["z"] for r in fusion.zscore_batch(df, k).collect()}
        assert len(got) == 11 and got[99] is None
        for j in (0, k - 1):
            x = [r[2][j] for r in rows[:3]]
            mean = sum(x) / 3
            sd = (sum((v - mean) ** 2 for v in x) / 3) ** 0.5
            assert got[1][j] == pytest.approx((x[1] - mean) / (sd + 1e-6), abs=1e-9)


def test_cell_sums_on_empty_and_wide_input(spark):
    df = spark.createDataFrame([([1, 0, 1], [1, 1, 0]), ([0, 0, 1], [0, 1, 1]), ([1, 1, 0], [0, 1, 0])],
                               "y array<int>, p array<int>")
    got = sorted(tuple(r) for r in M.cell_sums(df, "y", "p", 3).collect())
    assert got == [(0, 1, 0, 1, 2), (1, 1, 2, 0, 1), (2, 1, 0, 1, 2)]
    none = sorted(tuple(r) for r in M.cell_sums(df.limit(0), "y", "p", 3).collect())
    assert none == [(j, 0, 0, 0, 0) for j in range(3)]


def test_numbers_are_written_without_exponent(spark):
    from pyspark.sql import types as T
    vals = [1e7, 1e-4, 123456789012.5, 1e12, 0.000001, -2.5e-6, 1234.5, 0.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(C.canon(F.col("v"), T.DoubleType())).collect()]
    assert got == ["10000000.0", "0.0001", "123456789012.5", "1000000000000.0", "0.000001", "-0.0000025", "1234.5", "0.0", "3.0"]
    f32 = spark.createDataFrame([(0.1,)], "v float").select(C.canon(F.col("v"), T.FloatType())).first()[0]
    assert f32 == "0.1"
    assert [r[0] for r in df.select(C.format_metric(F.col("v"))).collect()][6] == "1234.5000"


def test_null_and_unknown_labels_keep_their_rows(spark):
    from roundlearn.operators import labels as L
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "z")], "k int, y string")
    d = spark.createDataFrame([("y", "a", 0), ("y", "b", 1)], "label_col string, label string, id int")
    ids = lambda u, x=df: {r["k"]: r["y_id"] for r in L.encode(x, d, "y", unseen=u).collect()}
    assert ids("keep") == {1: 0, 2: None, 3: 1, 4: -1}
    assert ids("skip") == {1: 0, 2: None, 3: 1}
    assert ids("error", df.where("k < 4")) == {1: 0, 2: None, 3: 1}
    back = L.decode(L.encode(df, d, "y", unseen="keep"), d, "y", "y_id", "label")
    assert {r["k"]: r["label"] for r in back.collect()} == {1: "a", 2: None, 3: "b", 4: None}


def test_stratified_cap_keeps_rows_without_class(spark):
    from roundlearn.operators import sampling as S
    rows = [(i, "a" if i % 2 else None) for i in range(20)] + [(None, "k")]
    df = spark.createDataFrame(rows, "id long, c string")
    for keep, n in (((), [3, 3, 1]), (("a",), [3, 10, 1])):
        got = S.stratified_cap(df, "c", "id", 3, keep_all=keep).groupBy("c").count().collect()
        assert {r["c"]: r["count"] for r in got} == dict(zip([None, "a", "k"], n, strict=True))


def test_evaluation_counts_a_registered_class_without_training_rows(spark):
    from roundlearn.operators import sampling as S
    from roundlearn.plans.evaluate import evaluate_frame
    keys = spark.range(200).select(F.col("id").alias("key"))
    split = {r["key"]: r["split"] for r in S.split(keys, "key", test=0.4, seed=42).collect()}
    rows = []
    for k, part in sorted(split.items()):
        y = "late" if part == "test" and k % 9 == 0 else ("a", "b")[k % 2]
        rows.append((k, y, [1.0, 0.0] if y == "a" else [0.0, 1.0]))
    data = spark.createDataFrame(rows, "key long, y string, embedding array<double>")
    got = {(r["scope"], r["class"], r["metric"]): r["value"]
           for r in evaluate_frame(spark, data, [(0, ["a", "b"]), (1, ["late"])], zscore="none").collect()}
    late = sum(y == "late" for _, y, _ in rows)
    assert late and got["class", "late", "support"] == late and got["class", "late", "recall"] == 0
    assert got["overall", None, "weighted_recall"] == got["overall", None, "accuracy"] < 1
