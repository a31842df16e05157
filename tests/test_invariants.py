"""Invariants on the driver tables (fixed seeds)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from roundlearn.operators import labels as L
from roundlearn.operators import rounds as RD
from roundlearn.operators import sampling as S
from roundlearn.sources.tables import table


def _events(spark, d=SF_MID):
    return table(spark, d, "events").select("event_id", "event_type", "user_id", "value")


def test_split_exact_disjoint_complete(spark):
    e = _events(spark)
    n = e.count()
    s = S.split(e, "event_id", test=0.4, val=0.2)
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    t = -(-n * 2 // 5)
    v = -(-(n - t) // 5)
    assert sizes == {"test": t, "val": v, "train": n - t - v}
    assert s.select("event_id").distinct().count() == n


def test_split_and_rank_equal_brute_force_and_partitioning(spark):
    e = _events(spark, SF_SMALL)
    h = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")))
    brute = e.withColumn("r", F.row_number().over(Window.orderBy(h, "event_id")))
    ranked = S.hash_rank(e.repartition(7), "event_id", rank_col="r")
    a = {r["event_id"]: r["r"] for r in brute.collect()}
    b = {r["event_id"]: r["r"] for r in ranked.collect()}
    assert a == b
    s1 = {r["event_id"]: r["split"] for r in S.split(e, "event_id").collect()}
    s2 = {r["event_id"]: r["split"] for r in S.split(e.repartition(13), "event_id", hex_digits=2).collect()}
    assert s1 == s2
    n = len(a)
    assert all((s1[k] == "test") == (a[k] <= -(-n * 2 // 5)) for k in a)


def test_stratified_cap_equals_brute_force_on_skewed_classes(spark):
    e = _events(spark, SF_MID)
    # a skewed class column: one class holds more than a third of the rows
    sk = e.withColumn("cls", F.when(F.col("value") < 100, F.lit("hot")).otherwise(F.col("event_type")))
    got = S.stratified_cap(sk, "cls", "event_id", 300, keep_all=["error"])
    h = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")))
    brute = (sk.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy(h, "event_id")))
               .where((F.col("rn") <= 300) | (F.col("cls") == "error")))
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in brute.select("event_id").collect())


def test_dictionary_dense_numeric_order_and_roundtrip(spark):
    e = _events(spark, SF_SMALL)
    dic = L.fit_dictionary(e, ["event_type", "user_id"])
    ids = [r["label"] for r in dic.where("label_col = 'user_id'").orderBy("id").collect()]
    assert ids == [str(x) for x in sorted(int(i) for i in ids)]          # numbers in numeric order
    for c in ("event_type", "user_id"):
        got = sorted(r["id"] for r in dic.where(F.col("label_col") == c).collect())
        assert got == list(range(len(got)))
    enc = L.encode(e, dic, "event_type", "tid")
    dec = L.decode(enc, dic, "event_type", "tid", "back")
    assert dec.where(F.col("back") != F.col("event_type")).count() == 0


def test_unseen_label_policy(spark):
    e = _events(spark, SF_SMALL)
    dic = L.fit_dictionary(e.where(F.col("event_type") != "error"), ["event_type"])
    with pytest.raises(L.UnseenLabelError):
        L.encode(e, dic, "event_type")
    kept = L.encode(e, dic, "event_type", unseen="keep")
    assert kept.where(F.col("event_type_id") == -1).count() == e.where(F.col("event_type") == "error").count()


def test_support_sums_to_rows_and_weighted_recall_is_accuracy(spark):
    from roundlearn.operators import metrics as M
    from roundlearn.plans.common import pseudo_pred
    e = _events(spark)
    p = e.select(F.col("event_type").alias("y"), pseudo_pred(F.col("value"), F.col("event_type")).alias("pred"))
    conf = M.confusion(p)
    pc = M.per_class(conf)
    assert pc.agg(F.sum("support")).first()[0] == e.count()
    assert M.weighted(pc).first()["recall"] == pytest.approx(M.accuracy(conf).first()["accuracy"])


def test_registry_python_and_dataframe_agree(spark):
    from roundlearn.plans.q_embeddings import EDGE_ROUNDS
    rows = RD.registry_rows(EDGE_ROUNDS, present={str(i) for i in range(10)})
    df = RD.registry(RD.config_table(spark, EDGE_ROUNDS),
                     present=spark.createDataFrame([(str(i),) for i in range(10)], "class string"))
    got = sorted(tuple(r) for r in df.select("round", "pos", "class", "class_order").collect())
    assert got == sorted(rows)
    assert [r[3] for r in sorted(rows)] == list(range(1, len(rows) + 1))     # every class once, in order


def test_earlier_heads_do_not_change_when_a_round_is_added(spark):
    from roundlearn.plans.evaluate import prepare
    e = prepare(table(spark, SF_SMALL, "embeddings"))
    train = S.split(e, "key").where("split = 'train'")
    two = RD.round_heads(train, RD.registry_frame(spark, RD.EMBEDDING_ROUNDS[:2]), "y", "embedding")
    four = RD.round_heads(train, RD.registry_frame(spark, RD.EMBEDDING_ROUNDS), "y", "embedding")
    a = {r["class"]: r["bias"] for r in two.collect()}
    b = {r["class"]: r["bias"] for r in four.collect()}
    assert all(b[c] == pytest.approx(a[c], abs=1e-12) for c in a)


def test_zscore_mean_zero_per_batch_and_class(spark):
    from roundlearn.plans.evaluate import fused_scores, prepare
    t, heads, _ = fused_scores(spark, prepare(table(spark, SF_MID, "embeddings")), RD.EMBEDDING_ROUNDS)
    k = len(heads)
    m = t.groupBy("batch_id").agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(k)]).collect()
    assert all(abs(r[f"m{i}"]) < 1e-9 for r in m for i in range(k))


def test_same_result_for_1_4_16_shuffle_partitions(spark):
    import __spark_entry__ as E
    q = E.queries()["evaluate_rounds"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            res.append(sorted(tuple(r) for r in q(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1] == res[2]


def test_mllib_weighted_metrics_cross_check(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from roundlearn.operators import metrics as M
    e = _events(spark)
    dic = L.fit_dictionary(e, ["event_type"])
    e = L.encode(e, dic, "event_type", "y")
    p = e.select(F.col("y").cast("double").alias("label"),
                 F.when(F.col("value") > 50, F.lit(2.0)).otherwise(F.col("y").cast("double")).alias("prediction"))
    ours = M.weighted(M.per_class(M.confusion(p, "label", "prediction"))).first()
    for metric, col in (("weightedPrecision", "precision"), ("weightedRecall", "recall"), ("weightedFMeasure", "f1")):
        ref = MulticlassClassificationEvaluator(metricName=metric).evaluate(p)
        assert ours[col] == pytest.approx(ref, abs=1e-12)


def test_micro_equals_accuracy_for_single_label(spark):
    from roundlearn.functions.columns import one_hot
    from roundlearn.operators import metrics as M
    from roundlearn.plans.common import pseudo_pred
    e = _events(spark)
    dic = L.fit_dictionary(e.select(F.col("event_type").alias("c")).unionByName(
        e.select(pseudo_pred(F.col("value"), F.col("event_type")).alias("c"))), ["c"])
    k = dic.count()
    p = e.select(F.col("event_type").alias("c"), pseudo_pred(F.col("value"), F.col("event_type")).alias("pc"))
    p = L.encode(L.encode(p, dic, "c", "yi"), dic.withColumn("label_col", F.lit("pc")), "pc", "pi")
    oh = p.select(one_hot(F.col("yi"), k).alias("y"), one_hot(F.col("pi"), k).alias("p"), "yi", "pi")
    mic = M.micro(M.cell_sums(oh, "y", "p", k)).first()
    acc = oh.agg(F.avg((F.col("yi") == F.col("pi")).cast("double"))).first()[0]
    assert mic["precision"] == pytest.approx(acc) and mic["recall"] == pytest.approx(acc)


def test_multi_hot_sums_to_number_of_blocks(spark):
    from roundlearn.plans.q_documents import multi_hot_frame
    dl, layout, _ = multi_hot_frame(spark, SF_MID)
    sums = dl.select(F.aggregate("y", F.lit(0), lambda a, x: a + x).alias("s")).distinct().collect()
    assert [r["s"] for r in sums] == [len(layout)]


def test_hamming_loss_matches_mllib(spark):
    from pyspark.ml.evaluation import MultilabelClassificationEvaluator
    from roundlearn.operators import metrics as M
    from roundlearn.plans.q_documents import multi_hot_frame
    dl, _, _ = multi_hot_frame(spark, SF_MID)
    ours = M.accuracy_cells(dl, "y", "p").first()[0]
    idx = lambda c: F.transform(F.filter(F.transform(F.col(c), lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
                                         lambda s: s["v"] == 1), lambda s: s["i"].cast("double"))
    sets = dl.select(idx("y").alias("label"), idx("p").alias("prediction"))
    ref = MultilabelClassificationEvaluator(metricName="hammingLoss").evaluate(sets)
    assert 1 - ours / 100 == pytest.approx(ref, abs=1e-12)


def test_xxhash_order_exact_against_brute_force(spark):
    e = _events(spark, SF_SMALL)
    h = F.xxhash64(F.concat(F.lit("42:"), F.col("event_id").cast("string")))
    brute = {r["event_id"]: r["r"] for r in e.withColumn("r", F.row_number().over(Window.orderBy(h, "event_id"))).collect()}
    got = {r["event_id"]: r["r"] for r in S.hash_rank(e.repartition(5), "event_id", rank_col="r", order="xxhash64").collect()}
    assert got == brute
    n = len(brute)
    sp = {r["event_id"]: r["split"] for r in S.split(e, "event_id", order="xxhash64", hex_digits=3).collect()}
    assert all((sp[k] == "test") == (brute[k] <= -(-n * 2 // 5)) for k in brute)
    cap = S.stratified_cap(e, "event_type", "event_id", 50, keep_all=["error"], order="xxhash64")
    bc = (e.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(h, "event_id")))
           .where((F.col("rn") <= 50) | (F.col("event_type") == "error")))
    assert sorted(r[0] for r in cap.select("event_id").collect()) == sorted(r[0] for r in bc.select("event_id").collect())
