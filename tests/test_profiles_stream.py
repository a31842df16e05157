"""CSV profiles with the real column names, and the round stream."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from roundlearn.sources import profiles as P


def _write(text):
    d = tempfile.mkdtemp(prefix="roundlearn-test-")
    p = os.path.join(d, "data.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_generic_flow_csv_na_tokens(spark):
    p = _write("Attack_type,Attack_label,src_ip,dst_ip,protocol,length\n"
               "DDoS_UDP,1,192.168.1.10,172.16.0.4,UDP,512\nNormal,0,10.0.0.2,10.0.0.3,TCP,60\n"
               "Normal,0,NA,,TCP,n/a\n")
    schema = T.StructType([T.StructField("Attack_type", T.StringType()), T.StructField("Attack_label", T.IntegerType()),
                           T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
                           T.StructField("protocol", T.StringType()), T.StructField("length", T.IntegerType())])
    df = P.csv_scan(spark, p, schema)
    rows = df.orderBy("length").collect()
    assert rows[0]["src_ip"] is None and rows[0]["dst_ip"] is None and rows[0]["length"] is None
    from roundlearn.functions.columns import row_to_text
    feats = P.features(df, P.Profile("x"))
    txt = [r[0] for r in df.select(row_to_text(df, feats)).orderBy(F.col("length").desc_nulls_last()).collect()]
    assert txt[0] == "192.168.1.10 172.16.0.4 UDP 512" and txt[2] == "nan nan TCP nan"


def test_edge_profile_dotted_names_keep_list(spark):
    cols = P.EDGE_FEATURES + ["Attack_label", "Attack_type", "extra.col"]
    p = _write(",".join(cols) + "\n" + ",".join(["1"] * len(P.EDGE_FEATURES) + ["1", "MITM", "9"]) + "\n")
    df = P.load(spark, P.Profile("EDGE", path=p, keep=P.EDGE_FEATURES))
    assert df.columns == ["Attack_type", "Attack_label"] + P.EDGE_FEATURES
    assert df.select(F.col("`http.request.method-GET`")).first()[0] == "1"


def test_ton_profile_rename_remap(spark):
    cols = ["type", "label"] + P.TON_FEATURES
    p = _write(",".join(f'"{c}"' for c in cols) + "\n" + "ddos,1," + ",".join(["0.5"] * len(P.TON_FEATURES)) + "\n"
               + "other,1," + ",".join(["0.5"] * len(P.TON_FEATURES)) + "\n")
    df = P.load(spark, P.Profile("TON", path=p, rename={"type": "Attack_type", "label": "Attack_label"},
                                 keep=P.TON_FEATURES, remap=P.TON_REMAP))
    got = sorted(r[0] for r in df.select("Attack_type").collect())
    assert got == ["DDoS_UDP", "other"]                       # unmapped values unchanged
    assert P.TON_FEATURES[1] in df.columns                    # leading blank kept


def test_round_stream_matches_batch_and_replay_is_idempotent(spark):
    from roundlearn.session import scratch_path
    from roundlearn.sources.tables import table, table_stream
    from roundlearn.streaming.rounds_stream import register_batch, run_rounds_stream
    reg_path = scratch_path(spark, "t-registry")
    out = run_rounds_stream(spark, table_stream(spark, SF_SMALL, "events"), "event_type", reg_path,
                            scratch_path(spark, "t-ckpt"))
    first = sorted(tuple(r) for r in out.collect())
    expect = sorted((0, i + 1, c) for i, c in enumerate(sorted(
        r[0] for r in table(spark, SF_SMALL, "events").select("event_type").distinct().collect())))
    assert first == expect
    register_batch(table(spark, SF_SMALL, "events"), 0, reg_path, "event_type")       # replay batch 0
    again = sorted(tuple(r) for r in spark.read.parquet(reg_path).select("round", "pos", "class").collect())
    assert again == first


def test_stream_heads_equal_batch_heads_and_replay(spark):
    from roundlearn.operators.heads import centroid_heads
    from roundlearn.session import scratch_path
    from roundlearn.sources.tables import table, table_stream
    from roundlearn.streaming.rounds_stream import register_batch, run_rounds_stream
    ev = table(spark, SF_SMALL, "events")

    def prep(s):
        return s.select("event_type", F.array(F.col("value") / 100.0,
                                              F.get_json_object("props", "$.k").cast("double") / 100.0).alias("vec"))

    reg, heads = scratch_path(spark, "t-reg"), scratch_path(spark, "t-heads")
    run_rounds_stream(spark, prep(table_stream(spark, SF_SMALL, "events")), "event_type", reg,
                      scratch_path(spark, "t-ck"), vec_col="vec", heads_path=heads)
    got = {r["class"]: (r["n_train"], r["bias"]) for r in spark.read.parquet(heads).collect()}
    want = {r["class"]: (r["n_train"], r["bias"]) for r in centroid_heads(prep(ev), "event_type", "vec").collect()}
    assert got.keys() == want.keys()
    assert all(got[c][0] == want[c][0] and abs(got[c][1] - want[c][1]) < 1e-12 for c in got)
    register_batch(prep(ev), 0, reg, "event_type", "vec", heads)          # replay batch 0
    again = {r["class"]: (r["n_train"], r["bias"]) for r in spark.read.parquet(heads).collect()}
    assert again.keys() == got.keys() and all(abs(again[c][1] - got[c][1]) < 1e-12 for c in got)


def test_round_stream_over_a_folder_of_part_files(spark):
    from roundlearn.session import scratch_path
    from roundlearn.sources.tables import table_stream
    from roundlearn.streaming.rounds_stream import register_batch, run_rounds_stream
    folder, reg = scratch_path(spark, "t-folder"), scratch_path(spark, "t-reg")

    def part(classes):
        return spark.createDataFrame([(c,) for c in classes], "event_type string").coalesce(1)

    batches = [["b", "a", None], ["a", "b"], ["c", "a"]]
    for classes in batches:
        part(classes).write.mode("append").parquet(f"{folder}/events.parquet")
        run_rounds_stream(spark, table_stream(spark, folder, "events", max_files=1), "event_type", reg, f"{folder}/ckpt")
    want = [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]          # the second batch uses no round number
    assert sorted(tuple(r) for r in spark.read.parquet(reg).select("round", "pos", "class").collect()) == want
    for i, classes in enumerate(batches):
        register_batch(part(classes), i, reg, "event_type")                  # replay
    assert sorted(tuple(r) for r in spark.read.parquet(reg).select("round", "pos", "class").collect()) == want
