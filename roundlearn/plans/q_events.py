"""Queries over ``events`` in the labelled-traffic role: projections,
filters, dictionary, sampling and multi-class metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundlearn.functions import columns as C
from roundlearn.operators import labels as L
from roundlearn.operators import metrics as M
from roundlearn.operators import sampling as S
from roundlearn.plans.common import (EVENT_CLASSES, EVENTS_SQL, LOGIT_SQL, PRED_SQL, Y_INDEX_SQL, class_logits,
                                     class_logits_sql, events, logit, pseudo_pred, r6, y_index)
from roundlearn.plans.registry import query
from roundlearn.plans.sqlfrag import bce_sql, prf_ctes, rank_sql, split_case_sql
from roundlearn.plans.sqlfrag import r6 as s6
from roundlearn.session import local_frame, small_local
from roundlearn.sources import sinks

E = EVENTS_SQL
# Remap of the second dataset's class names (4 of 5 renamed).
REMAP = {"click": "C_CLICK", "view": "C_VIEW", "purchase": "C_PURCHASE", "signup": "C_SIGNUP"}
REMAP_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REMAP.items()) + ") AS rm(old, new)"
FIXED_UNIVERSE = EVENT_CLASSES + ["absent"]
FIXED_UNIVERSE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in FIXED_UNIVERSE) + ") AS u(class)"


def preds(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select("event_id", F.col("event_type").alias("y"), pseudo_pred(F.col("value"), F.col("event_type")).alias("pred"))


PREDS_SQL = f"(SELECT event_id, event_type AS y, {PRED_SQL} AS pred FROM {E})"


def conf_of(spark, d) -> DataFrame:
    # K*K rows; materialized once, every metric reads the small table
    return small_local(M.confusion(preds(spark, d)))


def pc_out(pc: DataFrame) -> DataFrame:
    return pc.select("class", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                     r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint").alias("support"))


PC_OUT_SQL = "SELECT class, {p}, {r}, {f}, support FROM pcm".format(
    p=s6("precision") + " AS precision", r=s6("recall") + " AS recall", f=s6("f1") + " AS f1")


def universe_df(spark, classes):
    return local_frame(spark, [(c,) for c in classes], "class string")


# ------------------------------------------------------------ sources

@query("scan_profile", f"""SELECT event_id, event_type AS Attack_type,
  CAST(event_type = 'error' AS INTEGER) AS Attack_label, user_id, {s6('value')} AS value, props_k FROM {E}""")
def scan_profile(spark, d):
    from roundlearn.sources.profiles import EVENTS_PROFILE, apply_profile
    p = apply_profile(events(spark, d), EVENTS_PROFILE)
    return p.select("event_id", "Attack_type", "Attack_label", "user_id", r6(F.col("value")).alias("value"), "props_k")


@query("batch_source", f"SELECT event_id, CAST(({rank_sql('event_id', 'run0:0')} - 1) // 32 AS INTEGER) AS batch_id FROM events")
def batch_source(spark, d):
    e = events(spark, d).select("event_id")
    return S.with_batches(e, "event_id", seed="run0:0", batch_size=32).select("event_id", "batch_id")


# --------------------------------------------------------- projections

@query("rename_columns", f"SELECT event_id, event_type AS Attack_type, {s6('value')} AS value FROM events")
def rename_columns(spark, d):
    e = events(spark, d).withColumnsRenamed({"event_type": "Attack_type"})
    return e.select("event_id", "Attack_type", r6(F.col("value")).alias("value"))


EDGE_NAMES = {"event_type": "Attack_type", "value": "tcp.len", "user_id": "mqtt.msgtype", "props_k": "dns.qry.type"}


@query("keep_columns", f"""SELECT event_id, event_type AS Attack_type, {s6('value')} AS "tcp.len",
  user_id AS "mqtt.msgtype", props_k AS "dns.qry.type" FROM {E}""")
def keep_columns(spark, d):
    e = events(spark, d).withColumnsRenamed(EDGE_NAMES)
    keep = ["event_id", "Attack_type", "tcp.len", "mqtt.msgtype", "dns.qry.type"]
    out = e.select(*[C.col(c) for c in keep])      # a missing name raises
    return out.withColumn("tcp.len", r6(C.col("tcp.len")))


@query("drop_columns", f"SELECT event_id, user_id, event_type, {s6('value')} AS value, props_k FROM {E}")
def drop_columns(spark, d):
    e = events(spark, d).drop("ts", "props", "not_a_column")   # missing names are ignored
    return e.withColumn("value", r6(F.col("value")))


@query("derive_cast", """SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS Attack_label,
  CAST(trunc(value) AS INTEGER) AS value_int FROM events""")
def derive_cast(spark, d):
    e = events(spark, d)
    return e.select("event_id", (F.col("event_type") == "error").cast("int").alias("Attack_label"),
                    F.col("value").cast("int").alias("value_int"))


def remapped(spark, d) -> DataFrame:
    m = local_frame(spark, list(REMAP.items()), "old string, new string")
    e = events(spark, d)
    # tiny fixed map: broadcast, events never shuffle
    return (e.join(F.broadcast(m), e["event_type"] == m["old"], "left")
             .withColumn("event_type", F.coalesce(F.col("new"), F.col("event_type"))).drop("old", "new"))


@query("value_remap", f"""SELECT e.event_id, coalesce(rm.new, e.event_type) AS event_type
  FROM events e LEFT JOIN {REMAP_SQL} ON e.event_type = rm.old""")
def value_remap(spark, d):
    return remapped(spark, d).select("event_id", "event_type")


def _text_sql(cols_sql: list[str]) -> str:
    return "concat_ws(' ', " + ", ".join(cols_sql) + ")"


DBL_TXT = "CASE WHEN {c} IS NULL OR isnan({c}) THEN 'nan' ELSE CAST({c} AS VARCHAR) END"
INT_TXT = "coalesce(CAST({c} AS VARCHAR), 'nan')"


@query("row_to_text", f"""SELECT event_id, {_text_sql([INT_TXT.format(c='user_id'), DBL_TXT.format(c='value'),
  "coalesce(props, 'nan')"])} AS text FROM events""")
def row_to_text(spark, d):
    e = events(spark, d)
    return e.select("event_id", C.row_to_text(e, ["user_id", "value", "props"]).alias("text"))


@query("row_to_text_columnar", f"""SELECT event_id, {_text_sql([INT_TXT.format(c='user_id'),
  DBL_TXT.format(c='value'), "coalesce(props, 'nan')"])} AS text FROM events""")
def row_to_text_columnar(spark, d):
    e = events(spark, d)
    feats = [c for c in e.columns if c not in ("event_id", "ts", "event_type", "props_k")]   # by exclusion
    return e.select("event_id", C.row_to_text(e, feats).alias("text"))


@query("row_to_text_upcast", f"""SELECT event_id, {_text_sql([DBL_TXT.format(c='CAST(user_id AS DOUBLE)'),
  DBL_TXT.format(c='value'), DBL_TXT.format(c='CAST(props_k AS DOUBLE)')])} AS text FROM {E}""")
def row_to_text_upcast(spark, d):
    e = events(spark, d)
    return e.select("event_id", C.row_to_text(e, ["user_id", "value", "props_k"], upcast=True).alias("text"))


def event_dict(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("Attack_label", (F.col("event_type") == "error").cast("int"))
    return L.fit_dictionary(e, ["event_type", "Attack_label"])


def encoded(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("Attack_label", (F.col("event_type") == "error").cast("int"))
    dic = event_dict(spark, d)
    e = L.encode_all(e, dic, ["event_type", "Attack_label"], unseen="keep")      # fitted on these rows: nothing is unseen
    return e.withColumnsRenamed({"event_type_id": "type_id", "Attack_label_id": "label_id"})


DICT_TYPE_SQL = "(SELECT event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type FROM events))"
ENC_SQL = f"""(SELECT e.event_id, e.event_type, t.id AS type_id, CAST(e.event_type = 'error' AS INTEGER) AS label_id
  FROM events e JOIN {DICT_TYPE_SQL} t ON e.event_type = t.label)"""


@query("label_pair", f"SELECT event_id, concat(type_id, ',', label_id) AS pair FROM {ENC_SQL}")
def label_pair(spark, d):
    e = encoded(spark, d)
    return e.select("event_id", F.array_join(C.label_pair(F.col("type_id"), F.col("label_id")), ",").alias("pair"))


@query("label_unpack", f"SELECT event_id, type_id, label_id FROM {ENC_SQL}")
def label_unpack(spark, d):
    e = encoded(spark, d).withColumn("pair", C.label_pair(F.col("type_id"), F.col("label_id")))
    return e.select("event_id", C.label_unpack(F.col("pair"), 0).alias("type_id"),
                    C.label_unpack(F.col("pair"), 1).alias("label_id"))


# ------------------------------------------------------------ filters

@query("class_equals", f"SELECT event_id, {s6('value')} AS value FROM events WHERE event_type = 'error'")
def class_equals(spark, d):
    return events(spark, d).where(F.col("event_type") == "error").select("event_id", r6(F.col("value")).alias("value"))


@query("class_in_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def class_in_list(spark, d):
    return events(spark, d).where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("new_classes_only", """SELECT CAST(pos AS INTEGER) AS pos, class FROM
  (SELECT event_type AS class, row_number() OVER (ORDER BY event_type) AS pos FROM (SELECT DISTINCT event_type FROM events))
  WHERE class NOT IN ('click', 'view')""")
def new_classes_only(spark, d):
    from roundlearn.operators.rounds import new_classes
    cand = events(spark, d).select(F.col("event_type").alias("class")).distinct()
    cand = cand.withColumn("pos", F.row_number().over(Window.orderBy("class")).cast("int"))   # distinct classes only
    known = universe_df(spark, ["click", "view"])
    return new_classes(cand, known).select("pos", "class")


@query("threshold_predict", f"""SELECT event_id, {s6('1.0 / (1.0 + exp(-' + LOGIT_SQL + '))')} AS p,
  CAST(1.0 / (1.0 + exp(-{LOGIT_SQL})) > 0.5 AS INTEGER) AS pred FROM events""")
def threshold_predict(spark, d):
    e = events(spark, d).withColumn("p", C.sigmoid(logit(F.col("value"))))
    return e.select("event_id", r6(F.col("p")).alias("p"), C.threshold_predict(F.col("p")).alias("pred"))


@query("support_mask", f"""WITH {prf_ctes(PREDS_SQL, FIXED_UNIVERSE_SQL + " UNION SELECT 'other'")}
  SELECT class, support FROM pcm WHERE support > 0""")
def support_mask(spark, d):
    pc = M.per_class(conf_of(spark, d), universe_df(spark, FIXED_UNIVERSE + ["other"]))
    return pc.where(F.col("support") > 0).select("class", F.col("support").cast("bigint"))


_NONE_SQL = f"(SELECT * FROM {PREDS_SQL} WHERE y NOT IN ('click','error','purchase','signup','view'))"
_SOME_SQL = f"(SELECT * FROM {PREDS_SQL} WHERE y IN ('click','error'))"


@query("empty_guard", f"""SELECT 'none' AS part, * FROM (WITH {prf_ctes(_NONE_SQL)} {PC_OUT_SQL})
  UNION ALL SELECT 'some', * FROM (WITH {prf_ctes(_SOME_SQL)} {PC_OUT_SQL})""")
def empty_guard(spark, d):
    """FLT7: metrics of two parts of the predictions, one of which is empty:
    it gives no rows, of the right schema, and the other its metrics."""
    p = preds(spark, d)
    out = []
    for name, rows in (("none", p.where(~F.col("y").isin(*EVENT_CLASSES))), ("some", p.where(F.col("y").isin("click", "error")))):
        out.append(guarded_metrics(spark, rows).select(F.lit(name).alias("part"), "*"))
    return out[0].unionByName(out[1])


def guarded_metrics(spark, rows):
    """Per-class metrics of (y, pred) rows; for none of them no job runs."""
    if rows.isEmpty():
        return local_frame(spark, [], "class string, precision double, recall double, f1 double, support bigint")
    return pc_out(M.per_class(M.confusion(rows)))


# --------------------------------------------------------------- joins

@query("label_encode_apply", f"SELECT event_id, type_id AS event_type_id FROM {ENC_SQL}")
def label_encode_apply(spark, d):
    e = events(spark, d)
    dic = L.fit_dictionary(e, ["event_type"])
    # fitted on these very rows: nothing can be unseen, so no scan looks for it
    return L.encode(e, dic, "event_type", "event_type_id", unseen="keep").select("event_id", "event_type_id")


@query("label_decode", f"SELECT event_id, event_type AS label FROM {ENC_SQL}")
def label_decode(spark, d):
    e = events(spark, d)
    dic = L.fit_dictionary(e, ["event_type"])
    ids = L.encode(e, dic, "event_type", "type_id", unseen="keep").select("event_id", "type_id")
    return L.decode(ids, dic, "event_type", "type_id", "label").select("event_id", "label")


@query("pair_predictions", f"SELECT event_id, y, pred FROM {PREDS_SQL}")
def pair_predictions(spark, d):
    """JN4: truth and predictions, two stored tables bucketed by the key,
    paired by it (never by position) without a shuffle."""
    e = events(spark, d)
    y = sinks.save_bucketed(e.select("event_id", F.col("event_type").alias("y")), "event_id", "truth")
    p = sinks.save_bucketed(e.select("event_id", pseudo_pred(F.col("value"), F.col("event_type")).alias("pred")), "event_id", "predictions")
    return y.join(p.hint("merge"), "event_id")      # small tables would be broadcast; the buckets hold at any size


@query("label_universe", f"WITH {prf_ctes(PREDS_SQL)} {PC_OUT_SQL}")
def label_universe(spark, d):
    return pc_out(M.per_class(conf_of(spark, d)))


@query("fixed_label_universe", f"WITH {prf_ctes(PREDS_SQL, FIXED_UNIVERSE_SQL)} {PC_OUT_SQL}")
def fixed_label_universe(spark, d):
    return pc_out(M.per_class(conf_of(spark, d), universe_df(spark, FIXED_UNIVERSE)))


@query("unseen_labels", f"""SELECT label, count(*) AS rows FROM
  (SELECT coalesce(rm.new, e.event_type) AS label FROM events e LEFT JOIN {REMAP_SQL} ON e.event_type = rm.old)
  WHERE label NOT IN (SELECT DISTINCT event_type FROM events) GROUP BY label""")
def unseen_labels(spark, d):
    dic = L.fit_dictionary(events(spark, d), ["event_type"])
    return L.unseen_labels(remapped(spark, d), dic, "event_type").select("label", F.col("rows").cast("bigint"))


# -------------------------------------------------------- aggregations

@query("value_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def value_counts(spark, d):
    return (events(spark, d).where(F.col("event_type").isNotNull()).groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type"))


@query("distinct_classes", "SELECT DISTINCT event_type FROM events")
def distinct_classes(spark, d):
    return events(spark, d).select("event_type").distinct()


@query("table_shape", "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM events")
def table_shape(spark, d):
    from roundlearn.sources.tables import table
    t = table(spark, d, "events")
    return t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(t.columns)).cast("bigint"))


@query("confusion_counts", f"SELECT y, pred, count(*) AS n FROM {PREDS_SQL} GROUP BY y, pred")
def confusion_counts(spark, d):
    return M.confusion(preds(spark, d))


@query("prf_per_class", f"""WITH {prf_ctes(PREDS_SQL)} SELECT class, tp, pp, {s6('precision')} AS precision,
  {s6('recall')} AS recall, {s6('f1')} AS f1, support FROM pcm""")
def prf_per_class(spark, d):
    pc = M.per_class(conf_of(spark, d))
    return pc.select("class", F.col("tp").cast("bigint"), F.col("pp").cast("bigint"), r6(F.col("precision")).alias("precision"),
                     r6(F.col("recall")).alias("recall"), r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint"))


def _three(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(m)).alias(m) for m in ("precision", "recall", "f1")])


@query("prf_macro", f"""WITH {prf_ctes(PREDS_SQL)} SELECT {s6('avg(precision)')} AS precision,
  {s6('avg(recall)')} AS recall, {s6('avg(f1)')} AS f1 FROM pcm""")
def prf_macro(spark, d):
    return _three(M.macro(M.per_class(conf_of(spark, d))))


@query("prf_weighted", f"""WITH {prf_ctes(PREDS_SQL)} SELECT {s6('sum(precision * support) / sum(support)')} AS precision,
  {s6('sum(recall * support) / sum(support)')} AS recall, {s6('sum(f1 * support) / sum(support)')} AS f1 FROM pcm""")
def prf_weighted(spark, d):
    return _three(M.weighted(M.per_class(conf_of(spark, d))))


BIN_SQL = "(SELECT CAST(event_type = 'error' AS INTEGER) AS y, CAST(value <= 10 AS INTEGER) AS pred FROM events)"


@query("prf_binary", f"""SELECT {s6('avg(CAST(y = pred AS DOUBLE))')} AS accuracy,
  {s6("CASE WHEN sum(pred) > 0 THEN sum(y * pred) / sum(pred) ELSE 0.0 END")} AS precision,
  {s6("CASE WHEN sum(y) > 0 THEN sum(y * pred) / sum(y) ELSE 0.0 END")} AS recall,
  {s6("CASE WHEN sum(y) + sum(pred) > 0 THEN 2.0 * sum(y * pred) / (sum(y) + sum(pred)) ELSE 0.0 END")} AS f1 FROM {BIN_SQL}""")
def prf_binary(spark, d):
    e = events(spark, d).select((F.col("event_type") == "error").cast("int").alias("y"),
                                (F.col("value") <= 10).cast("int").alias("pred"))
    b = M.binary(e)
    return b.select(*[r6(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


@query("prf_macro_supported", f"""WITH {prf_ctes(PREDS_SQL, FIXED_UNIVERSE_SQL)} SELECT {s6('avg(precision)')} AS precision,
  {s6('avg(recall)')} AS recall, {s6('avg(f1)')} AS f1 FROM pcm WHERE support > 0""")
def prf_macro_supported(spark, d):
    pc = M.per_class(conf_of(spark, d), universe_df(spark, FIXED_UNIVERSE))
    return _three(M.macro(pc, F.col("support") > 0))


@query("accuracy_exact", f"SELECT {s6('avg(CAST(y = pred AS DOUBLE))')} AS accuracy FROM {PREDS_SQL}")
def accuracy_exact(spark, d):
    a = M.accuracy_exact(preds(spark, d), "y", "pred")
    return a.select(r6(F.col("accuracy")).alias("accuracy"))


Z_SQL = "CAST(event_type = 'error' AS DOUBLE)"


@query("loss_bce", f"SELECT {s6('avg(' + bce_sql(LOGIT_SQL, Z_SQL) + ')')} AS loss FROM events")
def loss_bce(spark, d):
    e = events(spark, d)
    z = (F.col("event_type") == "error").cast("double")
    return e.agg(r6(F.avg(C.bce_with_logits(logit(F.col("value")), z))).alias("loss"))


def _lse_sql(ks) -> str:
    m = "greatest(" + ", ".join(class_logits_sql(k) for k in ks) + ")"
    return f"({m} + ln(" + " + ".join(f"exp({class_logits_sql(k)} - {m})" for k in ks) + "))"


def _pick_sql(ks, idx: str) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {class_logits_sql(k)}" for i, k in enumerate(ks)) + " END"


CE_SQL = f"({_lse_sql(range(5))} - {_pick_sql(range(5), Y_INDEX_SQL)})"


@query("loss_ce", f"SELECT {s6('avg(' + CE_SQL + ')')} AS loss FROM events")
def loss_ce(spark, d):
    e = events(spark, d)
    return e.agg(r6(F.avg(C.ce_from_logits(class_logits(F.col("value")), y_index(F.col("event_type"))))).alias("loss"))


@query("loss_joint", f"""SELECT {s6('avg(' + bce_sql(LOGIT_SQL, Z_SQL) + ')')} AS loss_bin, {s6('avg(' + CE_SQL + ')')} AS loss_multi,
  {s6('avg(' + bce_sql(LOGIT_SQL, Z_SQL) + ' + ' + CE_SQL + ')')} AS loss FROM events""")
def loss_joint(spark, d):
    e = events(spark, d)
    b = C.bce_with_logits(logit(F.col("value")), (F.col("event_type") == "error").cast("double"))
    c = C.ce_from_logits(class_logits(F.col("value")), y_index(F.col("event_type")))
    return e.agg(r6(F.avg(b)).alias("loss_bin"), r6(F.avg(c)).alias("loss_multi"), r6(F.avg(b + c)).alias("loss"))


@query("loss_batch_mean", f"""SELECT {s6('avg(bl)')} AS loss_batch_mean FROM
  (SELECT b, avg(l) AS bl FROM (SELECT ({rank_sql('event_id')} - 1) // 32 AS b, {bce_sql(LOGIT_SQL, Z_SQL)} AS l FROM events) GROUP BY b)""")
def loss_batch_mean(spark, d):
    e = events(spark, d).withColumn("l", C.bce_with_logits(logit(F.col("value")), (F.col("event_type") == "error").cast("double")))
    e = S.with_batches(e.select("event_id", "l"), "event_id")
    return M.batch_mean_loss(e, "batch_id", "l").select(r6(F.col("loss_batch_mean")).alias("loss_batch_mean"))


# Every class has a head; rows of the rare true class 'unseen' (value > 300)
# are scored by none, so their whole batch is skipped (as the reference does).
UNSEEN_SQL = "CASE WHEN value > 300 THEN 'unseen' ELSE event_type END"
SCORED_IDX_SQL = f"(coalesce(list_position(['click','error','purchase','signup','view'], {UNSEEN_SQL}), 0) - 1)"


@query("loss_row_mean", f"""WITH b AS (SELECT ({rank_sql('event_id')} - 1) // 32 AS b, {SCORED_IDX_SQL} AS yi, value FROM events),
  ok AS (SELECT b FROM b GROUP BY b HAVING min(yi) >= 0)
  SELECT {s6('avg(' + _lse_sql(range(5)) + ' - ' + _pick_sql(range(5), 'yi') + ')')} AS loss_row_mean,
         count(*) AS rows_used, (SELECT count(DISTINCT b) FROM b) - (SELECT count(*) FROM ok) AS batches_skipped
  FROM b WHERE b IN (SELECT b FROM ok)""")
def loss_row_mean(spark, d):
    e = events(spark, d)
    y = F.when(F.col("value") > 300, F.lit("unseen")).otherwise(F.col("event_type"))
    e = e.select("event_id", class_logits(F.col("value")).alias("lg"), y_index(y).alias("yi"))
    e = S.with_batches(e, "event_id")
    # a batch holding a true class that no head scores is skipped whole
    e = e.withColumn("_bad", F.max((F.col("yi") < 0).cast("int")).over(Window.partitionBy("batch_id")))
    ok = F.col("_bad") == 0
    return e.agg(r6(F.avg(F.when(ok, C.ce_from_logits(F.col("lg"), F.col("yi"))))).alias("loss_row_mean"),
                 F.count(F.when(ok, F.lit(1))).alias("rows_used"),
                 F.countDistinct(F.when(~ok, F.col("batch_id"))).alias("batches_skipped"))


@query("batch_count", f"""SELECT split, count(*) AS n, CAST((count(*) + 31) // 32 AS BIGINT) AS batches FROM
  (SELECT {split_case_sql(rank_sql('event_id'), 'count(*) OVER ()', 0.4, 0.2)} AS split FROM events) GROUP BY split""")
def batch_count(spark, d):
    s = S.split(events(spark, d).select("event_id"), "event_id", test=0.4, val=0.2)
    g = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("batches", S.batch_count(F.col("n")))


# ------------------------------------------------------------- windows

@query("label_encode_fit", """SELECT 'event_type' AS label_col, event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id
    FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT 'Attack_label', CAST(l AS VARCHAR), CAST(row_number() OVER (ORDER BY l) - 1 AS INTEGER)
    FROM (SELECT DISTINCT CAST(event_type = 'error' AS INTEGER) AS l FROM events)
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER)
    FROM (SELECT DISTINCT user_id FROM events)""")
def label_encode_fit(spark, d):
    e = events(spark, d).withColumn("Attack_label", (F.col("event_type") == "error").cast("int"))
    return L.fit_dictionary(e, ["event_type", "Attack_label", "user_id"])


@query("ordered_labels", """SELECT CAST(user_id AS VARCHAR) AS label,
  CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS num_pos,
  CAST(row_number() OVER (ORDER BY CAST(user_id AS VARCHAR)) AS INTEGER) AS text_pos FROM (SELECT DISTINCT user_id FROM events)""")
def ordered_labels(spark, d):
    u = events(spark, d).select("user_id").distinct()        # the label universe, not the rows
    u = S.ordered_rank(u.withColumn("label", F.col("user_id").cast("string")), ["user_id"], "num_pos")
    return S.ordered_rank(u, ["label"], "text_pos").select("label", F.col("num_pos").cast("int"), F.col("text_pos").cast("int"))


@query("stratified_cap", f"""SELECT event_id, event_type FROM
  (SELECT event_id, event_type, {rank_sql('event_id', part='event_type')} AS rn FROM events)
  WHERE rn <= 500 OR event_type IN ('error')""")
def stratified_cap(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return S.stratified_cap(e, "event_type", "event_id", 500, keep_all=["error"])


@query("stratified_cap_counts", """SELECT event_type, count(*) AS rows,
  CAST(CASE WHEN event_type IN ('error') THEN count(*) ELSE least(count(*), 2000) END AS BIGINT) AS kept,
  event_type NOT IN ('error') AND count(*) < 2000 AS short FROM events GROUP BY event_type""")
def stratified_cap_counts(spark, d):
    """SRT2 report: available and kept rows per class for a cap of 2 000 (a
    class under the cap is kept whole and flagged, not an error)."""
    e = events(spark, d).select("event_type")
    return S.stratified_cap_report(e, "event_type", 2000, keep_all=["error"])


@query("seeded_shuffle", f"SELECT event_id, {rank_sql('event_id')} AS pos FROM events")
def seeded_shuffle(spark, d):
    return S.seeded_shuffle(events(spark, d).select("event_id"), "event_id", rank_col="pos")


@query("split_three_way", f"SELECT event_id, {split_case_sql(rank_sql('event_id'), 'count(*) OVER ()', 0.4, 0.2)} AS split FROM events")
def split_three_way(spark, d):
    return S.split(events(spark, d).select("event_id"), "event_id", test=0.4, val=0.2)


@query("split_two_way", f"SELECT event_id, {split_case_sql(rank_sql('event_id'), 'count(*) OVER ()', 0.4)} AS split FROM events")
def split_two_way(spark, d):
    return S.split(events(spark, d).select("event_id"), "event_id", test=0.4)


@query("epoch_reshuffle", " UNION ALL ".join(
    f"SELECT {e} AS epoch, event_id, {rank_sql('event_id', f'run0:{e}')} AS pos FROM events" for e in range(3)))
def epoch_reshuffle(spark, d):
    ids = events(spark, d).select("event_id")
    out = None
    for ep in range(3):
        r = S.seeded_shuffle(ids, "event_id", seed=f"run0:{ep}", rank_col="pos").select(F.lit(ep).alias("epoch"), "event_id", "pos")
        out = r if out is None else out.unionByName(r)
    return out


CAPS = {"click": 300, "view": 400, "purchase": 200, "signup": 100}


@query("concat_samples", f"""SELECT event_id, event_type FROM
  (SELECT event_id, event_type, {rank_sql('event_id', part='event_type')} AS rn FROM events)
  WHERE event_type = 'error' OR {' OR '.join(f"(event_type = '{k}' AND rn <= {v})" for k, v in CAPS.items())}""")
def concat_samples(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return S.stratified_cap(e, "event_type", "event_id", CAPS, keep_all=["error"])      # one pass for all classes


# ------------------------------------------------------------- scalars

@query("canon_string", f"""SELECT event_id, {DBL_TXT.format(c='value')} AS value_text, {INT_TXT.format(c='user_id')} AS user_text,
  {DBL_TXT.format(c="CAST(json_extract_string(props, '$.missing') AS DOUBLE)")} AS missing_text FROM events""")
def canon_string(spark, d):
    from pyspark.sql import types as T
    e = events(spark, d)
    miss = F.get_json_object("props", "$.missing").cast("double")
    return e.select("event_id", C.canon(F.col("value"), T.DoubleType()).alias("value_text"),
                    C.canon(F.col("user_id"), T.LongType()).alias("user_text"),
                    C.canon(miss, T.DoubleType()).alias("missing_text"))


@query("join_blank", f"""SELECT event_id, concat_ws(' ', event_type, {DBL_TXT.format(c='value')},
  {DBL_TXT.format(c="CAST(json_extract_string(props, '$.missing') AS DOUBLE)")}) AS text FROM events""")
def join_blank(spark, d):
    from pyspark.sql import types as T
    e = events(spark, d)
    miss = F.get_json_object("props", "$.missing").cast("double")
    return e.select("event_id", F.concat_ws(" ", F.col("event_type"), C.canon(F.col("value"), T.DoubleType()),
                                            C.canon(miss, T.DoubleType())).alias("text"))


@query("sigmoid", f"SELECT event_id, {s6('1.0 / (1.0 + exp(-' + LOGIT_SQL + '))')} AS p FROM events")
def sigmoid(spark, d):
    return events(spark, d).select("event_id", r6(C.sigmoid(logit(F.col("value")))).alias("p"))


def _softmax_sql(k: int) -> str:
    m = "greatest(" + ", ".join(class_logits_sql(j) for j in range(5)) + ")"
    den = " + ".join(f"exp({class_logits_sql(j)} - {m})" for j in range(5))
    return f"exp({class_logits_sql(k)} - {m}) / ({den})"


@query("softmax", "SELECT event_id, " + ", ".join(f"{s6(_softmax_sql(k))} AS p{k}" for k in range(5)) + " FROM events")
def softmax(spark, d):
    e = events(spark, d).withColumn("sm", C.softmax(class_logits(F.col("value"))))
    return e.select("event_id", *[r6(F.col("sm")[k]).alias(f"p{k}") for k in range(5)])


@query("format_metric", f"WITH {prf_ctes(PREDS_SQL)} SELECT class, printf('%.4f', f1) AS f1_text FROM pcm")
def format_metric(spark, d):
    pc = M.per_class(conf_of(spark, d))
    return pc.select("class", C.format_metric(F.col("f1"), 4).alias("f1_text"))


@query("int_cast", "SELECT event_id, CAST(value > 100 AS INTEGER) AS flag FROM events")
def int_cast(spark, d):
    return events(spark, d).select("event_id", (F.col("value") > 100).cast("int").alias("flag"))


@query("label_text_id", f"SELECT event_id, CAST(type_id AS VARCHAR) AS id_text FROM {ENC_SQL}")
def label_text_id(spark, d):
    e = encoded(spark, d)
    return e.select("event_id", C.label_text_id(F.col("type_id")).alias("id_text"))


@query("row_lambda", f"""SELECT e.event_id, {_text_sql([INT_TXT.format(c='e.user_id'), DBL_TXT.format(c='e.value'),
  "coalesce(e.props, 'nan')"])} AS text, concat(x.type_id, ',', x.label_id) AS pair
  FROM events e JOIN {ENC_SQL} x ON e.event_id = x.event_id""")
def row_lambda(spark, d):
    e = encoded(spark, d)
    return e.select("event_id", C.row_to_text(e, ["user_id", "value", "props"]).alias("text"),
                    F.array_join(C.label_pair(F.col("type_id"), F.col("label_id")), ",").alias("pair"))
