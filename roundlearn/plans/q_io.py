"""Sources and sinks: CSV round trip, dictionary reuse, heads per round,
metric and history tables. Every write goes to a fresh folder inside the
shared checkpoint directory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundlearn.operators import labels as L
from roundlearn.operators import metrics as M
from roundlearn.operators import rounds as RD
from roundlearn.operators import sampling as S
from roundlearn.functions import columns as C
from roundlearn.plans.common import LOGIT_SQL, events, logit, r6
from roundlearn.plans.evaluate import prepare
from roundlearn.plans.oracle_evaluate import heads_ctes
from roundlearn.plans.q_events import FIXED_UNIVERSE, FIXED_UNIVERSE_SQL, PREDS_SQL, conf_of, universe_df
from roundlearn.plans.registry import query
from roundlearn.plans.sqlfrag import bce_sql, prf_ctes, rank_sql
from roundlearn.plans.sqlfrag import r6 as s6
from roundlearn.session import materialize, scratch_path
from roundlearn.sources import sinks
from roundlearn.sources.profiles import csv_scan as read_csv
from roundlearn.sources.profiles import infer_types
from roundlearn.sources.tables import table

CSV_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
                           T.StructField("props", T.StringType())])


@query("csv_scan", f"SELECT event_id, user_id, event_type, {s6('value')} AS value, props FROM events")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    # quotes doubled inside quoted fields (RFC 4180, what common CSV writers emit)
    table(spark, d, "events").select(*CSV_SCHEMA.fieldNames()).write.option("header", True).option("escape", '"').csv(path)
    t = read_csv(spark, path, CSV_SCHEMA)
    return t.withColumn("value", r6(F.col("value")))


SPLIT_TS = "2024-01-16"


@query("csv_infer", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_gap, event_type,
  round(value, 6) AS value, value > 50 AS flag, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props, CAST(NULL AS DOUBLE) AS nothing
  FROM events""")
def csv_infer(spark, d):
    """SRC1 without a schema: the types of a comma-separated table are found
    in one pass, whole numbers with gaps become fractions, as data frames have
    them. Written one record a line, so large files are split at the scan."""
    path = scratch_path(spark, "csv-infer")
    e = table(spark, d, "events")
    (e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_gap"), "event_type", "value",
              (F.col("value") > 50).alias("flag"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"),
              F.lit(None).cast("string").alias("nothing"))
      .write.option("header", True).option("escape", '"').csv(path))
    text = read_csv(spark, path, multiline=False)
    found = infer_types(text)
    t = read_csv(spark, path, found, multiline=False)
    return t.withColumn("value", r6(F.col("value")))




@query("label_dictionary_reuse", f"""WITH a AS (SELECT event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id
    FROM (SELECT DISTINCT event_type FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'))
  SELECT b.event_type, coalesce(a.id, -1) AS event_type_id, count(*) AS n
  FROM events b LEFT JOIN a ON b.event_type = a.label WHERE b.ts >= TIMESTAMP '{SPLIT_TS}' GROUP BY 1, 2""")
def label_dictionary_reuse(spark, d):
    e = events(spark, d)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    path = scratch_path(spark, "dict")
    sinks.save_dictionary(L.fit_dictionary(e.where(F.col("ts") < cut), ["event_type"]), path)
    dic = sinks.load_dictionary(spark, path)          # fitted on dataset A, reused on B
    b = L.encode(e.where(F.col("ts") >= cut), dic, "event_type", "event_type_id", unseen="keep")
    return b.groupBy("event_type", "event_type_id").agg(F.count(F.lit(1)).alias("n"))


def _round_heads_long(spark, d):
    cfg = RD.config_table(spark, RD.EMBEDDING_ROUNDS)
    reg = RD.registry(cfg)
    s = S.split(prepare(table(spark, d, "embeddings")), "key", test=0.4)
    h = RD.round_heads(s.where(F.col("split") == "train"), reg, "y", "embedding")
    return reg, h


@query("head_save", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT CAST(round AS INTEGER) AS round, class, CAST(64 AS BIGINT) AS n_dims, {s6('bias')} AS bias FROM heads""")
def head_save(spark, d):
    """SNK1: one folder per round; the last round is written twice (replay)
    and dynamic partition overwrite keeps one copy."""
    reg, h = _round_heads_long(spark, d)
    long = materialize(h.select("round", "class", F.posexplode("mu").alias("dim", "value")))      # fitted once, written five times
    path = scratch_path(spark, "heads")
    for r in [0, 1, 2, 3, 3]:
        sinks.save_heads(long.where(F.col("round") == r), path)
    back = sinks.load_heads(spark, path)
    g = back.groupBy("round", "class").agg(F.count(F.lit(1)).alias("n_dims"),
                                           (F.lit(-0.5) * F.sum(F.col("value") * F.col("value"))).alias("bias"))
    return g.select("round", "class", "n_dims", r6(F.col("bias")).alias("bias"))


@query("head_load", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT CAST(g.round AS INTEGER) AS round, m.class, CAST(m.dim - 1 AS INTEGER) AS dim, {s6('m.mu')} AS value
  FROM mu m JOIN reg g ON m.class = g.class""")
def head_load(spark, d):
    """SRC4: heads saved per round, read back and put back into vector form."""
    reg, h = _round_heads_long(spark, d)
    path = scratch_path(spark, "heads")
    sinks.save_heads(h.select("round", "class", F.posexplode("mu").alias("dim", "value")), path)
    back = sinks.load_heads(spark, path)
    from roundlearn.operators.heads import heads_from_long
    vec = heads_from_long(back.select("class", "dim", "value")).join(back.select("class", "round").distinct(), "class")
    return vec.select("round", "class", F.posexplode("mu").alias("dim", "value")).select(
        "round", "class", F.col("dim").cast("int"), r6(F.col("value")).alias("value"))


def _metric_rows(pc, run):
    lm = M.long_metrics(pc, ["class"], ["precision", "recall", "f1", "support"])
    return lm.select(F.lit(run).alias("run"), F.lit("all").alias("split"), F.lit("class").alias("scope"),
                     "class", "metric", r6(F.col("value")).alias("value"))


def _metric_sql(run, universe=None):
    return f"""SELECT '{run}' AS run, 'all' AS split, 'class' AS scope, class, metric, {s6('value')} AS value FROM
  (WITH {prf_ctes(PREDS_SQL, universe)} SELECT class, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM pcm)
  UNPIVOT (value FOR metric IN (precision, recall, f1, support))"""


@query("metrics_sink", _metric_sql("r1") + " UNION ALL " + _metric_sql("r2", FIXED_UNIVERSE_SQL))
def metrics_sink(spark, d):
    conf = conf_of(spark, d)
    path = scratch_path(spark, "metrics")
    sinks.append_metrics(_metric_rows(M.per_class(conf), "r1"), path)
    sinks.append_metrics(_metric_rows(M.per_class(conf, universe_df(spark, FIXED_UNIVERSE)), "r2"), path)
    return spark.read.parquet(path)


def _hist_sql(e: int) -> str:
    z = "CAST(event_type = 'error' AS DOUBLE)"
    return f"""SELECT 'run0' AS run, {e} AS epoch, 'train' AS split, 'loss' AS metric, {s6('avg(bl)')} AS value FROM
  (SELECT b, avg(l) AS bl FROM (SELECT ({rank_sql('event_id', f'run0:{e}')} - 1) // 32 AS b, {bce_sql(LOGIT_SQL, z)} AS l
   FROM events) GROUP BY b)
  UNION ALL SELECT 'run0', {e}, 'train', 'accuracy',
  {s6("avg(CAST(CAST(1.0 / (1.0 + exp(-" + LOGIT_SQL + ")) > 0.5 AS INTEGER) = CAST(event_type = 'error' AS INTEGER) AS DOUBLE))")} FROM events"""


@query("history_append", " UNION ALL ".join(_hist_sql(e) for e in range(3)))
def history_append(spark, d):
    """SNK3: per epoch (new seeded order each epoch) the batch-mean loss and
    the accuracy, appended to a history table."""
    e = events(spark, d)
    z = (F.col("event_type") == "error").cast("double")
    base = e.select("event_id", C.bce_with_logits(logit(F.col("value")), z).alias("l"),
                    (C.threshold_predict(C.sigmoid(logit(F.col("value")))) == z.cast("int")).cast("double").alias("ok"))
    path = scratch_path(spark, "history")
    for ep in range(3):
        b = S.with_batches(base, "event_id", seed=f"run0:{ep}")
        loss = M.batch_mean_loss(b, "batch_id", "l").select(F.lit("loss").alias("metric"), F.col("loss_batch_mean").alias("value"))
        acc = base.agg(F.avg("ok").alias("value")).select(F.lit("accuracy").alias("metric"), "value")
        h = loss.unionByName(acc).select(F.lit("run0").alias("run"), F.lit(ep).alias("epoch"), F.lit("train").alias("split"),
                                         "metric", r6(F.col("value")).alias("value"))
        sinks.append_history(h, path)
    return spark.read.parquet(path)
