"""Trainable heads and cross-dataset evaluation.

Centroid heads have a closed form. Trainable heads minimise a penalised loss
with one minimum to a tolerance (operators/gradient.py), so any other way to it
is a twin: the SQL takes a fixed number of descent steps, enough for the four
digits that are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundlearn.functions import columns as C
from roundlearn.operators import fusion, gradient, text_features
from roundlearn.operators import labels as L
from roundlearn.operators import metrics as M
from roundlearn.operators import rounds as RD
from roundlearn.operators import sampling as S
from roundlearn.operators.gradient import Objective, descent_sql, epochs_sql, predictions_sql
from roundlearn.operators.heads import centroid_heads, class_names, collect_heads, score_wide
from roundlearn.plans.common import events, r6
from roundlearn.plans.oracle_evaluate import DESCENT_STEPS, UNIT_CURVATURE, heads_ctes
from roundlearn.plans.q_documents import TOK_SQL
from roundlearn.plans.q_events import REMAP, remapped
from roundlearn.plans.q_io import SPLIT_TS
from roundlearn.plans.registry import query
from roundlearn.plans.sqlfrag import prf_ctes, rank_sql, split_case_sql
from roundlearn.plans.sqlfrag import r6 as s6
from roundlearn.session import checked_broadcast, local_frame, materialize, scratch_path, small_local
from roundlearn.sources import sinks
from roundlearn.sources.tables import table

INVERSE = {v: k for k, v in REMAP.items()}


def _vec(df):
    return df.withColumn("vec", F.array((F.col("value") / 100.0), (F.col("props_k").cast("double") / 100.0)))


def _datasets(spark, d):
    """Dataset A (first half of the month, own names) and dataset B (second
    half, renamed classes mapped back by the remap table)."""
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    a = _vec(events(spark, d).where(F.col("ts") < cut))
    b = remapped(spark, d).where(F.col("ts") >= cut)
    m = local_frame(spark, list(INVERSE.items()), "old string, new string")
    b = (b.join(F.broadcast(m), b["event_type"] == m["old"], "left")
          .withColumn("event_type", F.coalesce("new", "event_type")).drop("old", "new"))
    return a, _vec(b)


AB_SQL = f"""a AS (SELECT event_type, value / 100.0 AS x0, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS x1
      FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'),
b AS (SELECT event_id, event_type, value / 100.0 AS x0, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS x1
      FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}'),
dic AS (SELECT event_type AS class, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type FROM a))"""


def _dict_heads(spark, train, dic):
    h = centroid_heads(train, "event_type", "vec")
    order = L.dictionary_for(dic, "event_type").select(F.col("label").alias("class"), (F.col("id") + 1).alias("class_order"))
    return h.join(checked_broadcast(order), "class")


@query("cross_dataset_eval", f"""WITH {AB_SQL},
  hd AS (SELECT a.event_type AS class, d.id, avg(x0) AS m0, avg(x1) AS m1 FROM a JOIN dic d ON a.event_type = d.class GROUP BY 1, 2),
  sc AS (SELECT b.event_id, b.event_type AS y, h.class, h.id, b.x0 * h.m0 + b.x1 * h.m1 - 0.5 * (h.m0 * h.m0 + h.m1 * h.m1) AS logit
         FROM b JOIN hd h ON true WHERE b.event_type IN (SELECT class FROM dic)),
  pr AS (SELECT y, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY logit DESC, id) AS rn FROM sc) WHERE rn = 1),
  {prf_ctes('pr', "SELECT DISTINCT event_type AS class FROM b")}
  SELECT class, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1, support FROM pcm""")
def cross_dataset_eval(spark, d):
    """ML8: dictionary and heads fitted on A; B's rows renamed back, encoded
    with A's dictionary, scored by A's heads; metrics over B's classes."""
    a, b = _datasets(spark, d)
    dic = L.fit_dictionary(a, ["event_type"])
    heads = collect_heads(_dict_heads(spark, a, dic))
    b = L.encode(b, dic, "event_type", "y_id", unseen="skip")
    t = fusion.argmax_predict(score_wide(b, heads, "vec", "z"), class_names(heads))
    conf = small_local(M.confusion(t, "event_type", "pred"))
    classes = RD.present_classes(b, "event_type")
    return M.per_class(conf, classes).select("class", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                                             r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint"))


@query("head_refit", f"""WITH {AB_SQL}
  SELECT d.class, d.id, count(*) AS n_train, {s6('avg(b.x0)')} AS mu0, {s6('avg(b.x1)')} AS mu1,
    {s6('-0.5 * (avg(b.x0) * avg(b.x0) + avg(b.x1) * avg(b.x1))')} AS bias
  FROM b JOIN dic d ON b.event_type = d.class GROUP BY d.class, d.id""")
def head_refit(spark, d):
    """ML9: features frozen, only the head is refitted on dataset B, keeping
    A's dictionary (class ids)."""
    a, b = _datasets(spark, d)
    dic = L.fit_dictionary(a, ["event_type"])
    b = L.encode(b, dic, "event_type", "id", unseen="skip")
    h = centroid_heads(b, "event_type", "vec")
    ids = L.dictionary_for(dic, "event_type").withColumnRenamed("label", "class")
    return h.join(checked_broadcast(ids), "class").select("class", "id", "n_train", r6(F.col("mu")[0]).alias("mu0"),
                                                    r6(F.col("mu")[1]).alias("mu1"), r6(F.col("bias")).alias("bias"))


@query("rounds_loop", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT CAST(h.round AS INTEGER) AS round, h.class, (SELECT count(*) FROM s WHERE s.split = 'train' AND s.y = h.class) AS n_train,
  {s6('h.bias')} AS bias FROM heads h""")
def rounds_loop(spark, d):
    """STR1: rounds applied in order, each a Spark job: new classes (anti
    join on the registry), a head per new class over its own training rows,
    written to the round's partition; the registry grows by append."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("y"), "embedding")
    train = S.split(e, "key", test=0.4).where(F.col("split") == "train")
    path = scratch_path(spark, "rounds")
    known: set = set()
    nxt = 0
    for r, classes in RD.EMBEDDING_ROUNDS:
        # the round's new classes (a config-sized list, kept on the driver)
        new = [c for c in dict.fromkeys(map(str, classes)) if c not in known]
        if not new:
            continue                                    # no round number burnt
        reg = local_frame(spark, [(nxt, i + 1, c) for i, c in enumerate(new)], "round int, pos int, class string")
        h = RD.round_heads(train, reg, "y", "embedding")     # Spark job: this round's rows only
        sinks.save_heads(h.select("round", "class", "n_train", F.posexplode("mu").alias("dim", "value")), path)
        known.update(new)
        nxt += 1
    back = sinks.load_heads(spark, path)
    g = back.groupBy("round", "class").agg(F.first("n_train").alias("n_train"),
                                           (F.lit(-0.5) * F.sum(F.col("value") * F.col("value"))).alias("bias"))
    return g.select("round", "class", F.col("n_train").cast("bigint"), r6(F.col("bias")).alias("bias"))


# ------------------------------------------------------ trainable heads

def _prf_cells(conf, keys):
    """(keys, class, tp, pp, support, precision, recall, f1) from counts
    (keys, y, pred, n): every true and every predicted class has its row."""
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    hit = F.when(F.col("y") == F.col("pred"), n).otherwise(zero)
    both = F.array(F.struct(F.col("y").alias("class"), n.alias("sup"), hit.alias("hit"), zero.alias("got")),
                   F.struct(F.col("pred").alias("class"), zero.alias("sup"), zero.alias("hit"), n.alias("got")))
    c = (conf.select(*keys, F.explode(both).alias("c")).groupBy(*keys, F.col("c.class").alias("class"))
         .agg(F.sum("c.hit").alias("tp"), F.sum("c.got").alias("pp"), F.sum("c.sup").alias("support")))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))      # noqa: E731
    tp, pp, sup = F.col("tp"), F.col("pp"), F.col("support")
    return c.withColumns({"precision": ratio(tp, pp), "recall": ratio(tp, sup), "f1": ratio(tp * 2, pp + sup)})


def _weighted(cells, keys):
    m = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")      # noqa: E731
    return cells.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *[m(c) for c in ("precision", "recall", "f1")])


def _cells_sql(src, keys):
    """The same cells over predictions ``src`` (keys, y, pred)."""
    return f"""(SELECT {keys}, class, tp, pp, support, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN pp + support > 0 THEN 2.0 * tp / (pp + support) ELSE 0.0 END AS f1
  FROM (SELECT {keys}, class, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(pp) AS DOUBLE) AS pp, CAST(sum(sup) AS DOUBLE) AS support FROM
    (SELECT {keys}, y AS class, 1 AS sup, CAST(y = pred AS INTEGER) AS tp, 0 AS pp FROM {src}
     UNION ALL SELECT {keys}, pred, 0, 0, 1 FROM {src}) GROUP BY {keys}, class))"""


def _weighted_sql(src, keys):
    w = ", ".join(f"sum({m} * support) / sum(support) AS weighted_{m}" for m in ("precision", "recall", "f1"))
    return f"(SELECT {keys}, sum(tp) / sum(support) AS accuracy, {w} FROM {_cells_sql(src, keys)} GROUP BY {keys})"


BASE_TRAIN = """SELECT vec_id AS id, split, label AS y FROM (SELECT e.vec_id, e.label, s.split FROM embeddings e JOIN s ON e.vec_id = s.key)
  WHERE label IN (0, 1, 2)"""
BASE_DIMS = """SELECT vec_id AS id, u.j, CAST(u.v AS DOUBLE) AS v FROM embeddings, (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j) u
  WHERE label IN (0, 1, 2) UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings WHERE label IN (0, 1, 2)"""


def r4(c):
    return F.round(c.cast("double"), 4)


def s4(expr):
    return f"round(CAST({expr} AS DOUBLE), 4)"


@query("base_head_logreg", f"""WITH RECURSIVE {heads_ctes()} {descent_sql(BASE_TRAIN, BASE_DIMS, "3", DESCENT_STEPS, UNIT_CURVATURE)}
  SELECT id AS vec_id, CAST(y AS INTEGER) AS y, CAST(arg_max(k, (l, -k)) AS INTEGER) AS pred, {s4('max(l)')} AS logit,
  {s4('(SELECT objective FROM o WHERE t = ' + str(DESCENT_STEPS) + ')')} AS objective, true AS converged
  FROM l WHERE split = 'test' GROUP BY id, y""")
def base_head_logreg(spark, d):
    """ML1 trainable: multinomial logistic head on the round-0 classes, fitted
    to the tolerance, saved to the shared folder and read back (SNK1/SRC4);
    predictions on the test rows of those classes, with the objective."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", "embedding")
    base = materialize(S.split(e, "key", test=0.4).where(F.col("label").isin(0, 1, 2)))
    fit = gradient.fit(base.where(F.col("split") == "train"), [Objective("label", 3)], "embedding")
    path = scratch_path(spark, "softmax-round0")
    sinks.save_heads(gradient.to_frame(spark, fit.heads[0], 0), path)
    head = gradient.from_rows(sinks.load_heads(spark, path).where(F.col("round") == 0))
    p = gradient.predict(base.where(F.col("split") == "test"), head, "embedding", ["key", "label"])
    return p.select(F.col("key").alias("vec_id"), F.col("label").cast("int").alias("y"), "pred", r4(F.array_max("logits")).alias("logit"),
                    F.lit(round(fit.penalised(0), 4)).alias("objective"), F.lit(fit.converged).alias("converged"))


def _labelled_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return docs.join(lab, "doc_id")


_LABELLED = "(SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_TEXT_DIMS = text_features.vectors_sql("doc_id", TOK_SQL, _LABELLED)


def _ml_rows(label):
    split = split_case_sql(rank_sql("doc_id"), "count(*) OVER ()", 0.4)
    return f"SELECT doc_id AS id, {split} AS split, CAST({label} AS INTEGER) AS y FROM {_LABELLED}"


def _ml_out(label):
    src = predictions_sql(f"l{label}", "split = 'test'")
    return f"""SELECT '{label}' AS label_col, {s6('w.accuracy')} AS accuracy, {s6('c.precision')} AS precision, {s6('c.recall')} AS recall,
  {s6('c.f1')} AS f1, {s4(f"(SELECT avg(loss) FROM {src})")} AS loss, {s4(f"(SELECT objective FROM o{label} WHERE t = {DESCENT_STEPS})")} AS objective
  FROM {_weighted_sql(src, 'split')} w JOIN (SELECT * FROM {_cells_sql(src, 'split')} WHERE class = 1) c ON w.split = c.split"""


@query("multilabel_heads", f"""WITH RECURSIVE {", ".join(descent_sql(_ml_rows(c), _TEXT_DIMS, "2", DESCENT_STEPS, UNIT_CURVATURE, name=c) for c in ("quality", "toxic"))}
  {_ml_out("quality")} UNION ALL {_ml_out("toxic")}""")
def multilabel_heads(spark, d):
    """ML3: one binary logistic head per label column over the whole texts
    (hashed sparse token vectors), both fitted in the same passes; per-column
    binary metrics and loss on the test rows."""
    s = S.split(_labelled_texts(spark, d), "doc_id", test=0.4)
    s = materialize(text_features.text_vectors(s, "text", ["doc_id", "split", "quality", "toxic"]))
    objectives = [Objective("quality", 2), Objective("toxic", 2)]
    fit = gradient.fit(s.where(F.col("split") == "train"), objectives, "f", text_features.DIMS)
    out = None
    for i, (o, seen) in enumerate(zip(objectives, gradient.evaluate(s, objectives, "f", fit.heads), strict=True)):
        loss, cells = seen["test"]
        conf = local_frame(spark, [("test", *c) for c in gradient.confusion_rows(cells)], CONF_SCHEMA)
        cells = _prf_cells(conf, ["split"])
        r = (_weighted(cells, ["split"]).join(cells.where("class = '1'").select("split", "precision", "recall", "f1"), "split")
             .select(F.lit(o.label).alias("label_col"), *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                     r4(F.lit(loss)).alias("loss"), F.lit(round(fit.penalised(i), 4)).alias("objective")))
        out = r if out is None else out.unionByName(r)
    return out


CONF_SCHEMA = "split string, y string, pred string, n bigint"
_EV_DIMS = """SELECT event_id AS id, u.j, u.v FROM events, (SELECT unnest([1.0, value / (value + 100.0),
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0]) AS v, unnest([0, 1, 2]) AS j) u"""
EV_CURVATURE = 0.5 * 3.0 + gradient.RIDGE      # features in [0, 1] and the constant
_EV_TYPES = "(SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))"


def _ev_rows(label, val=None):
    split = split_case_sql(rank_sql("event_id"), "count(*) OVER ()", 0.4, val)
    return f"SELECT event_id AS id, {split} AS split, CAST({label} AS INTEGER) AS y FROM events JOIN {_EV_TYPES} ON event_type = t"


def _saturating(df):
    """Features in [0, 1]: a long-tailed value and a percentage."""
    return df.withColumn("vec", F.array(F.col("value") / (F.col("value") + 100.0), F.col("props_k").cast("double") / 100.0))


def _dual_out():
    b, m = (predictions_sql(f"l{x}", "split = 'test'") for x in ("bin", "mul"))
    long = lambda head, cls, src, cols, cut=s6: (      # noqa: E731
        f"SELECT '{head}' AS head, {cls} AS class, metric, {cut('value')} AS value FROM (SELECT * FROM {src}) UNPIVOT (value FOR metric IN ({cols}))")
    macro = f"(SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM {_cells_sql(m, 'split')})"
    at = f"WHERE t = {DESCENT_STEPS}"
    loss = (f"(SELECT (SELECT avg(loss) FROM {b}) AS loss_binary, (SELECT avg(loss) FROM {m}) AS loss_multi, "
            f"(SELECT avg(loss) FROM {b}) + (SELECT avg(loss) FROM {m}) AS loss_joint, "
            f"(SELECT objective FROM obin {at}) + (SELECT objective FROM omul {at}) AS train_objective)")
    w = "accuracy, weighted_precision, weighted_recall, weighted_f1"
    named = f"(SELECT c.precision, c.recall, c.f1, t.t FROM {_cells_sql(m, 'split')} c JOIN {_EV_TYPES} t ON c.class = t.i)"
    return " UNION ALL ".join([
        long("binary", "'1'", f"(SELECT precision, recall, f1 FROM {_cells_sql(b, 'split')} WHERE class = 1)", "precision, recall, f1"),
        long("binary", "NULL", _weighted_sql(b, "split"), w), long("multi", "t", named, "precision, recall, f1"),
        long("multi", "NULL", _weighted_sql(m, "split"), w), long("multi", "NULL", macro, "macro_precision, macro_recall, macro_f1"),
        long("joint", "NULL", loss, "loss_binary, loss_multi, loss_joint, train_objective", s4)])


@query("dual_head", f"""WITH RECURSIVE {descent_sql(_ev_rows("event_type = 'error'"), _EV_DIMS, "2", DESCENT_STEPS, EV_CURVATURE, name="bin")},
  {descent_sql(_ev_rows("i"), _EV_DIMS, f"(SELECT count(*) FROM {_EV_TYPES})", DESCENT_STEPS, EV_CURVATURE, name="mul")} {_dual_out()}""")
def dual_head(spark, d):
    """ML4: a binary head (error or not) and a multi-class head (event type)
    over the same features, fitted jointly: the summed loss of both goes down
    in the same passes. One report on the test rows: the positive class, every
    event type, weighted and macro P/R/F1, both losses and their sum, and the
    objective that was minimised."""
    e = _saturating(events(spark, d)).withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    dic = L.fit_dictionary(e, ["event_type"])
    e = L.encode(e, dic, "event_type", "type_id", unseen="keep")       # fitted on these rows: nothing is unseen
    s = materialize(S.split(e.select("event_id", "is_error", "type_id", "vec"), "event_id", test=0.4))
    names = [r["label"] for r in dic.orderBy("id").collect()]          # class-sized
    objectives = [Objective("is_error", 2), Objective("type_id", len(names))]
    fit = gradient.fit(s.where(F.col("split") == "train"), objectives, "vec")
    out, losses = [], {}
    for head_name, seen in zip(("binary", "multi"), gradient.evaluate(s, objectives, "vec", fit.heads), strict=True):
        loss, counts = seen["test"]
        conf = local_frame(spark, [("test", *c) for c in gradient.confusion_rows(counts)], CONF_SCHEMA)
        cells = _prf_cells(conf, ["split"])
        per = cells.where("class = '1'") if head_name == "binary" else cells.withColumn(
            "class", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("class").cast("int") + 1))
        lines = [M.long_metrics(per, ["class"], ["precision", "recall", "f1"]),
                 _no_class(M.long_metrics(_weighted(cells, ["split"]), [], ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]))]
        if head_name == "multi":
            macro = cells.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
            lines.append(_no_class(M.long_metrics(macro, [], ["macro_precision", "macro_recall", "macro_f1"])))
        out += [x.select(F.lit(head_name).alias("head"), "class", "metric", r6(F.col("value")).alias("value")) for x in lines]
        losses[f"loss_{head_name}"] = loss
    losses |= {"loss_joint": sum(losses.values()), "train_objective": fit.objective[-1]}
    out.append(local_frame(spark, [("joint", None, m, round(v, 4)) for m, v in losses.items()],
                           "head string, class string, metric string, value double"))
    all_rows = out[0]
    for x in out[1:]:
        all_rows = all_rows.unionByName(x)
    return all_rows


def _no_class(long):
    return long.withColumn("class", F.lit(None).cast("string"))


EPOCH_CHANGE = 1e-7       # relative change of the objective that ends the epochs
EPOCH_MOST = 80           # epochs that the SQL twin computes


def _epoch_sql():
    ctes = epochs_sql(descent_sql(_ev_rows("i", 0.2), _EV_DIMS, f"(SELECT count(*) FROM {_EV_TYPES})", EPOCH_MOST, EV_CURVATURE), EPOCH_MOST)
    return f"""WITH RECURSIVE {ctes},
  stop AS (SELECT min(t) AS last FROM (SELECT t, objective, lag(objective) OVER (ORDER BY t) AS was FROM o)
           WHERE abs(objective - was) <= {EPOCH_CHANGE!r} * abs(objective)),
  pe AS MATERIALIZED (SELECT t AS epoch, split, y, pred, loss FROM {predictions_sql('l', 't <= (SELECT last FROM stop)', 't, id, split, y')})
  SELECT 'run0' AS run, CAST(epoch AS INTEGER) AS epoch, split, metric, {s6('value')} AS value FROM
  (SELECT w.*, l.loss FROM {_weighted_sql('pe', 'epoch, split')} w JOIN (SELECT epoch, split, avg(loss) AS loss FROM pe GROUP BY ALL) l
   ON w.epoch = l.epoch AND w.split = l.split)
  UNPIVOT (value FOR metric IN (loss, accuracy, weighted_precision, weighted_recall, weighted_f1))"""


@query("epoch_metrics", _epoch_sql())
def epoch_metrics(spark, d):
    """ML12: loss, accuracy and weighted P/R/F1 of the multi-class head on
    each split before the first step (epoch 0) and after every full-batch
    step with momentum, until the objective changes by at most ``EPOCH_CHANGE``
    of itself, as a history table ``(run, epoch, split, metric, value)``."""
    e = _saturating(events(spark, d))
    dic = L.fit_dictionary(e, ["event_type"])
    e = L.encode(e, dic, "event_type", "type_id", unseen="keep")       # fitted on these rows: nothing is unseen
    s = materialize(S.split(e.select("event_id", "type_id", "vec"), "event_id", test=0.4, val=0.2))
    fit = gradient.descend(s, Objective("type_id", dic.count()), "vec", EV_CURVATURE, change=EPOCH_CHANGE)
    seen = [(t, split, loss, y, p, n) for t, at in enumerate(fit.epochs) for split, (loss, cells) in at.items()
            for (y, p), n in cells.items()]                            # epochs x splits x classes^2 counts
    conf = local_frame(spark, [(t, sp, loss, str(y), str(p), int(n)) for t, sp, loss, y, p, n in seen],
                       "epoch int, split string, loss double, y string, pred string, n bigint")
    keys = ["epoch", "split", "loss"]
    w = _weighted(_prf_cells(conf, keys), keys).withColumn("run", F.lit("run0"))
    return M.long_metrics(w, ["run", "epoch", "split"], ["loss", "accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]).withColumn(
        "value", r6(F.col("value")))


_LANG_IDS = """(SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS i FROM
  (SELECT DISTINCT lang FROM documents WHERE doc_id IN (SELECT id FROM sp WHERE split = 'train') AND lang IS NOT NULL))"""
_TEXT_ROWS = f"SELECT doc_id AS id, {split_case_sql(rank_sql('doc_id'), 'count(*) OVER ()', 0.4)} AS split FROM documents"


@query("text_label_head", f"""WITH RECURSIVE sp AS MATERIALIZED ({_TEXT_ROWS}), ids AS MATERIALIZED {_LANG_IDS},
  {descent_sql("SELECT sp.id, sp.split, g.i AS y FROM sp JOIN documents d ON sp.id = d.doc_id JOIN ids g ON d.lang = g.lang",
               text_features.vectors_sql("doc_id", TOK_SQL, "documents"), "(SELECT count(*) FROM ids)", DESCENT_STEPS, UNIT_CURVATURE)},
  tp0 AS (SELECT lower(trim(CAST(y AS VARCHAR))) AS y, lower(trim(CAST(pred AS VARCHAR))) AS pred FROM {predictions_sql('l', "split = 'test'")}),
  {prf_ctes('tp0')}
  SELECT {s6('100.0 * (SELECT avg(CAST(y = pred AS DOUBLE)) FROM tp0)')} AS accuracy, {s6('avg(precision)')} AS precision,
         {s6('avg(recall)')} AS recall, {s6('avg(f1)')} AS f1, {s4(f'(SELECT objective FROM o WHERE t = {DESCENT_STEPS})')} AS objective FROM pcm""")
def text_label_head(spark, d):
    """ML5: a head over whole texts that says the class id as text. The
    dictionary is fitted on the training part only, ids are written as text,
    the head is trained to the tolerance on sparse token vectors, and its
    predictions are scored as strings over the universe of true and predicted
    ids (JN5). Test rows of labels that training has not seen are not scored."""
    s = S.split(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", test=0.4)
    dic = L.fit_dictionary(s.where(F.col("split") == "train"), ["lang"])
    s = L.encode(s, dic, "lang", "y_id", unseen="skip")
    s = materialize(text_features.text_vectors(s, "text", ["split", "y_id"]))
    fit = gradient.fit(s.where(F.col("split") == "train"), [Objective("y_id", dic.count())], "f", text_features.DIMS)
    p = gradient.predict(s.where(F.col("split") == "test"), fit.heads[0], "f", ["y_id"])
    t = p.select(C.normalise_text(C.label_text_id(F.col("y_id"))).alias("y"), C.normalise_text(C.label_text_id(F.col("pred"))).alias("pred"))
    t = small_local(t.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n")))
    pc = M.per_class(t)
    # accuracy = sum(tp) / sum(support) over the universe: one aggregate, no join
    return pc.agg(r6(F.lit(100.0) * F.sum("tp") / F.sum("support")).alias("accuracy"),
                  *[r6(F.avg(m)).alias(m) for m in ("precision", "recall", "f1")], F.lit(round(fit.penalised(0), 4)).alias("objective"))


@query("head_convergence", f"""WITH RECURSIVE {heads_ctes()} {descent_sql(BASE_TRAIN, BASE_DIMS, "3", DESCENT_STEPS, UNIT_CURVATURE, name="base")},
  {descent_sql(_ev_rows("event_type = 'error'"), _EV_DIMS, "2", DESCENT_STEPS, EV_CURVATURE, name="bin")},
  {descent_sql(_ev_rows("i"), _EV_DIMS, f"(SELECT count(*) FROM {_EV_TYPES})", DESCENT_STEPS, EV_CURVATURE, name="mul")}
  {" UNION ALL ".join(f"SELECT '{n}' AS head, true AS converged, {s4('loss')} AS loss, {s4('objective')} AS objective FROM o{o} WHERE t = {DESCENT_STEPS}"
                      for n, o in (("base", "base"), ("binary", "bin"), ("multi", "mul")))}""")
def head_convergence(spark, d):
    """How the fits of the trained heads ended: whether the gradient reached
    the tolerance, the loss and the objective on the training rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("y"), "embedding")
    base = S.split(e, "key", test=0.4).where(F.col("y").isin(0, 1, 2))
    ev = _saturating(events(spark, d)).withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    dic = L.fit_dictionary(ev, ["event_type"])
    ev = L.encode(ev, dic, "event_type", "type_id", unseen="keep")
    ev = S.split(ev.select("event_id", "is_error", "type_id", "vec"), "event_id", test=0.4)
    out = []
    for names, rows, vec, objectives in (
            (["base"], base, "embedding", [Objective("y", 3)]),
            (["binary", "multi"], ev, "vec", [Objective("is_error", 2), Objective("type_id", dic.count())])):
        fit = gradient.fit(materialize(rows.where(F.col("split") == "train")), objectives, vec)
        out += [(n, fit.converged, round(fit.losses[i], 4), round(fit.penalised(i), 4)) for i, n in enumerate(names)]
    return local_frame(spark, out, "head string, converged boolean, loss double, objective double")
