"""Queries over ``embeddings`` with the round config: registry, heads,
scoring, fusion, argmax and the round evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roundlearn.operators import fusion, scorer
from roundlearn.operators import rounds as RD
from roundlearn.operators import sampling as S
from roundlearn.operators.heads import class_names
from roundlearn.plans.common import r6
from roundlearn.plans.evaluate import evaluate_rounds as _evaluate_rounds
from roundlearn.plans.evaluate import fused_blocks, fused_scores, prepare
from roundlearn.plans.oracle_evaluate import evaluate_rounds_sql, fused_ctes, heads_ctes, trained_rounds_sql
from roundlearn.plans.registry import query
from roundlearn.plans.sqlfrag import r6 as s6
from roundlearn.session import checked_broadcast, scratch_path, ship_package, small_local
from roundlearn.sources import sinks
from roundlearn.sources.tables import table

ER = RD.EMBEDDING_ROUNDS
# Edge cases of a round config: a class named in two rounds ('1'), an empty
# round (2), a round naming only known classes (3), a class with no rows ('x9').
EDGE_ROUNDS = [(0, ["0", "1", "2"]), (1, ["3", "4", "1"]), (2, []), (3, ["2"]), (4, ["5", "6"]), (5, ["7", "8", "x9"])]
N_EDGE = sum(len(c) for _, c in EDGE_ROUNDS)


def emb(spark, d):
    return prepare(table(spark, d, "embeddings"))


def _registry(spark, d, rounds=EDGE_ROUNDS):
    cfg = RD.config_table(spark, rounds)
    return RD.registry(cfg, present=RD.present_classes(emb(spark, d), "y"))


def _registry_sql(rounds=EDGE_ROUNDS) -> str:
    return f"""cfg0 AS (SELECT round, class, min(pos) AS pos FROM {RD.config_sql(rounds)} GROUP BY round, class),
cfg AS (SELECT * FROM cfg0 WHERE class IN (SELECT DISTINCT CAST(label AS VARCHAR) FROM embeddings)),
first AS (SELECT class, min(round) AS r0 FROM cfg GROUP BY class),
reg0 AS (SELECT c.round, c.pos, c.class FROM cfg c JOIN first f ON c.class = f.class AND c.round = f.r0),
reg AS (SELECT CAST(dense_rank() OVER (ORDER BY round) - 1 AS INTEGER) AS round,
               CAST(row_number() OVER (PARTITION BY round ORDER BY pos) AS INTEGER) AS pos, class,
               CAST(row_number() OVER (ORDER BY round, pos) AS INTEGER) AS class_order FROM reg0)"""


# ---------------------------------------------------------- registry

@query("registry_update", f"WITH {_registry_sql()} SELECT round, pos, class, class_order FROM reg")
def registry_update(spark, d):
    """STR2: the registry after the rounds, applied one round at a time
    (append-only, a round number only for a round with new classes)."""
    # registry state is one row per class: kept as a local relation each
    # round so the lineage does not grow with the number of rounds
    present = small_local(RD.present_classes(emb(spark, d), "y"))
    reg = None
    nxt = 0
    for r, classes in EDGE_ROUNDS:
        if not classes:
            continue
        new = small_local(RD.registry(RD.config_table(spark, [(r, classes)]), known=reg, present=present))
        if new.count() == 0:            # no class is new: no round number burnt
            continue
        base = 0 if reg is None else reg.count()
        new = (new.withColumn("round", F.lit(nxt))
                  .withColumn("class_order", (F.col("class_order") + F.lit(base)).cast("int")))
        reg = new if reg is None else small_local(reg.unionByName(new))
        nxt += 1
    return reg.select(F.col("round").cast("int"), "pos", "class", "class_order")


@query("rounds_assign", f"""WITH {_registry_sql()} SELECT class, CAST(min(round) AS INTEGER) AS first_round FROM cfg GROUP BY class""")
def rounds_assign(spark, d):
    cfg = RD.config_table(spark, EDGE_ROUNDS).join(RD.present_classes(emb(spark, d), "y"), "class", "left_semi")
    return RD.rounds_assign(cfg).select("class", F.col("first_round").cast("int"))


@query("class_order", f"WITH {_registry_sql()} SELECT class, class_order FROM reg")
def class_order(spark, d):
    return _registry(spark, d).select("class", "class_order")


@query("class_round_lookup", f"""WITH {_registry_sql()}
  SELECT round, string_agg(class, ',' ORDER BY pos) AS classes FROM reg GROUP BY round""")
def class_round_lookup(spark, d):
    reg = _registry(spark, d)
    g = reg.groupBy("round").agg(F.sort_array(F.collect_list(F.struct("pos", "class"))).alias("_c"))
    return g.select("round", F.array_join(F.transform("_c", lambda x: x["class"]), ",").alias("classes"))


@query("registry_union", f"""WITH {_registry_sql()}
  SELECT DISTINCT class FROM (SELECT class FROM reg WHERE round = 0 UNION ALL
    SELECT class FROM (VALUES ('3'), ('4'), ('1')) v(class) WHERE class IN (SELECT DISTINCT CAST(label AS VARCHAR) FROM embeddings))""")
def registry_union(spark, d):
    reg = _registry(spark, d)
    cand = RD.config_table(spark, [(1, ["3", "4", "1"])]).select("class").join(
        RD.present_classes(emb(spark, d), "y"), "class", "left_semi")
    return reg.where(F.col("round") == 0).select("class").unionByName(cand).distinct()


@query("registry_difference", f"""WITH {_registry_sql()}, req AS (SELECT * FROM (VALUES ('3'), ('4'), ('1'), ('2')) v(class)
    WHERE class IN (SELECT DISTINCT CAST(label AS VARCHAR) FROM embeddings))
  SELECT class, 'known' AS status FROM req WHERE class IN (SELECT class FROM reg WHERE round = 0)
  UNION ALL SELECT class, 'new' FROM req WHERE class NOT IN (SELECT class FROM reg WHERE round = 0)""")
def registry_difference(spark, d):
    known = _registry(spark, d).where(F.col("round") == 0).select("class")
    req = RD.config_table(spark, [(1, ["3", "4", "1", "2"])]).select("class").join(
        RD.present_classes(emb(spark, d), "y"), "class", "left_semi")
    return (req.intersect(known).withColumn("status", F.lit("known"))
            .unionByName(req.exceptAll(known).withColumn("status", F.lit("new"))))


@query("rounds_flatten", f"""WITH {_registry_sql()}
  SELECT round, pos, class, CAST(row_number() OVER (ORDER BY round, pos) AS INTEGER) AS flat_pos FROM reg""")
def rounds_flatten(spark, d):
    """SET3: the registry as a list of class lists, flattened with two
    ``posexplode`` (the nested list is one small row per class universe)."""
    reg = _registry(spark, d)
    per = reg.groupBy("round").agg(F.sort_array(F.collect_list(F.struct("pos", "class"))).alias("cs"))
    nested = per.agg(F.sort_array(F.collect_list(F.struct("round", "cs"))).alias("rs"))
    a = nested.select(F.posexplode("rs").alias("ri", "r"))
    b = a.select("ri", F.col("r.round").alias("round"), F.posexplode("r.cs").alias("ci", "c"))
    b = b.select("ri", "ci", "round", F.col("c.pos").alias("pos"), F.col("c.class").alias("class"))
    return b.select("round", "pos", "class",
                    F.row_number().over(Window.orderBy("ri", "ci")).cast("int").alias("flat_pos"))


@query("model_summary", f"""WITH {_registry_sql()}
  SELECT CAST(max(round) AS INTEGER) AS current_round, count(*) AS total_classes, count(DISTINCT round) AS rounds,
    string_agg(CASE WHEN round = 0 THEN class END, ',' ORDER BY class_order) AS base_classes,
    string_agg(class || ':' || CAST(round AS VARCHAR), ',' ORDER BY class_order) AS class_to_round FROM reg""")
def model_summary(spark, d):
    return RD.model_summary(_registry(spark, d))


@query("experiment_setup", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT CAST(g.round AS INTEGER) AS round, CAST(g.pos AS INTEGER) AS pos, g.class,
    (SELECT count(*) FROM s WHERE s.split = 'train' AND s.y = g.class) AS train_rows FROM reg g""")
def experiment_setup(spark, d):
    """ML11: the standard 4-round config (3/2/2/2 classes) with the training
    rows each round's head sees."""
    reg = RD.registry(RD.config_table(spark, ER))
    s = S.split(emb(spark, d), "key", test=0.4).where(F.col("split") == "train")
    cnt = RD.known_rows(s, reg, "y").groupBy(F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("train_rows"))
    return reg.join(cnt, "class", "left").fillna(0, ["train_rows"]).select("round", "pos", "class", "train_rows")


MIXED = {0: "softmax", 1: "centroid", 2: "softmax", 3: "centroid"}


# ------------------------------------------------------------- heads

def _heads(spark, d, rounds=ER):
    reg = RD.registry(RD.config_table(spark, rounds))
    s = S.split(emb(spark, d), "key", test=0.4)
    return RD.round_heads(s.where(F.col("split") == "train"), reg, "y", "embedding")


@query("base_head_centroid", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT h.class, (SELECT count(*) FROM s WHERE s.split = 'train' AND s.y = h.class) AS n_train, {s6('h.bias')} AS bias
  FROM heads h WHERE h.round = 0""")
def base_head_centroid(spark, d):
    h = _heads(spark, d, ER[:1])
    return h.select("class", "n_train", r6(F.col("bias")).alias("bias"))


@query("round_head", f"""WITH {heads_ctes()} x AS (SELECT 1)
  SELECT h.class, (SELECT count(*) FROM s WHERE s.split = 'train' AND s.y = h.class) AS n_train, {s6('h.bias')} AS bias
  FROM heads h WHERE h.round = 2""")
def round_head(spark, d):
    """ML2: the head of round 2 is fitted on rows of that round's new
    classes only (a semi join on the registry)."""
    reg = RD.registry(RD.config_table(spark, ER)).where(F.col("round") == 2)
    s = S.split(emb(spark, d), "key", test=0.4).where(F.col("split") == "train")
    h = RD.round_heads(s, reg, "y", "embedding")
    return h.select("class", "n_train", r6(F.col("bias")).alias("bias"))


# ------------------------------------------------------ scoring/fusion

def _long(spark, d, zscore, col):
    t, heads, _ = fused_scores(spark, emb(spark, d), ER, zscore, batches=zscore == "batch")
    names = class_names(heads)
    long = fusion.to_long(t, ["key"], names, col, "v")
    return long.select(F.col("key").alias("vec_id"), "class", r6(F.col("v")).alias(col))


@query("score_by_heads", f"WITH {fused_ctes(ER, 'none')} x AS (SELECT 1) SELECT key AS vec_id, class, {s6('logit')} AS logits FROM zz")
def score_by_heads(spark, d):
    return _long(spark, d, "none", "logits")


@query("zscore_batch", f"WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1) SELECT key AS vec_id, class, {s6('z')} AS z FROM zz")
def zscore_batch(spark, d):
    return _long(spark, d, "batch", "z")


@query("zscore_row", f"WITH {fused_ctes(ER, 'row')} x AS (SELECT 1) SELECT key AS vec_id, class, {s6('z')} AS z FROM zz")
def zscore_row(spark, d):
    return _long(spark, d, "row", "z")


@query("zscore_global", f"WITH {fused_ctes(ER, 'global')} x AS (SELECT 1) SELECT key AS vec_id, class, {s6('z')} AS z FROM zz")
def zscore_global(spark, d):
    return _long(spark, d, "global", "z")


@query("batch_id", f"WITH {fused_ctes(ER, 'none')} x AS (SELECT 1) SELECT key AS vec_id, CAST(batch_id AS INTEGER) AS batch_id FROM tb")
def batch_id(spark, d):
    reg = RD.registry_frame(spark, ER)
    s = S.split(emb(spark, d), "key", test=0.4).where(F.col("split") == "test")
    return S.with_batches(RD.known_rows(s, reg, "y").select("key"), "key").select(F.col("key").alias("vec_id"), "batch_id")


@query("argmax_class", f"WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1) SELECT key AS vec_id, pred FROM pr")
def argmax_class(spark, d):
    t, _, _ = fused_scores(spark, emb(spark, d), ER, "batch")
    return t.select(F.col("key").alias("vec_id"), "pred")


@query("fused_predict", f"""WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1)
  SELECT p.key AS vec_id, p.y, CAST(b.batch_id AS INTEGER) AS batch_id, p.pred FROM pr p JOIN tb b ON p.key = b.key""")
def fused_predict(spark, d):
    t, _, _ = fused_scores(spark, emb(spark, d), ER, "batch")
    return t.select(F.col("key").alias("vec_id"), "y", "batch_id", "pred")


@query("fused_predict_blocks", f"""WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1)
  SELECT p.key AS vec_id, p.y, CAST(b.batch_id AS INTEGER) AS batch_id, p.pred, {s6('l.loss')} AS loss
  FROM pr p JOIN tb b ON p.key = b.key LEFT JOIN lo l ON p.key = l.key""")
def fused_predict_blocks(spark, d):
    """JN8/ML6 for any number of classes, here by blocks of four heads: the
    best score, the first in class order, and the loss over all blocks."""
    t, _ = fused_blocks(spark, emb(spark, d), ER, block=4)
    return t.select(F.col("key").alias("vec_id"), "y", "batch_id", "pred", r6(F.col("loss")).alias("loss"))


@query("known_classes_only", f"WITH {fused_ctes(ER, 'none')} x AS (SELECT 1) SELECT key AS vec_id, y FROM te")
def known_classes_only(spark, d):
    reg = RD.registry(RD.config_table(spark, ER))
    s = S.split(emb(spark, d), "key", test=0.4).where(F.col("split") == "test")
    return RD.known_rows(s, reg, "y").select(F.col("key").alias("vec_id"), "y")


@query("concat_batches", f"""WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1) SELECT 'batch' AS run, key AS vec_id, pred FROM pr
  UNION ALL (WITH {fused_ctes(ER, 'row')} x AS (SELECT 1) SELECT 'row', key, pred FROM pr)""")
def concat_batches(spark, d):
    t, heads, _ = fused_scores(spark, emb(spark, d), ER, "none")      # one split, one heads fit, one scoring
    t = t.select("key", "batch_id", "logits")
    names = class_names(heads)
    a = fusion.argmax_predict(fusion.zscore_batch(t, len(heads)), names)
    b = fusion.argmax_predict(fusion.zscore_row(t), names)
    return (a.select(F.lit("batch").alias("run"), F.col("key").alias("vec_id"), "pred")
            .unionByName(b.select(F.lit("row").alias("run"), F.col("key").alias("vec_id"), "pred")))


@query("score_matrix", f"""WITH {fused_ctes(ER, 'batch')} x AS (SELECT 1)
  SELECT key AS vec_id, """ + ", ".join(f"{s6(f'max(CASE WHEN class = {chr(39)}{c}{chr(39)} THEN z END)')} AS c{c}"
                                        for _, cs in ER for c in cs) + " FROM zz GROUP BY key")
def score_matrix(spark, d):
    """AGG24: one row per example and one column per class of the config,
    taken from the row's score array (null for a class without a head)."""
    t, heads, _ = fused_scores(spark, emb(spark, d), ER, "batch")
    at = {str(h["class"]): i for i, h in enumerate(heads)}
    return t.select(F.col("key").alias("vec_id"), *[
        (r6(F.col("z")[at[c]]) if c in at else F.lit(None).cast("double")).alias(f"c{c}") for _, cs in ER for c in cs])


@query("score_stats", f"""WITH {fused_ctes(ER, 'none')} x AS (SELECT 1)
  SELECT class, {s6('avg(logit)')} AS mean, {s6('stddev_pop(logit)')} AS std, {s6('max(logit)')} AS max FROM zz GROUP BY class""")
def score_stats(spark, d):
    t, heads, _ = fused_scores(spark, emb(spark, d), ER, "none", batches=False)
    lg = F.col("logits")            # unrounded; one partial aggregate of 3K numbers, no explode
    lines = F.array(*[F.struct(F.lit(str(h["class"])).alias("class"), r6(F.avg(lg[i])).alias("mean"),
                               r6(F.stddev_pop(lg[i])).alias("std"), r6(F.max(lg[i])).alias("max")) for i, h in enumerate(heads)])
    return t.agg(lines.alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("evaluate_rounds", evaluate_rounds_sql(ER, "batch"))
def evaluate_rounds(spark, d):
    return _evaluate_rounds(spark, table(spark, d, "embeddings"), ER, "batch")


@query("evaluate_rounds_global", evaluate_rounds_sql(ER, "global"))
def evaluate_rounds_global(spark, d):
    """The batch-independent variant (z-score over all test rows)."""
    return _evaluate_rounds(spark, table(spark, d, "embeddings"), ER, "global")


@query("evaluate_rounds_trained", trained_rounds_sql(ER, {0: "softmax", 1: "softmax", 2: "softmax", 3: "softmax"}))
def evaluate_rounds_trained(spark, d):
    """ML2/ML6/ML7 with trained heads: a softmax head for every round over
    its new classes, all fitted to the tolerance, fused and evaluated."""
    return _evaluate_rounds(spark, table(spark, d, "embeddings"), ER, "batch", kinds={})


@query("evaluate_rounds_mixed", trained_rounds_sql(ER, MIXED))
def evaluate_rounds_mixed(spark, d):
    """The fusion of heads of two kinds: trained ones in rounds 0 and 2,
    centroids in the others."""
    return _evaluate_rounds(spark, table(spark, d, "embeddings"), ER, "batch", kinds=MIXED)


# ----------------------------------------------------- python scoring

@query("batch_score", f"""WITH {fused_ctes(ER, 'none')} x AS (SELECT 1)
  SELECT key AS vec_id, class AS pred FROM
  (SELECT key, class, row_number() OVER (PARTITION BY key ORDER BY logit DESC, class_order) AS rn FROM zz) WHERE rn = 1""")
def batch_score(spark, d):
    """UDF4: the extension point for a model that is not an expression: heads
    saved to the shared folder (SNK1), packed once, unpacked once by a worker
    and cached by version; each Arrow batch is scored with numpy."""
    path = scratch_path(spark, "scorer-heads")
    sinks.save_heads(_heads(spark, d).select("round", "class", F.posexplode("mu").alias("dim", "value")), path)
    order = {c: k for _, _, c, k in RD.registry_rows(ER)}
    packed = spark.sparkContext.broadcast(scorer.pack(spark, path, order))          # one row a class
    ship_package(spark)
    reg = RD.registry_frame(spark, ER)
    s = S.split(emb(spark, d), "key", test=0.4).where(F.col("split") == "test")
    rows = RD.known_rows(s, reg, "y").select(F.col("key").alias("vec_id"), "embedding")
    return scorer.score(rows, path, packed, "embedding", ["vec_id"]).drop("loads")


@query("row_dataset", f"""WITH {heads_ctes()} x AS (SELECT 1),
  nn AS (SELECT e.vec_id, sqrt(sum(CAST(u.v AS DOUBLE) * CAST(u.v AS DOUBLE))) AS norm, count(*) AS dims FROM embeddings e,
         (SELECT unnest(e.embedding) AS v) u GROUP BY e.vec_id)
  SELECT e.vec_id, CAST(coalesce(g.class_order - 1, -1) AS INTEGER) AS y_index, nn.dims, {s6('nn.norm')} AS norm
  FROM embeddings e JOIN nn ON e.vec_id = nn.vec_id LEFT JOIN reg g ON CAST(e.label AS VARCHAR) = g.class""")
def row_dataset(spark, d):
    """UDF5: per-row (features, label id) as a native projection."""
    reg = RD.registry(RD.config_table(spark, ER))
    e = emb(spark, d)
    m = checked_broadcast(reg.select(F.col("class").alias("y"), (F.col("class_order") - 1).alias("y_index")))
    e = e.join(m, "y", "left")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(F.col("key").alias("vec_id"), F.coalesce("y_index", F.lit(-1)).cast("int").alias("y_index"),
                    F.size("embedding").cast("bigint").alias("dims"),
                    r6(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))).alias("norm"))
