"""Queries over ``documents`` join ``labels`` (multi-label: blocks lang,
quality, toxic) and over the document texts (tokens, masks, prefixes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundlearn.functions import columns as C
from roundlearn.operators import labels as L
from roundlearn.operators import metrics as M
from roundlearn.operators import text_features
from roundlearn.plans.common import BLOCKS, DOC_DICT_SQL, DOC_LABELS_SQL, doc_labels, r6
from roundlearn.plans.registry import query
from roundlearn.plans.sqlfrag import r6 as s6
from roundlearn.session import checked_broadcast, local_frame, small_local
from roundlearn.sources.tables import table

VOCAB = 30522


def _dict(dl):
    return L.fit_dictionary(dl, BLOCKS)


def label_sets(spark, d):
    """``doc_id, y_set, p_set`` (positions of the true and of the predicted
    labels) with the ids behind them, the block layout and the dictionary."""
    dl = doc_labels(spark, d)
    dic = _dict(dl)
    layout = L.block_layout(dic, BLOCKS)
    dl = L.encode_all(dl, dic, BLOCKS)
    # predicted blocks use the same dictionary (renamed columns)
    for b in BLOCKS:
        pd_ = (L.dictionary_for(dic, b).withColumnRenamed("label", f"{b}_p").withColumnRenamed("id", f"{b}_pid"))
        dl = dl.join(checked_broadcast(pd_), f"{b}_p", "left")
    dl = dl.withColumns({"y_set": L.label_positions(layout, [f"{b}_id" for b in BLOCKS]),
                         "p_set": L.label_positions(layout, [f"{b}_pid" for b in BLOCKS])})
    return dl, layout, dic


def multi_hot_frame(spark, d):
    """``doc_id, y, p`` (multi-hot arrays of width 8), the block layout and
    the dictionary."""
    dl, layout, dic = label_sets(spark, d)
    dl = L.multi_hot_labels(dl, layout, [f"{b}_id" for b in BLOCKS], "y")
    dl = L.multi_hot_labels(dl, layout, [f"{b}_pid" for b in BLOCKS], "p")
    return dl, layout, dic


def block_table(spark, dic, layout):
    """``(j, block, class)`` for every multi-hot column."""
    off = {b: o for b, o, _ in layout}
    rows = dic.select("label_col", "label", "id").collect()        # the dictionary: one row per class
    return local_frame(spark, [(off[r["label_col"]] + r["id"], r["label_col"], r["label"]) for r in rows],
                                 "j int, block string, class string")


def cells(spark, d):
    dl, layout, dic = label_sets(spark, d)
    width = sum(w for _, _, w in layout)
    return small_local(M.cell_sums_of_sets(dl, "y_set", "p_set", width)), block_table(spark, dic, layout), dl


BASE_SQL = f"""dl AS {DOC_LABELS_SQL},
dct AS {DOC_DICT_SQL},
b AS (SELECT dl.doc_id, l1.pos AS ya, l2.pos AS yb, l3.pos AS yc, p1.pos AS pa, p2.pos AS pb, p3.pos AS pc
      FROM dl JOIN dct l1 ON l1.label_col = 'lang' AND l1.label = dl.lang
      JOIN dct l2 ON l2.label_col = 'quality' AND l2.label = dl.quality
      JOIN dct l3 ON l3.label_col = 'toxic' AND l3.label = dl.toxic
      JOIN dct p1 ON p1.label_col = 'lang' AND p1.label = dl.lang_p
      JOIN dct p2 ON p2.label_col = 'quality' AND p2.label = dl.quality_p
      JOIN dct p3 ON p3.label_col = 'toxic' AND p3.label = dl.toxic_p),
cl AS (SELECT b.doc_id, u.j, CAST(u.j IN (ya, yb, yc) AS INTEGER) AS y, CAST(u.j IN (pa, pb, pc) AS INTEGER) AS p
       FROM b, (SELECT unnest(range((SELECT count(*) FROM dct))) AS j) u),
cj AS (SELECT CAST(j AS INTEGER) AS j, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM cl GROUP BY j),
cm AS (SELECT cj.*, tp + fn AS support, d.label_col AS block, d.label AS class,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
       FROM cj JOIN dct d ON cj.j = d.pos)"""


def _vec_sql(a, b, c):
    return f"array_to_string(list_transform(range((SELECT count(*) FROM dct)), lambda i: CAST(i IN ({a}, {b}, {c}) AS INTEGER)), ',')"


# ------------------------------------------------------------ labels

@query("pair_counts", f"SELECT CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, count(*) AS n FROM {DOC_LABELS_SQL} GROUP BY 1, 2")
def pair_counts(spark, d):
    dl = doc_labels(spark, d)
    return dl.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("block_offsets", f"""SELECT label_col, count(*) AS n_classes, CAST(min(pos) AS BIGINT) AS "offset" FROM {DOC_DICT_SQL} GROUP BY label_col""")
def block_offsets(spark, d):
    dic = _dict(doc_labels(spark, d))
    return L.block_offsets(dic, BLOCKS).select("label_col", F.col("n_classes").cast("bigint"), "offset")


@query("class_totals", f"""SELECT label_col, count(*) AS n_classes FROM {DOC_DICT_SQL} GROUP BY label_col
  UNION ALL SELECT 'total', count(*) FROM {DOC_DICT_SQL}""")
def class_totals(spark, d):
    t = L.class_totals(_dict(doc_labels(spark, d)))
    return t.unionByName(t.agg(F.sum("n_classes").alias("n_classes")).select(F.lit("total").alias("label_col"), "n_classes"))


@query("dictionary_listing", f"SELECT label_col, id, label FROM {DOC_DICT_SQL}")
def dictionary_listing(spark, d):
    return _dict(doc_labels(spark, d)).orderBy("label_col", "id").select("label_col", "id", "label")


@query("multi_hot", f"WITH {BASE_SQL} SELECT doc_id, {_vec_sql('ya', 'yb', 'yc')} AS y FROM b")
def multi_hot(spark, d):
    dl, _, _ = multi_hot_frame(spark, d)
    return dl.select("doc_id", F.array_join("y", ",").alias("y"))


@query("one_hot_concat", f"""WITH {BASE_SQL} SELECT doc_id, array_to_string(
  list_transform(range(nl), lambda i: CAST(i = ya AS INTEGER)) || list_transform(range(nq), lambda i: CAST(i = yb - nl AS INTEGER)), ',') AS x
  FROM b, (SELECT count(*) FILTER (label_col = 'lang') AS nl, count(*) FILTER (label_col = 'quality') AS nq FROM dct)""")
def one_hot_concat(spark, d):
    dl = doc_labels(spark, d)
    dic = _dict(dl)
    widths = [w for _, _, w in L.block_layout(dic, ["lang", "quality"])]
    dl = L.encode_all(dl, dic, ["lang", "quality"], unseen="keep")      # fitted on these rows: nothing is unseen
    return dl.select("doc_id", F.array_join(C.one_hot_concat([F.col("lang_id"), F.col("quality_id")], widths), ",").alias("x"))


@query("label_block_slice", f"""WITH {BASE_SQL} SELECT doc_id, array_to_string(list_slice(
  list_transform(range((SELECT count(*) FROM dct)), lambda i: CAST(i IN (ya, yb, yc) AS INTEGER)), 5, 6), ',') AS quality_block FROM b""")
def label_block_slice(spark, d):
    dl, layout, _ = multi_hot_frame(spark, d)
    off, w = {b: (o, w) for b, o, w in layout}["quality"]
    return dl.select("doc_id", F.array_join(C.block_slice(F.col("y"), off, w), ",").alias("quality_block"))


@query("class_subset", f"""WITH {BASE_SQL} SELECT doc_id, concat(CAST(ya = (SELECT pos FROM dct WHERE label_col = 'lang' AND label = 'de') AS INTEGER),
  ',', CAST(ya = (SELECT pos FROM dct WHERE label_col = 'lang' AND label = 'en') AS INTEGER)) AS subset FROM b""")
def class_subset(spark, d):
    """Keep the columns of chosen classes, found by name in the dictionary
    (never hard-coded positions)."""
    dl, layout, dic = multi_hot_frame(spark, d)
    pos = {r["label"]: r["id"] for r in L.dictionary_for(dic, "lang").collect()}      # tiny dictionary
    off = {b: o for b, o, _ in layout}["lang"]
    return dl.select("doc_id", F.array_join(C.class_subset(F.col("y"), [off + pos["de"], off + pos["en"]]), ",").alias("subset"))


# ------------------------------------------------------------ metrics

@query("prf_multilabel", f"""WITH {BASE_SQL} SELECT j, block, class, {s6('precision')} AS precision, {s6('recall')} AS recall,
  {s6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM cm""")
def prf_multilabel(spark, d):
    c, blocks, _ = cells(spark, d)
    m = M.multilabel(c).join(checked_broadcast(blocks), "j")
    return m.select("j", "block", "class", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint"))


@query("prf_micro", f"""WITH {BASE_SQL}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cj),
  pr AS (SELECT CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS r FROM t)
  SELECT {s6('p')} AS precision, {s6('r')} AS recall, {s6('2.0 * p * r / (p + r + 1e-7)')} AS f1 FROM pr""")
def prf_micro(spark, d):
    c, _, _ = cells(spark, d)
    return M.micro(c).select(*[r6(F.col(m)).alias(m) for m in ("precision", "recall", "f1")])


@query("prf_group_macro", f"""WITH {BASE_SQL} SELECT block, {s6('avg(precision)')} AS precision, {s6('avg(recall)')} AS recall,
  {s6('avg(f1)')} AS f1 FROM cm GROUP BY block""")
def prf_group_macro(spark, d):
    c, blocks, _ = cells(spark, d)
    m = M.multilabel(c).join(checked_broadcast(blocks), "j")
    return m.groupBy("block").agg(*[r6(F.avg(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("prf_group_macro_subset", f"""WITH {BASE_SQL},
  pres AS (SELECT DISTINCT 'lang' AS block, lang AS class FROM dl WHERE toxic = '1'
           UNION SELECT DISTINCT 'quality', quality FROM dl WHERE toxic = '1'
           UNION SELECT DISTINCT 'toxic', toxic FROM dl WHERE toxic = '1')
  SELECT block, {s6('avg(precision)')} AS precision, {s6('avg(recall)')} AS recall, {s6('avg(f1)')} AS f1
  FROM cm WHERE (block, class) IN (SELECT block, class FROM pres) GROUP BY block""")
def prf_group_macro_subset(spark, d):
    """Block macro over the classes present in a second dataset (here the
    toxic documents), found by a semi join on names."""
    c, blocks, dl = cells(spark, d)
    b = dl.where(F.col("toxic") == "1")
    # one scan for all blocks: its distinct (block, class) names
    names = F.explode(F.array(*[F.struct(F.lit(x).alias("block"), F.col(x).alias("class")) for x in BLOCKS]))
    pres = checked_broadcast(b.select(names.alias("x")).select("x.*").distinct())
    m = M.multilabel(c).join(checked_broadcast(blocks), "j").join(pres, ["block", "class"], "left_semi")
    return m.groupBy("block").agg(*[r6(F.avg(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("accuracy_cells", f"WITH {BASE_SQL} SELECT {s6('100.0 * avg(CAST(y = p AS DOUBLE))')} AS accuracy_cells FROM cl")
def accuracy_cells(spark, d):
    dl, layout, _ = label_sets(spark, d)
    return M.accuracy_cells_of_sets(dl, "y_set", "p_set", sum(w for _, _, w in layout)).select(r6(F.col("accuracy_cells")).alias("accuracy_cells"))


@query("prf_report", f"""WITH {BASE_SQL}
  SELECT 'class' AS scope, block, class, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM cm
  UNION ALL SELECT 'block', block, NULL, {s6('avg(precision)')}, {s6('avg(recall)')}, {s6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM cm GROUP BY block
  UNION ALL SELECT 'all', NULL, NULL, {s6('avg(precision)')}, {s6('avg(recall)')}, {s6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM cm""")
def prf_report(spark, d):
    c, blocks, _ = cells(spark, d)
    r = M.report(c, blocks)
    return r.select("scope", "block", "class", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint"))


@query("f1_aggregate", f"""WITH {BASE_SQL}, g AS (SELECT dl.lang, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn
    FROM cl JOIN dl ON cl.doc_id = dl.doc_id GROUP BY dl.lang),
  pr AS (SELECT lang, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS p,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS r FROM g)
  SELECT lang, {s6('p')} AS precision, {s6('r')} AS recall, {s6('2.0 * p * r / (p + r + 1e-7)')} AS f1 FROM pr""")
def f1_aggregate(spark, d):
    """The streaming F1 metric (state = tp/fp/fn sums, result = 2pr/(p+r+eps))
    as a built-in grouped aggregate with map-side partial sums, per group."""
    dl, _, _ = label_sets(spark, d)
    tp = F.size(F.array_intersect("y_set", "p_set"))
    g = dl.groupBy("lang").agg(F.sum(tp).alias("tp"), F.sum(F.size("p_set") - tp).alias("fp"), F.sum(F.size("y_set") - tp).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    g = g.select("lang", p.alias("p"), r.alias("r"))
    return g.select("lang", r6(F.col("p")).alias("precision"), r6(F.col("r")).alias("recall"),
                    r6(F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + F.lit(C.F1_EPS))).alias("f1"))


# -------------------------------------------------------------- text

TOK_SQL = f"list_transform(regexp_split_to_array(text, '\\s+'), lambda t: CAST(('0x' || substr(md5(t), 1, 7))::BIGINT % {VOCAB} AS INTEGER))"


@query("tokenise_hash", f"""SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(ids) AS BIGINT) AS id_sum,
  md5(array_to_string(ids, ',')) AS ids_md5 FROM (SELECT doc_id, {TOK_SQL} AS ids FROM documents)""")
def tokenise_hash(spark, d):
    t = text_features.hashed_ids(table(spark, d, "documents"), "text", ["doc_id"], VOCAB)
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
                    F.md5(F.array_join("ids", ",")).alias("ids_md5"))


PAD_SQL = "list_slice(ids || list_transform(range(128), lambda i: 0), 1, 128)"


@query("pad_truncate", f"""SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, array_to_string({PAD_SQL}, ',') AS input_ids
  FROM (SELECT doc_id, {TOK_SQL} AS ids FROM documents)""")
def pad_truncate(spark, d):
    t = table(spark, d, "documents").select("doc_id", C.tokens(F.col("text")).alias("toks"))
    ids = F.transform(F.slice("toks", 1, C.MAX_TOKENS), lambda w: C.token_id(w, VOCAB))      # only the kept ones are hashed
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.array_join(C.pad_truncate(ids), ",").alias("input_ids"))


MASK_SQL = "list_transform(range(1, 129), lambda i: CAST(i <= least(len(ids), 128) AS INTEGER))"


@query("attention_mask", f"""SELECT doc_id, CAST(list_sum({MASK_SQL}) AS BIGINT) AS mask_sum, array_to_string({MASK_SQL}, ',') AS mask
  FROM (SELECT doc_id, {TOK_SQL} AS ids FROM documents)""")
def attention_mask(spark, d):
    t = table(spark, d, "documents").select("doc_id", C.attention_mask(C.tokens(F.col("text"))).alias("m"))
    return t.select("doc_id", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join("m", ",").alias("mask"))


LBL_SQL = f"list_slice(list_transform(regexp_split_to_array(lang, '\\s+'), lambda t: CAST(('0x' || substr(md5(t), 1, 7))::BIGINT % {VOCAB} AS INTEGER)) || list_transform(range(10), lambda i: 0), 1, 10)"


@query("label_mask", f"""SELECT doc_id, array_to_string(list_transform({LBL_SQL}, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END), ',') AS masked,
  array_to_string({LBL_SQL}, ',') AS unmasked FROM documents""")
def label_mask(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    ids = C.pad_truncate(C.tokenise_hash(F.col("lang"), VOCAB), C.LABEL_TOKENS)
    m = C.label_mask(ids)
    return t.select("doc_id", F.array_join(m, ",").alias("masked"), F.array_join(C.label_unmask(m), ",").alias("unmasked"))


@query("prompt_prefix", "SELECT doc_id, CAST(length('classify: ' || text) AS BIGINT) AS n_chars, md5('classify: ' || text) AS text_md5 FROM documents")
def prompt_prefix(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").select(
        "doc_id", C.prompt_prefix(F.col("text")).alias("x"))
    return t.select("doc_id", F.length("x").cast("bigint").alias("n_chars"), F.md5("x").alias("text_md5"))


@query("normalise_text", """SELECT conv_id, turn, lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g')) AS role,
  md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS text_md5 FROM conversations""")
def normalise_text(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", C.normalise_text(F.col("role")).alias("role"),
                    F.md5(C.normalise_text(F.col("text"))).alias("text_md5"))


@query("encode_udf", f"""WITH {BASE_SQL}, tk AS (SELECT doc_id, {TOK_SQL} AS ids FROM documents)
  SELECT b.doc_id, CAST(len(tk.ids) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(range(1, 129), lambda i: CAST(i <= least(len(tk.ids), 128) AS INTEGER))) AS BIGINT) AS mask_sum,
  array_to_string({PAD_SQL.replace('ids', 'tk.ids')}, ',') AS input_ids, {_vec_sql('ya', 'yb', 'yc')} AS y FROM b JOIN tk ON b.doc_id = tk.doc_id""")
def encode_udf(spark, d):
    """text + label blocks -> ids, mask, multi-hot, as native expressions."""
    dl, _, _ = multi_hot_frame(spark, d)
    # reduce every whole text to its fixed-size features first (narrow), so
    # the join with the labels shuffles 128 ids per document, not all of them
    t = table(spark, d, "documents").select("doc_id", C.tokens(F.col("text")).alias("toks"))
    ids = F.transform(F.slice("toks", 1, C.MAX_TOKENS), lambda w: C.token_id(w, VOCAB))      # only the kept ones are hashed
    feats = t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                     F.aggregate(C.attention_mask(F.col("toks")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                     F.array_join(C.pad_truncate(ids), ",").alias("input_ids"))
    j = dl.select("doc_id", F.array_join("y", ",").alias("y")).join(feats, "doc_id")
    return j.select("doc_id", "n_tokens", "mask_sum", "input_ids", "y")
