"""Derived inputs shared by the queries (the role each driver table plays)
and the matching SQL fragments.

* ``events`` is the labelled traffic table: key ``event_id``, class
  ``event_type`` (5 values), binary label ``event_type = 'error'``,
  features ``user_id, value, props.k``.
* Pseudo-predictions are a fixed formula on ``value`` (both engines), with
  ``'other'`` outside the true universe; logits are linear in ``value``.
* ``documents`` join ``labels`` is the multi-label table with three blocks
  ``lang`` (4), ``quality`` (2), ``toxic`` (2).
* ``embeddings`` is the frozen encoder output, rounds {0,1,2},{3,4},{5,6},{7,8}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.sources.tables import table

R = 6  # digits kept for every double


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), R)


# --------------------------------------------------------------- events

def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props",
                    F.get_json_object("props", "$.k").cast("int").alias("props_k"))


EVENTS_SQL = ("(SELECT event_id, ts, user_id, event_type, value, props, "
              "CAST(json_extract_string(props, '$.k') AS INTEGER) AS props_k FROM events)")


def pseudo_pred(value: Column, y: Column) -> Column:
    return (F.when(value > 450, F.lit("other")).when(value > 50, F.lit("purchase"))
             .when(value > 20, F.lit("view")).otherwise(y))


PRED_SQL = ("CASE WHEN value > 450 THEN 'other' WHEN value > 50 THEN 'purchase' "
            "WHEN value > 20 THEN 'view' ELSE event_type END")


def logit(value: Column) -> Column:
    """Binary logit linear in value (0 at value 100: p exactly 0.5)."""
    return value / F.lit(100.0) - F.lit(1.0)


LOGIT_SQL = "(value / 100.0 - 1.0)"
EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


def class_logits(value: Column) -> Column:
    """Five class logits, linear in value: ``l_k = (k+1) * v - k * k / 4``."""
    v = value / F.lit(100.0)
    return F.array(*[F.lit(float(k + 1)) * v - F.lit(k * k / 4.0) for k in range(5)])


def class_logits_sql(k: int) -> str:
    return f"({float(k + 1)} * (value / 100.0) - {k * k / 4.0})"


def y_index(y: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), y) - 1).cast("int")


Y_INDEX_SQL = "(list_position(['click','error','purchase','signup','view'], event_type) - 1)"


# ----------------------------------------------------------- documents

BLOCKS = ["lang", "quality", "toxic"]


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label row: ``doc_id, lang, quality, toxic, n_chars``
    plus pseudo-predicted blocks ``lang_p, quality_p, toxic_p``."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"),
                                           F.col("toxic").cast("string").alias("toxic"))
    j = docs.join(lab, "doc_id")
    return (j.withColumn("lang_p", F.when(F.col("n_chars") > 500, F.col("lang")).otherwise(F.lit("en")))
             .withColumn("quality_p", (F.col("n_chars") > 1000).cast("int").cast("string"))
             .withColumn("toxic_p", (F.col("n_chars") > 5000).cast("int").cast("string")))


DOC_LABELS_SQL = """(SELECT d.doc_id, d.lang, d.n_chars, CAST(l.quality AS VARCHAR) AS quality,
  CAST(l.toxic AS VARCHAR) AS toxic,
  CASE WHEN d.n_chars > 500 THEN d.lang ELSE 'en' END AS lang_p,
  CAST(CAST(d.n_chars > 1000 AS INTEGER) AS VARCHAR) AS quality_p,
  CAST(CAST(d.n_chars > 5000 AS INTEGER) AS VARCHAR) AS toxic_p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# dictionary of the three blocks, fitted on the labelled documents, with
# block offsets (lang 4, quality 2, toxic 2 laid end to end)
DOC_DICT_SQL = f"""(SELECT label_col, label, id, off + id AS pos FROM (
  SELECT 'lang' AS label_col, lang AS label, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS id, 0 AS off
    FROM (SELECT DISTINCT lang FROM {DOC_LABELS_SQL})
  UNION ALL
  SELECT 'quality', quality, CAST(row_number() OVER (ORDER BY CAST(quality AS INTEGER)) - 1 AS INTEGER),
    (SELECT count(DISTINCT lang) FROM {DOC_LABELS_SQL})
    FROM (SELECT DISTINCT quality FROM {DOC_LABELS_SQL})
  UNION ALL
  SELECT 'toxic', toxic, CAST(row_number() OVER (ORDER BY CAST(toxic AS INTEGER)) - 1 AS INTEGER),
    (SELECT count(DISTINCT lang) + count(DISTINCT quality) FROM {DOC_LABELS_SQL})
    FROM (SELECT DISTINCT toxic FROM {DOC_LABELS_SQL})))"""
