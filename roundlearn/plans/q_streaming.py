"""Streaming form of the rounds (STR1): the ``events`` table as a stream,
one round per micro-batch with new classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundlearn.operators import rounds as RD
from roundlearn.operators import sampling as S
from roundlearn.operators.heads import collect_heads
from roundlearn.plans.evaluate import prepare
from roundlearn.plans.oracle_evaluate import fused_ctes
from roundlearn.plans.registry import query
from roundlearn.session import scratch_path
from roundlearn.sources.tables import table, table_stream
from roundlearn.streaming.evaluate_stream import confusion_stream
from roundlearn.streaming.heads_stream import add_scores, add_statistics, fused, heads_of, run_batches
from roundlearn.streaming.rounds_stream import run_rounds_stream


@query("rounds_stream", """SELECT 0 AS round, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS pos, event_type AS class
  FROM (SELECT DISTINCT event_type FROM events)""")
def rounds_stream(spark, d):
    return run_rounds_stream(spark, table_stream(spark, d, "events"), "event_type",
                             scratch_path(spark, "registry"), scratch_path(spark, "stream-ckpt"))


@query("evaluate_stream", f"""WITH {fused_ctes(RD.EMBEDDING_ROUNDS, 'none')}
  pr0 AS (SELECT key, y, class AS pred FROM
    (SELECT key, y, class, row_number() OVER (PARTITION BY key ORDER BY logit DESC, class_order) AS rn FROM zz) WHERE rn = 1)
  SELECT y, pred, count(*) AS n FROM pr0 GROUP BY y, pred""")
def evaluate_stream(spark, d):
    """Heads fitted in batch on the training rows; the embeddings file then
    read as a stream, test rows of registered classes scored, confusion
    counts kept in streaming state."""
    static = table(spark, d, "embeddings")
    data = prepare(static)
    bounds = S.split_bounds(data, "key", test=0.4)
    train = S.with_order_key(data, "key").where(S.split_label("key", bounds) == "train")
    heads = collect_heads(RD.round_heads(train, RD.registry_frame(spark, RD.EMBEDDING_ROUNDS), "y", "embedding"))
    stream = table_stream(spark, d, "embeddings", max_files=64)
    stream = stream.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("y"), "embedding")
    known = [c for _, _, c, _ in RD.registry_rows(RD.EMBEDDING_ROUNDS)]
    return confusion_stream(spark, stream, "key", "y", "embedding", heads, known, bounds,
                            scratch_path(spark, "stream-confusion"), scratch_path(spark, "stream-eval-ckpt"))


@query("rounds_stream_heads", """SELECT 0 AS round, event_type AS class, count(*) AS n_train,
  round(-0.5 * (avg(value / 100.0) * avg(value / 100.0)
        + avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0) * avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0)), 6) AS bias
  FROM events GROUP BY event_type""")
def rounds_stream_heads(spark, d):
    """The round stream also fits each round's heads on that micro-batch's
    rows of the new classes (features value/100, props.k/100)."""
    stream = table_stream(spark, d, "events").select("event_type", F.array(
        F.col("value") / 100.0, F.get_json_object("props", "$.k").cast("double") / 100.0).alias("vec"))
    heads_path = scratch_path(spark, "stream-heads")
    run_rounds_stream(spark, stream, "event_type", scratch_path(spark, "registry"),
                      scratch_path(spark, "stream-ckpt"), vec_col="vec", heads_path=heads_path)
    h = spark.read.parquet(heads_path)
    return h.select(F.col("round").cast("int"), "class", F.col("n_train").cast("bigint"), F.round("bias", 6).alias("bias"))


# classes whose rows come first in file 0, 1, 2 and 3 of the stream below
STREAM_FILES = [["0", "1", "2"], ["3", "4"], [], ["5", "6", "7", "8", "9"]]
_FIRST_FILE = "CASE " + " ".join(f"WHEN label IN ({', '.join(cs)}) THEN {i}" for i, cs in enumerate(STREAM_FILES) if cs) + " END"


def _file_sql(last: int) -> str:
    """The file of a row: its class's first one, and some rows come late."""
    return f"least({last}, {_FIRST_FILE} + vec_id % 3)"


def _staged(spark, d) -> str:
    """The embeddings as four files that arrive one after the other: each
    class from its first file on, a third of its rows one file later and a
    third two files later (none after the last); file 2 brings no new class."""
    path = scratch_path(spark, "staged")
    e = table(spark, d, "embeddings").withColumn("file", F.expr(_file_sql(len(STREAM_FILES) - 1)))
    for i in range(len(STREAM_FILES)):          # one job a file: later files are younger
        e.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(path)
    return path


def _staged_stream(spark, path, d):
    schema = table(spark, d, "embeddings").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _staged_heads_sql(policy: str) -> str:
    last = len(STREAM_FILES) - 1
    rows = f"(SELECT CAST(label AS VARCHAR) AS class, embedding, {_file_sql(last)} AS file FROM embeddings)"
    own = "" if policy == "merge" else "WHERE r.file = f.first"
    return f"""SELECT '{policy}' AS policy, g.round, g.class, g.n_train, round(b.bias, 6) AS bias FROM
  (SELECT CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS round, class, n_train FROM
    (SELECT f.class, f.first, count(*) AS n_train FROM {rows} r JOIN f ON r.class = f.class {own} GROUP BY f.class, f.first)) g
  JOIN (SELECT class, -0.5 * sum(m * m) AS bias FROM (SELECT class, i, avg(v) AS m FROM
    (SELECT r.class, CAST(unnest(r.embedding) AS DOUBLE) AS v, generate_subscripts(r.embedding, 1) AS i FROM {rows} r JOIN f ON r.class = f.class {own})
    GROUP BY class, i) GROUP BY class) b ON g.class = b.class"""


@query("rounds_stream_merged", f"""WITH f AS (SELECT class, min(file) AS first FROM
    (SELECT CAST(label AS VARCHAR) AS class, {_file_sql(len(STREAM_FILES) - 1)} AS file FROM embeddings) GROUP BY class)
  {_staged_heads_sql("merge")} UNION ALL {_staged_heads_sql("frozen")}""")
def rounds_stream_merged(spark, d):
    """STR1/SNK1 over several micro-batches and rounds: mergeable head
    statistics in a state table; heads by both policies for late rows."""
    state = scratch_path(spark, "head-state")
    stream = _staged_stream(spark, _staged(spark, d), d)
    run_batches(stream, lambda df, i: add_statistics(df, i, state, "label", "embedding"), scratch_path(spark, "head-ckpt"))
    out = [heads_of(spark, state, p).select(F.lit(p).alias("policy"), "round", "class", F.col("n_train").cast("bigint"),
                                            F.round("bias", 6).alias("bias")) for p in ("merge", "frozen")]
    return out[0].unionByName(out[1])


@query("evaluate_stream_zscore", f"""WITH {fused_ctes(RD.EMBEDDING_ROUNDS, 'global')}
  x AS (SELECT 1) SELECT y, pred, count(*) AS n FROM pr GROUP BY y, pred""")
def evaluate_stream_zscore(spark, d):
    """ML7 as a stream with z-scores: the test rows arrive in several
    micro-batches; kept scores and merged class moments give WIN6's z-scores
    and predictions once all rows are in."""
    data = prepare(table(spark, d, "embeddings"))
    bounds = S.split_bounds(data, "key", test=0.4)
    train = S.with_order_key(data, "key").where(S.split_label("key", bounds) == "train")
    reg = RD.registry_rows(RD.EMBEDDING_ROUNDS)
    heads = collect_heads(RD.round_heads(train, RD.registry_frame(spark, RD.EMBEDDING_ROUNDS), "y", "embedding"))
    known, path = [c for _, _, c, _ in reg], scratch_path(spark, "stream-scores")

    def each(df, i):
        rows = S.with_order_key(prepare(df), "key")
        rows = rows.where((S.split_label("key", bounds) == "test") & F.col("y").isin(known))
        add_scores(rows, i, path, heads, "y", "embedding", ["key"])
    run_batches(_staged_stream(spark, _staged(spark, d), d), each, scratch_path(spark, "stream-zscore-ckpt"))
    return fused(spark, path, [str(h["class"]) for h in heads]).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
