"""Label dictionary ``(label_col STRING, label STRING, id INT)``.

Fitted like a label encoder: distinct values of each label column sorted by
their *native* type (numbers numerically, text by code point), id = 0-based
position. Unlike ``StringIndexer`` (frequency or text order) ``1, 2, 10``
stay in numeric order. The dictionary is one row per distinct label, so it
is tiny next to the data; it is materialized once and broadcast after a
size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundlearn.functions.columns import col, multi_hot
from roundlearn.operators.sampling import ordered_rank
from roundlearn.session import checked_broadcast, local_frame, materialize, small_rows

DICT_COLS = ("label_col", "label", "id")


class UnseenLabelError(ValueError):
    pass


def fit_dictionary(df: DataFrame, label_cols: Sequence[str], keep: bool = True) -> DataFrame:
    """WIN1 ``label_encode_fit``: one small table for all label columns, from
    one pass over the data (distinct ``(column, label)`` pairs, a partial
    aggregate), ordered per column by the native type: integers by value,
    fractions by value, text by code point."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def key(c):
        t = types[c]
        integral = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        fractional = isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType))
        return F.struct(F.lit(c).alias("label_col"), col(c).cast("string").alias("label"),
                        (col(c).cast("long") if integral else F.lit(None).cast("long")).alias("_i"),
                        (col(c).cast("double") if fractional else F.lit(None).cast("double")).alias("_d"))

    d = (df.select(F.explode(F.array(*[key(c) for c in label_cols])).alias("p")).select("p.*")
           .where(F.col("label").isNotNull()).distinct())
    rows, d = small_rows(d)
    if rows is not None:            # a few thousand labels at most, counted: ranked where they are
        def native(r):              # as Spark orders: no value first, NaN last, text by code point
            v = r["_d"]
            return (r["label_col"], r["_i"] is not None, r["_i"] or 0, v is not None, v is not None and v != v, v or 0.0, r["label"])
        out, before, n = [], None, 0
        for r in sorted(rows, key=native):
            n = n + 1 if r["label_col"] == before else 0
            before = r["label_col"]
            out.append((r["label_col"], r["label"], n))
        return local_frame(df.sparkSession, out, "label_col string, label string, id int")
    ranked = ordered_rank(d, ["_i", "_d", "label"], "_r", ["label_col"])
    out = ranked.select("label_col", "label", (F.col("_r") - 1).cast("int").alias("id"))
    return materialize(out) if keep else out


def dictionary_for(dictionary: DataFrame, label_col: str) -> DataFrame:
    return dictionary.where(F.col("label_col") == label_col).select("label", "id")


def unseen_labels(df: DataFrame, dictionary: DataFrame, label_col: str) -> DataFrame:
    """JN7: labels of ``df`` missing from the dictionary, with row counts."""
    d = dictionary_for(dictionary, label_col)
    return (df.select(col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull())
              .join(checked_broadcast(d), "label", "left_anti")
              .groupBy("label").agg(F.count(F.lit(1)).alias("rows")))


def encode(df: DataFrame, dictionary: DataFrame, label_col: str, out_col: str | None = None,
           unseen: str = "error") -> DataFrame:
    """JN1 ``label_encode_apply``. ``unseen``: ``error`` (raise, like the
    reference), ``skip`` (drop those rows) or ``keep`` (id -1). A row with a
    null label stays, with a null id, under every policy."""
    out_col = out_col or f"{label_col}_id"
    d = checked_broadcast(dictionary_for(dictionary, label_col)
                          .withColumnRenamed("label", "_lbl").withColumnRenamed("id", out_col))
    if unseen == "error":
        bad = unseen_labels(df, dictionary, label_col).limit(5).collect()
        if bad:
            raise UnseenLabelError(f"labels not in dictionary for {label_col}: {[r['label'] for r in bad]}")
    missing = col(label_col).isNull()
    out = df.join(d, col(label_col).cast("string") == F.col("_lbl"), "left").drop("_lbl")
    if unseen == "keep":
        return out.withColumn(out_col, F.when(~missing, F.coalesce(F.col(out_col), F.lit(-1))))
    return out.where(missing | F.col(out_col).isNotNull()) if unseen == "skip" else out


def check_unseen(df: DataFrame, dictionary: DataFrame, label_cols: Sequence[str]) -> None:
    """Raise when any label column holds a value the dictionary lacks: one
    job for all columns (distinct (column, label) pairs, anti join on the
    broadcast dictionary)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label_col"), col(c).cast("string").alias("label"))
                                for c in label_cols]))
    vals = df.select(pairs.alias("p")).select("p.*").where(F.col("label").isNotNull()).distinct()
    bad = vals.join(checked_broadcast(dictionary.select("label_col", "label")), ["label_col", "label"], "left_anti").limit(5).collect()
    if bad:
        raise UnseenLabelError(f"labels not in dictionary: {[(r['label_col'], r['label']) for r in bad]}")


def encode_all(df: DataFrame, dictionary: DataFrame, label_cols: Sequence[str], suffix: str = "_id",
               unseen: str = "error") -> DataFrame:
    """JN1 for several label columns with a single unseen-label check."""
    if unseen == "error":
        check_unseen(df, dictionary, label_cols)
        unseen = "skip"         # checked: nothing is missing
    for c in label_cols:
        df = encode(df, dictionary, c, f"{c}{suffix}", unseen=unseen)
    return df


def decode(df: DataFrame, dictionary: DataFrame, label_col: str, id_col: str, out_col: str) -> DataFrame:
    """JN2 ``label_decode``: id -> label text; a row whose id is null, -1 or
    unknown stays, with a null label."""
    d = checked_broadcast(dictionary_for(dictionary, label_col)
                          .withColumnRenamed("id", "_id").withColumnRenamed("label", out_col))
    return df.join(d, F.col(id_col) == F.col("_id"), "left").drop("_id")


def class_totals(dictionary: DataFrame) -> DataFrame:
    """AGG22: classes per label column (the grand total is their sum)."""
    return dictionary.groupBy("label_col").agg(F.count(F.lit(1)).alias("n_classes"))


def block_offsets(dictionary: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """WIN2: ``(block_pos, label_col, n_classes, offset)`` with blocks laid end
    to end in the given order."""
    order = F.create_map(*[x for i, b in enumerate(blocks) for x in (F.lit(b), F.lit(i))])
    t = (class_totals(dictionary).where(F.col("label_col").isin(list(blocks)))
         .withColumn("block_pos", order[F.col("label_col")].cast("int")))
    w = Window.orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)   # one row per block
    return t.withColumn("offset", F.coalesce(F.sum("n_classes").over(w), F.lit(0)).cast("bigint"))


def block_layout(dictionary: DataFrame, blocks: Sequence[str]) -> list[tuple[str, int, int]]:
    """(block, offset, width) on the driver: one tiny row per label column."""
    rows = block_offsets(dictionary, blocks).orderBy("block_pos").collect()
    return [(r["label_col"], int(r["offset"]), int(r["n_classes"])) for r in rows]


def multi_hot_labels(df: DataFrame, layout: Sequence[tuple[str, int, int]],
                     id_cols: Sequence[str], out_col: str = "multi_hot") -> DataFrame:
    """SC6: one vector with a 1 at ``offset + id`` of every block."""
    width = sum(w for _, _, w in layout)
    pos = F.array(*[(F.col(i) + F.lit(off)).cast("int") for (_, off, _), i in zip(layout, id_cols)])
    return df.withColumn(out_col, multi_hot(pos, width))


def label_positions(layout: Sequence[tuple[str, int, int]], id_cols: Sequence[str]) -> Column:
    """SC6 as a list: the positions ``offset + id`` of a row's labels in all
    blocks, each once, without the missing ones. As wide as the labels that
    are set, however many there are."""
    pos = [F.when(F.col(i) >= 0, (F.col(i) + F.lit(off)).cast("int")) for (_, off, _), i in zip(layout, id_cols, strict=True)]
    return F.array_distinct(F.filter(F.array(*pos), lambda x: x.isNotNull()))
