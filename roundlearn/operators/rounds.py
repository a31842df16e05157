"""Round-incremental class registry.

A round config is a table ``(round, pos, class)``. A class belongs to the
first round that names it (STR3); a round number is only allocated when the
round brings at least one new class (the reference burns a number on an
empty round). The registry ``(round, pos, class, class_order)`` is one row
per class; heads of a round are fitted on rows of that round's new classes
only, so earlier heads never change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundlearn.operators import gradient
from roundlearn.operators.heads import centroid_heads
from roundlearn.session import checked_broadcast, local_frame, materialize

# The standard experiment of the reference, 4 rounds of
# 3/2/2/2 classes (traffic class names) ...
STANDARD_ROUNDS = [
    (0, ["Normal", "DDoS_UDP", "Password"]),
    (1, ["XSS", "Backdoor"]),
    (2, ["SQL_injection", "Fingerprinting"]),
    (3, ["MITM", "Port_Scanning"]),
]
# ... and the same shape over the ``embeddings`` labels 0..9 (9 stays unseen).
EMBEDDING_ROUNDS = [(0, ["0", "1", "2"]), (1, ["3", "4"]), (2, ["5", "6"]), (3, ["7", "8"])]


def config_table(spark: SparkSession, rounds: Sequence[tuple[int, Sequence[str]]]) -> DataFrame:
    rows = [(int(r), i + 1, str(c)) for r, cs in rounds for i, c in enumerate(cs)]
    return local_frame(spark, rows, "round int, pos int, class string")


def config_sql(rounds: Sequence[tuple[int, Sequence[str]]]) -> str:
    vals = ", ".join(f"({int(r)}, {i + 1}, '{c}')" for r, cs in rounds for i, c in enumerate(cs))
    return f"(VALUES {vals}) AS cfg(round, pos, class)"


def rounds_assign(cfg: DataFrame) -> DataFrame:
    """STR3: ``(class, first_round)``."""
    return cfg.groupBy("class").agg(F.min("round").alias("first_round"))


def present_classes(df: DataFrame, class_col: str) -> DataFrame:
    """Distinct classes that occur in the data (one row per class)."""
    return df.select(F.col(class_col).cast("string").alias("class")).distinct()


def registry(cfg: DataFrame, known: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """STR2/FLT3/SET2: the class registry after applying the config in order.

    ``known`` (``class``) are classes registered before; they are never
    re-registered. ``present`` (``class``) restricts the config to classes
    that have rows. A class belongs to its first (round, pos); rounds
    without a new class get no number. The config, ``known`` and
    ``present`` are class-universe sized (never data rows): the class sets
    are broadcast and the windows run over config rows only."""
    c = cfg
    if present is not None:
        c = c.join(checked_broadcast(present.select("class")), "class", "left_semi")
    if known is not None:
        c = c.join(checked_broadcast(known.select("class")), "class", "left_anti")
    first = (c.withColumn("_k", F.row_number().over(Window.partitionBy("class").orderBy("round", "pos")))
              .where(F.col("_k") == 1).drop("_k"))
    first = first.withColumn("pos", F.row_number().over(Window.partitionBy("round").orderBy("pos")))
    out = (first.withColumn("_r", F.dense_rank().over(Window.orderBy("round")) - 1)
                .withColumn("class_order", F.row_number().over(Window.orderBy("round", "pos"))))
    return out.select(F.col("_r").cast("int").alias("round"), F.col("pos").cast("int"), "class",
                      F.col("class_order").cast("int"))


def registry_rows(rounds: Sequence[tuple[int, Sequence[str]]], present: set | None = None) -> list[tuple]:
    """The same registry computed from an in-memory round config (a driver
    parameter, one entry per class): ``(round, pos, class, class_order)``."""
    seen, out, rnd = set(), [], 0
    for _, classes in sorted(((r, cs) for r, cs in rounds), key=lambda x: x[0]):
        new = []
        for c in classes:
            c = str(c)
            if c in seen or c in new or (present is not None and c not in present):
                continue
            new.append(c)
        if not new:
            continue
        for i, c in enumerate(new):
            out.append((rnd, i + 1, c, len(seen) + i + 1))
        seen.update(new)
        rnd += 1
    return out


def registry_frame(spark: SparkSession, rounds: Sequence[tuple[int, Sequence[str]]]) -> DataFrame:
    return local_frame(spark, registry_rows(rounds), "round int, pos int, class string, class_order int")


def new_classes(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """FLT3: candidate classes not yet known, in their given order."""
    return candidates.join(known.select("class"), "class", "left_anti")


def known_rows(df: DataFrame, reg: DataFrame, class_col: str, n_classes: int | None = None) -> DataFrame:
    """FLT4: rows whose class is registered (semi join; the registry is
    broadcast behind a count of its rows)."""
    r = checked_broadcast(reg.select(F.col("class").alias("_c")))
    return df.join(r, F.col(class_col).cast("string") == F.col("_c"), "left_semi")


def round_heads(train: DataFrame, reg: DataFrame, class_col: str, vec_col: str) -> DataFrame:
    """ML1/ML2 for all rounds at once: a centroid per registered class over
    its own training rows; ``(round, pos, class, class_order, mu, bias, n_train)``."""
    rows = known_rows(train, reg, class_col)
    h = centroid_heads(rows.withColumn(class_col, F.col(class_col).cast("string")), class_col, vec_col)
    return reg.join(h, "class", "inner")


def trained_round_heads(train: DataFrame, reg_rows: Sequence[tuple], class_col: str, vec_col: str,
                        kinds: dict[int, str] | None = None, ridge: float = gradient.RIDGE) -> tuple[list[dict], gradient.Fit | None]:
    """ML2 trainable: for each round a softmax head over that round's new
    classes, fitted on its rows only, all rounds in one fit (a row belongs to
    the round that knows its class). ``kinds``: round -> "softmax" (default)
    or "centroid"; a round with one class has nothing to tell apart and gets a
    centroid. Returns the heads of all classes in class order, as
    ``collect_heads`` gives them, and how the fit went (objectives in the
    order of the trained rounds)."""
    kinds = kinds or {}
    by_round: dict[int, list[tuple]] = {}
    for r in reg_rows:
        by_round.setdefault(r[0], []).append(r)
    trained = [r for r, cs in sorted(by_round.items()) if kinds.get(r, "softmax") == "softmax" and len(cs) > 1]
    out: list[dict] = []
    fit = None
    if trained:
        place = {r: i for i, r in enumerate(trained)}
        spark = train.sparkSession
        known = local_frame(spark, [(c, place[r], pos - 1) for r in trained for _, pos, c, _ in by_round[r]], "_c string, _obj int, _pos int")
        rows = train.join(checked_broadcast(known), F.col(class_col).cast("string") == F.col("_c")).select(
            vec_col, *[F.when(F.col("_obj") == i, F.col("_pos")).alias(f"_y{i}") for i in range(len(trained))])
        rows = materialize(rows)              # read again in every pass
        fit = gradient.fit(rows, [gradient.Objective(f"_y{i}", len(by_round[r])) for i, r in enumerate(trained)], vec_col, ridge=ridge)
        for r, head in zip(trained, fit.heads, strict=True):
            out += [{"round": r, "class": c, "class_order": order, "mu": w[:-1].tolist(), "bias": float(w[-1]), "kind": "softmax"}
                    for (_, _, c, order), w in zip(by_round[r], head.weights, strict=True)]
    rest = [x for r, cs in by_round.items() if r not in trained for x in cs]
    if rest:
        reg = local_frame(train.sparkSession, rest, "round int, pos int, class string, class_order int")
        out += [{"round": h["round"], "class": h["class"], "class_order": h["class_order"], "mu": list(h["mu"]), "bias": float(h["bias"]),
                 "kind": "centroid"} for h in round_heads(train, reg, class_col, vec_col).collect()]      # one row a class
    return sorted(out, key=lambda h: h["class_order"]), fit


def model_summary(reg: DataFrame) -> DataFrame:
    """ML10: current round, number of classes, base classes, rounds and the
    class -> round map, as one row."""
    s = reg.agg(F.max("round").alias("current_round"), F.count(F.lit(1)).alias("total_classes"),
                F.countDistinct("round").alias("rounds"),
                F.sort_array(F.collect_list(F.struct("class_order", "class", "round"))).alias("_c"))
    return s.select(
        F.col("current_round").cast("int"), F.col("total_classes").cast("bigint"), F.col("rounds").cast("bigint"),
        F.array_join(F.transform(F.filter("_c", lambda x: x["round"] == 0), lambda x: x["class"]), ",").alias("base_classes"),
        F.array_join(F.transform("_c", lambda x: F.concat(x["class"], F.lit(":"), x["round"].cast("string"))), ",").alias("class_to_round"))
