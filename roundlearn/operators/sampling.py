"""Seeded order, exact splits, batches and stratified caps.

The order of a row is ``(md5('<seed>:' || key), key)``: the same in every
engine, independent of partitioning, and uniform, so hash buckets (the
first ``hex`` digits of the md5) are never skewed. ``key`` must identify a
row (``event_id``, ``vec_id``, ``doc_id``); with duplicate keys positions
among the copies are arbitrary and split sizes can overshoot.

Nothing here uses a window without ``partitionBy`` over data rows: global
positions come from per-bucket counts (at most ``16**hex`` rows, a proven
bound, hence broadcast) plus a ``row_number`` inside each bucket.
Splits and caps do not even need that: only the bucket that straddles a
threshold is ranked; a split then compares each row with constant
boundaries, a cap filters rows by a size-checked broadcast lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundlearn.session import bounded_broadcast, checked_broadcast, materialize

DEFAULT_SEED = 42
RANK_HEX = 5          # 1 048 576 buckets: ~1e6 rows per bucket at 1e12 rows


ORDER = "md5"         # md5: reproducible in any SQL engine; xxhash64: cheaper per row


def hash_of(key: str | Column, seed: int | str = DEFAULT_SEED, order: str | None = None) -> Column:
    """Order key of a row. ``md5`` (default) is ``md5('<seed>:' || key)``, the
    same in every engine; ``xxhash64`` is Spark's built-in 64-bit hash of the
    same text, several times cheaper per row (for very large inputs where
    cross-engine reproduction of the permutation is not needed)."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), k.cast("string"))
    if (order or ORDER) == "xxhash64":
        return F.xxhash64(text)
    return F.md5(text)


def hash_sql(key: str, seed: int | str = DEFAULT_SEED) -> str:
    """The same order key in SQL (DuckDB and Spark)."""
    return f"md5(concat('{seed}:', cast({key} as varchar)))"


def _with_hash(df: DataFrame, key: str, seed, hex_digits: int, order: str | None = None) -> DataFrame:
    """Adds ``_h`` (order key) and ``_bk`` (bucket, monotone in ``_h``): the
    first hex digits of the md5 text, or the top 4*hex bits of the signed
    64-bit hash (an arithmetic shift keeps the order)."""
    h = hash_of(key, seed, order)
    if (order or ORDER) == "xxhash64":
        return df.withColumns({"_h": h, "_bk": F.shiftright(h, 64 - 4 * hex_digits)})
    return df.withColumns({"_h": h, "_bk": F.substring(h, 1, hex_digits)})


def _bucket_offsets(d: DataFrame, hex_digits: int, part_cols: Sequence[str] = ()) -> DataFrame:
    """(part..., _bk, _n, _off, _total): rows per bucket and rows in earlier
    buckets. At most n_parts * 16**hex rows."""
    counts = d.groupBy(*part_cols, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part_cols).orderBy("_bk")
    return counts.withColumns({
        "_off": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy(*part_cols))})


def hash_rank(df: DataFrame, key: str, seed=DEFAULT_SEED, rank_col: str = "rank",
              hex_digits: int = RANK_HEX, total_col: str | None = None, order: str | None = None,
              keys: DataFrame | None = None) -> DataFrame:
    """Exact 1-based position of every row in the seeded order (SRT3).

    Equal to ``row_number() over (order by md5(seed:key), key)`` but spread
    over up to 16**hex window partitions instead of one task. ``keys``: a frame
    with the same keys that is cheaper to read, from which the rows per bucket
    are counted (``df`` is read once then, which a Python step in it needs, as
    such a step cannot be pruned)."""
    d = _with_hash(df, key, seed, hex_digits, order)
    off = _bucket_offsets(d if keys is None else _with_hash(keys.select(key), key, seed, hex_digits, order), hex_digits)
    cols = ["_bk", "_off"] + (["_total"] if total_col else [])
    d = d.join(bounded_broadcast(off.select(*cols), 16 ** hex_digits), "_bk")
    w = Window.partitionBy("_bk").orderBy("_h", key)
    extra = [F.col("_total").alias(total_col)] if total_col else []
    return d.select(*df.columns, *extra, (F.col("_off") + F.row_number().over(w)).cast("bigint").alias(rank_col))


def ordered_rank(df: DataFrame, order: Sequence[str], rank_col: str, part: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in the order of ``order`` (within each
    value of ``part``), with no window over a whole part: rows go to range
    partitions once, each partition's count per part gives its offset, and
    ``row_number`` runs inside a partition. Ties take any order."""
    pid, off = "_pid", "_off"
    ranged = materialize(df.repartitionByRange(*part, *order).withColumn(pid, F.spark_partition_id()))
    counts = ranged.groupBy(*part, pid).agg(F.count(F.lit(1)).alias("_n"))       # at most parts x partitions rows
    before = Window.partitionBy(*part).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(off, F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*part, pid, off)
    inside = Window.partitionBy(*part, pid).orderBy(*order)
    return (ranged.join(checked_broadcast(offsets), [*part, pid])
            .select(*df.columns, (F.col(off) + F.row_number().over(inside)).alias(rank_col)))


def batch_id(rank: Column, batch_size: int = 32) -> Column:
    """``floor((rank-1)/B)`` (WIN3)."""
    return ((rank - F.lit(1)) / F.lit(batch_size)).cast("bigint").cast("int")


def with_batches(df: DataFrame, key: str, seed=DEFAULT_SEED, batch_size: int = 32,
                 batch_col: str = "batch_id", hex_digits: int = RANK_HEX, order: str | None = None,
                 keys: DataFrame | None = None) -> DataFrame:
    """Ordered (seeded) loader batches as a column (SRC5)."""
    r = hash_rank(df, key, seed, "row_pos", hex_digits, order=order, keys=keys)
    return r.withColumn(batch_col, batch_id(F.col("row_pos"), batch_size))


def batch_count(n: Column, batch_size: int = 32) -> Column:
    return ((n + F.lit(batch_size - 1)) / F.lit(batch_size)).cast("bigint")


# ------------------------------------------------------------- splits

def ceil_frac(n: Column, frac: float | Fraction) -> Column:
    """``ceil(n * frac)`` in exact integer arithmetic."""
    q = Fraction(str(frac)) if not isinstance(frac, Fraction) else frac
    return ((n * F.lit(q.numerator) + F.lit(q.denominator - 1)) / F.lit(q.denominator)).cast("bigint")


def split_sizes_sql(n: str, test: float, val: float | None = None) -> tuple[str, str]:
    """SQL for the test and validation sizes (same integer arithmetic)."""
    qt = Fraction(str(test))
    t = f"(({n}) * {qt.numerator} + {qt.denominator - 1}) // {qt.denominator}"
    if val is None:
        return t, "0"
    qv = Fraction(str(val))
    v = f"((({n}) - {t}) * {qv.numerator} + {qv.denominator - 1}) // {qv.denominator}"
    return t, v


def _boundaries(d: DataFrame, key: str, off_rows: list, positions: list) -> dict:
    """(hash, key) of the rows at the given global positions (1-based), by
    ranking only the buckets that hold them (one job, <= len(positions)
    buckets, each ~n/16**hex rows)."""
    want = {}
    for p in positions:
        r = next(r for r in off_rows if r["_off"] < p <= r["_off"] + r["_n"])
        want.setdefault(r["_bk"], []).append((p, p - r["_off"]))
    if not want:
        return {}
    w = Window.partitionBy("_bk").orderBy("_h", key)
    cond = F.lit(False)
    for bk, ks in want.items():
        cond = cond | ((F.col("_bk") == bk) & F.col("_rn").isin([k for _, k in ks]))
    got = (d.where(F.col("_bk").isin(list(want))).withColumn("_rn", F.row_number().over(w))
            .where(cond).select("_bk", "_rn", "_h", key).collect())
    out = {}
    for g in got:
        for p, k in want[g["_bk"]]:
            if k == g["_rn"]:
                out[p] = (g["_h"], g[key])
    return out


def _at_or_before(key: str, bound) -> Column:
    if bound is None:
        return F.lit(False)
    h, k = bound
    return (F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(key) <= F.lit(k)))


def split_bounds(df: DataFrame, key: str, test: float = 0.4, val: float | None = None,
                 seed=DEFAULT_SEED, hex_digits: int = RANK_HEX, order: str | None = None) -> tuple:
    """The boundary ``(hash, key)`` pairs of an exact split (see ``split``):
    two constants that label any row, of a table or of a stream."""
    d = _with_hash(df, key, seed, hex_digits, order)
    counts = d.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))              # <= 16**hex rows
    w = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)      # over bucket rows only
    off = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
                 .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    t_col = ceil_frac(F.col("_total"), test)
    v_col = t_col + (ceil_frac(F.col("_total") - t_col, val) if val is not None else F.lit(0))
    # one job: the total and the (at most two) buckets holding a boundary
    hit = lambda p: (F.col("_off") < p) & (F.col("_off") + F.col("_n") >= p)      # noqa: E731
    rows = off.where(hit(t_col) | hit(v_col)).select("_bk", "_n", "_off", "_total").collect()
    total = rows[0]["_total"] if rows else 0
    qt = Fraction(str(test))
    t_sz = -(-total * qt.numerator // qt.denominator)
    v_sz = 0
    if val is not None:
        qv = Fraction(str(val))
        v_sz = -(-(total - t_sz) * qv.numerator // qv.denominator)
    wanted = sorted({p for p in (t_sz, t_sz + v_sz) if 0 < p <= total})
    bounds = _boundaries(d, key, rows, wanted)
    b_t = bounds.get(t_sz)
    b_v = bounds.get(t_sz + v_sz) if val is not None else b_t
    return b_t, b_v


def split_label(key: str, bounds: tuple) -> Column:
    """``test`` / ``val`` / ``train`` of a row that carries ``_h``."""
    b_t, b_v = bounds
    return (F.when(_at_or_before(key, b_t), F.lit("test"))
             .when(_at_or_before(key, b_v), F.lit("val")).otherwise(F.lit("train")))


def split(df: DataFrame, key: str, test: float = 0.4, val: float | None = None,
          seed=DEFAULT_SEED, split_col: str = "split", hex_digits: int = RANK_HEX,
          order: str | None = None) -> DataFrame:
    """Exact seeded split (SRT4/SRT5).

    ``test`` = first ceil(n*test) rows of the seeded order, ``val`` = next
    ceil((n-test)*val) rows, ``train`` = the rest; sizes match
    ``train_test_split`` exactly. Bucket counts (a partial aggregate, at
    most 16**hex rows) locate the bucket holding each boundary position;
    ranking that one bucket gives the boundary ``(hash, key)``. The split
    itself is then a narrow projection against two constants: no join and
    no shuffle of the rows, and reusing it costs one scan."""
    bounds = split_bounds(df, key, test, val, seed, hex_digits, order)
    d = _with_hash(df, key, seed, hex_digits, order)
    return d.withColumn(split_col, split_label(key, bounds)).drop("_h", "_bk")


def with_order_key(df: DataFrame, key: str, seed=DEFAULT_SEED, order: str | None = None) -> DataFrame:
    """Adds the order key ``_h`` (for ``split_label`` on a stream)."""
    return df.withColumn("_h", hash_of(key, seed, order))


def _straddles(positions: list) -> Column:
    c = F.lit(False)
    for p in positions:
        c = c | ((F.col("_off") < F.lit(p)) & (F.col("_off") + F.col("_n") >= F.lit(p)))
    return c


# ------------------------------------------------------- stratified cap

def _cap_of(class_col: str, n: int | dict) -> Column:
    if isinstance(n, int):
        return F.lit(n)
    caps = F.create_map(*[x for c, m in n.items() for x in (F.lit(str(c)), F.lit(int(m)))])
    return F.coalesce(caps[F.col(class_col).cast("string")], F.lit(0))


def stratified_cap(df: DataFrame, class_col: str, key: str, n: int | dict,
                   keep_all: Sequence[str] = (), seed=DEFAULT_SEED,
                   hex_digits: int = RANK_HEX, max_broadcast_rows: int = 2_000_000,
                   order: str | None = None) -> DataFrame:
    """At most ``n`` rows per class (the first ``n`` of the seeded order),
    all rows for the classes in ``keep_all`` (SRT2). ``n`` may give each class
    its own cap; a class it does not name has none of its rows kept.

    Exact and skew-proof: per class, bucket counts decide which buckets are
    kept whole; only the single boundary bucket of each class is ranked.
    The lookup table has at most ``n`` buckets per class (each kept bucket
    holds a row) and is size-checked before it is broadcast. A class that
    holds a third of all rows costs one map-side filter, never one task.
    Rows without a class are a class of their own; rows without a key come
    first in the order of theirs."""
    d = _with_hash(df, key, seed, hex_digits, order)
    keep = F.coalesce(F.col(class_col).isin(list(keep_all)), F.lit(False)) if keep_all else F.lit(False)
    cap = _cap_of(class_col, n)
    # keep-all classes bypass the lookup, which therefore holds at most n
    # buckets per capped class (every kept bucket holds a row)
    off = _bucket_offsets(d.where(~keep), hex_digits, [class_col])
    look = (off.filter(F.col("_off") < cap)
               .withColumn("_whole", F.col("_off") + F.col("_n") <= cap)
               .select(F.col(class_col).alias("_c"), F.col("_bk").alias("_b"), "_off", "_whole"))
    look = checked_broadcast(look, max_broadcast_rows)
    same = F.col(class_col).eqNullSafe(F.col("_c")) & F.col("_bk").eqNullSafe(F.col("_b"))
    d = d.join(look, same, "left").drop("_c", "_b").where(keep | F.col("_whole").isNotNull())
    whole = d.where(keep | F.col("_whole"))
    w = Window.partitionBy(class_col, "_bk").orderBy("_h", key)
    edge = (d.where(~keep & ~F.col("_whole"))
             .withColumn("_pos", F.col("_off") + F.row_number().over(w))
             .filter(F.col("_pos") <= cap).drop("_pos"))
    return whole.unionByName(edge).drop("_h", "_bk", "_off", "_whole")


def stratified_cap_report(df: DataFrame, class_col: str, n: int, keep_all: Sequence[str] = ()) -> DataFrame:
    """Per class: rows available, rows kept by ``stratified_cap`` and whether
    the class was smaller than the cap (kept whole instead of failing)."""
    keep = F.coalesce(F.col(class_col).isin(list(keep_all)), F.lit(False)) if keep_all else F.lit(False)
    g = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("rows"), F.max(keep.cast("int")).alias("_k"))
    kept = F.when(F.col("_k") == 1, F.col("rows")).otherwise(F.least(F.col("rows"), F.lit(n)))
    return g.select(class_col, "rows", kept.cast("bigint").alias("kept"),
                    ((F.col("_k") == 0) & (F.col("rows") < F.lit(n))).alias("short"))


def seeded_shuffle(df: DataFrame, key: str, seed=DEFAULT_SEED, rank_col: str = "shuffle_pos",
                   hex_digits: int = RANK_HEX, order: str | None = None) -> DataFrame:
    """Full seeded permutation as a position column (SRT3). ``seed`` may be
    ``'run:epoch'`` for a new order per epoch (SRT7)."""
    return hash_rank(df, key, seed, rank_col, hex_digits, order=order)
