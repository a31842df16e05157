"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows get a global number 0..N-1 from a fixed total order (hash bucket, then
id, size, checksum); a Feistel network over Z_a x Z_b with a*b >= N permutes
the numbers, and walking the cycle brings a value past N-1 back below N. The
permuted position gives the shard (``position mod n_shards``) and the slot
(``position div n_shards``), so shard sizes differ by one row at most, and a
row's place can be computed from its number alone and its number from its
place (``row_number_of``).

DataFrame functions only. Cases: a null text has no bytes (size 16, checksum
0); a null id is a value like any other; equal rows get different numbers (it
does not matter which of them gets which); an empty table gives no rows; only
the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundlearn.llm.common import written

BUCKETS = 16_384          # of the row order; the offsets table has at most so many rows
ROUNDS = 6
ROW_BYTES = 16            # counted for each row besides its text


class Permutation:
    """Feistel network over Z_a x Z_b (a, b about sqrt N) as columns."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.a = isqrt(max(n, 1) - 1) + 1
        self.b = -(-max(n, 1) // self.a)
        # a*b - n < a values lie past the end, so a walk of `a` steps always
        # ends; with a >= 64 a step misses with odds under 1/64
        self.steps = min(self.a, 64)

    def _key(self, j: int, x: Column, m: int) -> Column:
        return F.pmod(F.xxhash64(x.cast("long"), F.lit(self.seed).cast("long"), F.lit(j)), F.lit(m).cast("long"))

    def _once(self, x: Column, back: bool = False) -> Column:
        a, b = F.lit(self.a).cast("long"), F.lit(self.b).cast("long")
        low = F.pmod(x, a)
        high = F.call_function("div", x, a)
        order = range(self.rounds - 1, -1, -1) if back else range(self.rounds)
        sign = -1 if back else 1
        for j in order:
            if j % 2 == 0:
                low = F.pmod(low + sign * self._key(j, high, self.a), a)
            else:
                high = F.pmod(high + sign * self._key(j, low, self.b), b)
        return high * a + low

    def apply(self, x: Column, back: bool = False) -> Column:
        """The permuted value (``back``: the inverse), always below n."""
        n = F.lit(self.n).cast("long")
        first = self._once(x.cast("long"), back)
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), first,
                           lambda y, _: F.when(y < n, y).otherwise(self._once(y, back)))
        out = F.when(first < n, first).otherwise(walk)
        return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, keys: list[str], part_col: str = "part", out: str = "row_number") -> DataFrame:
    """Adds a gapless number from 0 in the order (hash bucket, keys). The
    number depends on the key values alone; ``part_col`` (any spread of the
    rows) splits runs of equal keys, so that no task gets a whole hot run."""
    b = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    per_key = b.groupBy("bucket", *keys, part_col).agg(F.count(F.lit(1)).alias("n"))
    in_bucket = Window.partitionBy("bucket").orderBy(*keys, part_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_key.withColumn("start", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)))
    sizes = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))          # at most BUCKETS rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    starts = starts.join(F.broadcast(offsets), "bucket").select(
        *[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], F.col(part_col).alias("k_part"),
        (F.col("offset") + F.col("start")).alias("first"))
    within = Window.partitionBy(*keys, part_col).orderBy(F.lit(1))
    rows = df.withColumn("nth", F.row_number().over(within))
    cond = F.col(part_col) == F.col("k_part")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"k_{i}"))
    return rows.join(starts, cond).select(*df.columns, (F.col("first") + F.col("nth") - 1).alias(out))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40,
          seed: int = 20) -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, position,
    shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"),
                     (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"),
                     F.spark_partition_id().alias("part"))
    base = written(base, "shard-rows")            # narrow rows; later steps never reread the texts
    n = base.count()
    keys = ["doc_id", "size", "text_crc32"]
    pos = Permutation(n, seed).apply(F.col("row_number"))
    return (number_rows(base, keys).withColumn("position", pos)
            .select(*keys, "row_number", "position",
                    F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"),
                    F.call_function("div", F.col("position"), F.lit(n_shards).cast("long")).alias("slot")))


def row_number_of(shard_col: Column, slot_col: Column, n: int, n_shards: int = 40, seed: int = 20) -> Column:
    """The row number that sits at a shard and slot (inverse permutation)."""
    return Permutation(n, seed).apply(slot_col.cast("long") * n_shards + shard_col, back=True)
