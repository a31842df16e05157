"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns a, b of any one orderable type. Returns (node, root)
    for every node of an edge, root being the smallest node it reaches.

    Each round moves edges towards smaller neighbours with one aggregate and
    one join for each half; no neighbourhood is gathered in one place. Rounds
    grow with the logarithm of the longest chain. Every round is written to the
    shared folder."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                "edges")
    before = _state(e)
    if before[0] == 0:
        return e.toDF("node", "root")
    for _ in range(max_rounds):
        # large star: larger neighbours of u move to u's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        e = (moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(low.select("u", F.col("m").alias("v"))))
        e = written(e.distinct(), "edges")
        after = _state(e)
        if after == before:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        before = after
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]
