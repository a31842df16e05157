"""Ranks without one-task windows, caps per class, CSV as data frames write
it, type inference, trainable heads."""

import math
import os
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from roundlearn.operators import gradient
from roundlearn.operators import labels as L
from roundlearn.operators import sampling as S
from roundlearn.session import LOCAL_ROWS
from roundlearn.sources import profiles as P


def _csv(text):
    p = os.path.join(tempfile.mkdtemp(prefix="roundlearn-test-"), "data.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_dictionary_beyond_the_inlined_size_keeps_native_order(spark):
    n = LOCAL_ROWS + 2000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("user"), F.lit("x").alias("kind"))
    got = {(r["label_col"], r["label"]): r["id"] for r in L.fit_dictionary(df, ["user", "kind"]).collect()}
    assert len(got) == n + 1 and got["kind", "x"] == 0
    assert all(got["user", str(i)] == i for i in range(n))


def test_ordered_rank_of_parts_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", None), ("b", 9)], "p string, v int")
    got = {(r["p"], r["v"]): r["r"] for r in S.ordered_rank(df, ["v"], "r", ["p"]).collect()}
    assert got == {("a", None): 1, ("a", 1): 2, ("a", 3): 3, ("b", 2): 1, ("b", 9): 2}
    assert S.ordered_rank(df.where("false"), ["v"], "r").count() == 0


def test_cap_for_each_class(spark):
    df = spark.range(600).select(F.col("id").alias("key"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                                                                         (F.col("id") % 3 + 1).cast("int")).alias("k"))
    got = S.stratified_cap(df, "k", "key", {"a": 7, "b": 50}, keep_all=["c"])
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 7, "b": 50, "c": 200}
    one = S.stratified_cap(df.where("k = 'a'"), "k", "key", 7)
    assert {r["key"] for r in got.where("k = 'a'").collect()} == {r["key"] for r in one.collect()}


def test_csv_line_breaks_in_quotes_and_float_written_integers(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("big", T.LongType()), T.StructField("t", T.StringType())])
    p = _csv('n,big,t\n3.0,9007199254740993,"two\nlines"\n1e2,,"say ""hi"""\n2.5,7,x\nNA,1,y\n')
    rows = [tuple(r) for r in P.csv_scan(spark, p, schema).collect()]
    assert rows == [(3, 9007199254740993, "two\nlines"), (100, None, 'say "hi"'), (None, 7, "x"), (None, 1, "y")]


def test_infer_types(spark):
    p = _csv("i,gap,f,b,t,none\n1,2,1e-3,True,x,\n22,NA,4,False,5,\n")
    got = {f.name: f.dataType.simpleString() for f in P.infer_types(P.csv_scan(spark, p)).fields}
    assert got == {"i": "bigint", "gap": "double", "f": "double", "b": "boolean", "t": "string", "none": "double"}


def test_no_vector_crosses_an_exchange(spark):
    import __spark_entry__ as E
    plan = E.queries()["fused_predict"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "MapInPandas" in below
    for m in re.finditer(r"Exchange hashpartitioning\((\w+)", plan):
        assert "embedding" not in m.group(1)
    above = plan[:plan.index("MapInPandas")]
    assert "embedding" not in above
