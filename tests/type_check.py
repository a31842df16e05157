"""Compare column types of every query with its oracle (Spark vs DuckDB)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from roundlearn.session import local_session  # noqa: E402
from roundlearn.sources.tables import TABLES  # noqa: E402

MAP = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
       "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def spark_type(dt) -> str:
    n = type(dt).__name__
    if n == "ArrayType":
        return spark_type(dt.elementType) + "[]"
    if n == "DecimalType":
        return f"DECIMAL({dt.precision},{dt.scale})"
    return MAP.get(n, n)


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    qs, sq = E.queries(), E.oracle_sql()
    bad = 0
    for k, sql in sq.items():
        sch = {f.name: spark_type(f.dataType) for f in qs[k](spark, d).schema.fields}
        rel = con.sql(sql)
        dk = {n: str(t) for n, t in zip(rel.columns, rel.types)}
        diff = {c: (sch.get(c), dk.get(c)) for c in set(sch) | set(dk) if sch.get(c) != dk.get(c)}
        if diff:
            bad += 1
            print(k, diff, flush=True)
    print("keys with type differences:", bad)


if __name__ == "__main__":
    main()
