"""Session helpers: a sane local session for tests/bench, the shared
checkpoint folder, and a size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # row_number() <= n over a class window: let the optimizer insert a
    # map-side group limit up to the caps we use (2 000 / 5 000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a local session. Used by tests and bench only; on a
    cluster the caller brings its own session."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName("roundlearn")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). Only when none is set (local tests) a
    private folder under the system temp dir is created and registered."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="roundlearn-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (local runs, nodes that share the folder). Elsewhere it is installed on
    the nodes or given with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/roundlearn-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; survives
    executor loss (unlike localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded_broadcast(df: DataFrame, bound_rows: int, max_rows: int = 2_000_000) -> DataFrame:
    """Broadcast ``df`` only when its proven row bound fits; otherwise leave
    the join strategy to the optimizer/AQE (shuffle join)."""
    return F.broadcast(df) if bound_rows <= max_rows else df


def checked_broadcast(df: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """Broadcast a small derived table (one row per class, per bucket, ...)
    only after its row count is checked; a table over ``max_rows`` is left
    to the optimizer/AQE (shuffle join). Small results are kept as local
    relations so the count does not re-run their lineage."""
    small = small_local(df)
    if is_local(small) or small.count() <= max_rows:
        return F.broadcast(small)               # at most max_rows rows, counted
    return small


def is_local(df: DataFrame) -> bool:
    """True when the optimized plan is a constant local relation (computing
    or counting it needs no job)."""
    try:
        return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a remote session)
        return False


LOCAL_ROWS = 5_000     # above this a small table is checkpointed instead of inlined


def small_local(df: DataFrame) -> DataFrame:
    """Compute a small aggregate once (a confusion matrix, a dictionary, a
    registry: bounded by the class count, never by the data) and keep it as
    a local relation, so plans that reuse it do not recompute its lineage.
    Only LOCAL_ROWS rows reach the driver; a larger result is checkpointed
    from the copy that was computed for the check."""
    if is_local(df):
        return df                               # already constant: nothing to compute
    rows, held = small_rows(df)
    return held if rows is None else local_frame(df.sparkSession, rows, df.schema)


def small_rows(df: DataFrame) -> tuple[list | None, DataFrame]:
    """The rows of a small aggregate on the driver, computed once; None for
    one of more than LOCAL_ROWS rows, and the frame to go on with."""
    held = df.persist()                         # computed once, whatever its size
    try:
        rows = held.limit(LOCAL_ROWS + 1).collect()
        if len(rows) > LOCAL_ROWS:              # too large to inline as a constant
            return None, materialize(held)
    finally:
        held.unpersist()
    return rows, df


def _sql_literal(v, dt: T.DataType) -> str:
    t = dt.simpleString()
    if v is None:
        return f"CAST(NULL AS {t})"
    if isinstance(dt, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dt, T.BooleanType):
        return "true" if v else "false"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        f = float(v)
        lit = f"CAST('{f}' AS DOUBLE)" if (f != f or f in (float("inf"), float("-inf"))) else f"{f!r}D"
        return lit if isinstance(dt, T.DoubleType) else f"CAST({lit} AS FLOAT)"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({int(v)} AS {t})"
    if isinstance(dt, T.ArrayType):
        return f"CAST(array({', '.join(_sql_literal(x, dt.elementType) for x in v)}) AS {t})"
    raise TypeError(f"no literal for {t}")


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A small constant table as a true local relation (inline ``VALUES``):
    reading, counting or broadcasting it needs no job, unlike a
    DataFrame created from a Python list (a parallelized RDD). For
    class-sized metadata only (configs, dictionaries, registries,
    confusion cells)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rows = list(rows)
    if len(rows) > LOCAL_ROWS:                  # too many to write out as a constant
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    names = [f.name for f in schema.fields]
    cols = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(schema.fields))
    aliases = ", ".join(f"c{i}" for i in range(len(names)))
    rows = [tuple(r[n] for n in names) if hasattr(r, "asDict") else tuple(r) for r in rows]
    if not rows:
        vals = "(" + ", ".join(_sql_literal(None, f.dataType) for f in schema.fields) + ")"
        return spark.sql(f"SELECT {cols} FROM VALUES {vals} AS t({aliases}) WHERE false")
    vals = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")" for r in rows)
    return spark.sql(f"SELECT {cols} FROM VALUES {vals} AS t({aliases})")
