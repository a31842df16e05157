"""Dataset profiles and the CSV source.

A profile names where a labelled table lives and how it becomes the common
shape: format, renames, keep-list (optional), class remap, label columns
and row key. Column names may hold dots, dashes, blanks and parentheses;
every reference goes through ``quoted``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundlearn.functions.columns import col, quoted

# The tokens read as missing by the CSV reader the reference
# uses (its default NA list).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Feature keep-list of the EDGE profile (39 features + 2 labels).
EDGE_FEATURES = [
    "tcp.ack", "tcp.ack_raw", "tcp.checksum", "tcp.connection.syn", "tcp.connection.synack", "tcp.flags",
    "tcp.flags.ack", "tcp.len", "tcp.seq",
    "udp.stream", "udp.time_delta",
    "dns.qry.name", "dns.qry.qu", "dns.qry.type", "dns.retransmission", "dns.retransmit_request",
    "dns.retransmit_request_in",
    "http.content_length", "http.response", "http.tls_port", "http.request.method-GET", "http.request.method-POST",
    "http.request.method-OPTIONS", "http.request.method-PROPFIND", "http.request.method-PUT",
    "http.request.method-SEARCH", "http.request.method-TRACE",
    "mqtt.conflag.cleansess", "mqtt.conflags", "mqtt.hdrflags", "mqtt.len", "mqtt.msg_decoded_as", "mqtt.msgtype",
    "mqtt.proto_len", "mqtt.topic_len", "mqtt.ver",
    "mbtcp.len", "mbtcp.trans_id", "mbtcp.unit_id",
]

# Feature keep-list of the TON profile (22 host counters).
TON_FEATURES = [
    "Network_I(Intel R _82574L_GNC)TCP_APS",
    "Network_I(Intel R _82574L_GNC) Packets Received Unknown",
    "Network_I(Intel R _82574L_GNC) Bytes Received sec",
    "Network_I(Intel R _82574L_GNC) Bytes Sent sec",
    "Network_I(Intel R _82574L_GNC) Packets Outbound Errors",
    "Network_I(Intel R _82574L_GNC) Packets Received Discarded",
    "Network_I(Intel R _82574L_GNC) Bytes Total sec",
    "Network_I(Intel R _82574L_GNC) Packets Outbound Discarded",
    "Network_I(Intel R _82574L_GNC) TCP RSC Exceptions sec",
    "Network_I(Intel R _82574L_GNC) Packets Sent Unicast sec",
    "Network_I(Intel R _82574L_GNC) Output Queue Length",
    "Network_I(Intel R _82574L_GNC) Packets Received sec",
    "Network_I(Intel R _82574L_GNC) Current Bandwidth",
    "Network_I(Intel R _82574L_GNC) Packets sec",
    "Network_I(Intel R _82574L_GNC) TCP Active RSC Connections",
    "Network_I(Intel R _82574L_GNC) Packets Sent sec",
    "Network_I(Intel R _82574L_GNC) Packets Received Unicast sec",
    "Network_I(Intel R _82574L_GNC) Packets Sent Non-Unicast sec",
    "Network_I(Intel R _82574L_GNC) Packets Received Non-Unicast sec",
    "Network_I(Intel R _82574L_GNC) TCP RSC Coalesced Packets sec",
    "Network_I(Intel R _82574L_GNC) Offloaded Connections",
    "Network_I(Intel R _82574L_GNC) Packets Received Errors",
]

# TON class names -> EDGE class names.
TON_REMAP = {"normal": "Normal", "ddos": "DDoS_UDP", "password": "Password", "xss": "XSS",
             "injection": "SQL_injection", "dos": "DDoS_TCP", "scanning": "Port_Scanning", "mitm": "MITM"}

LABELS = ("Attack_type", "Attack_label")


@dataclass
class Profile:
    name: str
    path: str | None = None
    fmt: str = "csv"
    rename: dict = field(default_factory=dict)
    keep: list | None = None            # features to keep (labels always kept)
    remap: dict = field(default_factory=dict)
    label_cols: tuple = LABELS
    key: str | None = None
    derive_label: bool = False          # Attack_label = (Attack_type != normal class)
    positive: str | None = None         # the class that makes Attack_label 1 when derived


EDGE = Profile("EDGE", keep=EDGE_FEATURES)
TON = Profile("TON", rename={"type": "Attack_type", "label": "Attack_label"}, keep=TON_FEATURES, remap=TON_REMAP)
EVENTS_PROFILE = Profile("events", fmt="parquet", rename={"event_type": "Attack_type"},
                         keep=["user_id", "value", "props_k"], key="event_id", derive_label=True, positive="error")


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _typed(v: Column, kind: T.DataType) -> Column:
    """Text as ``kind``. Writers give the integers of a column with gaps as
    ``3.0`` or ``1e2``; such text of a whole number is that integer."""
    if not isinstance(kind, WHOLE):
        return v.try_cast(kind)
    number = v.try_cast("double")
    return F.coalesce(v.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long"))).try_cast(kind)


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True,
             multiline: bool = True) -> DataFrame:
    """SRC1: headed comma-separated file. All NA tokens become null, then
    each column is cast to the given type (``try_cast``: text that is not a
    number becomes null rather than failing the job). Without a schema the
    columns stay text (``infer_types`` proposes one).

    A quoted field may hold line breaks, so a file is one split; a large table
    should come as many files. ``multiline=False`` splits large files, for
    data known to have no line breaks in fields."""
    raw = (spark.read.option("header", header).option("delimiter", ",").option("escape", '"')
           .option("multiLine", multiline).csv(path))
    out = []
    fields = {f.name: f.dataType for f in schema.fields} if schema else {}
    for c in raw.columns:
        v = F.when(col(c).isin(NA_TOKENS), F.lit(None)).otherwise(col(c))
        if c in fields:
            v = _typed(v, fields[c])
        out.append(v.alias(c))
    return raw.select(*out)


def infer_types(text: DataFrame) -> T.StructType:
    """A schema for a table of text columns, from one pass over all rows:
    BIGINT where every value is a whole number written plainly and none is
    missing, DOUBLE where every value is a number (a whole-number column with
    gaps as well, as data frames have it), BOOLEAN for True/False, else text;
    a column without values is DOUBLE."""
    aggs = []
    for i, c in enumerate(text.columns):
        v = col(c)
        aggs += [F.count(F.when(v.isNull(), 1)).alias(f"null{i}"), F.count(v).alias(f"n{i}"),
                 F.count(F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), v.try_cast("long"))).alias(f"long{i}"),
                 F.count(v.try_cast("double")).alias(f"double{i}"),
                 F.count(F.when(v.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)).alias(f"bool{i}")]
    r = text.agg(*aggs).first()

    def kind(i: int) -> T.DataType:
        n = r[f"n{i}"]
        if n and r[f"bool{i}"] == n and not r[f"null{i}"]:
            return T.BooleanType()
        if n and r[f"long{i}"] == n and not r[f"null{i}"]:
            return T.LongType()
        return T.DoubleType() if r[f"double{i}"] == n else T.StringType()

    return T.StructType([T.StructField(c, kind(i)) for i, c in enumerate(text.columns)])


def load(spark: SparkSession, p: Profile, schema: T.StructType | None = None) -> DataFrame:
    """SRC2 ``scan_profile``: read by profile and shape it."""
    if p.fmt == "csv":
        df = csv_scan(spark, p.path, schema)
    else:
        df = spark.read.format(p.fmt).load(p.path)
    return apply_profile(df, p)


def apply_profile(df: DataFrame, p: Profile) -> DataFrame:
    """PRJ1 rename, PRJ5 remap, optional derived label, PRJ2 keep-list
    (a missing column is an error)."""
    if p.rename:
        df = df.withColumnsRenamed(p.rename)
    if p.remap:
        m = F.create_map(*[x for k, v in p.remap.items() for x in (F.lit(k), F.lit(v))])
        df = df.withColumn("Attack_type", F.coalesce(m[F.col("Attack_type")], F.col("Attack_type")))
    if p.derive_label:
        df = df.withColumn("Attack_label", (F.col("Attack_type") == F.lit(p.positive)).cast("int"))
    if p.keep is not None:
        keep = ([p.key] if p.key else []) + list(p.label_cols) + list(p.keep)
        df = df.select(*[F.col(quoted(c)) for c in keep])
    return df


def features(df: DataFrame, p: Profile) -> list[str]:
    """Feature set = every column that is not a label or the key (by exclusion)."""
    skip = set(p.label_cols) | ({p.key} if p.key else set())
    return [c for c in df.columns if c not in skip and not c.endswith("_encoded")]
