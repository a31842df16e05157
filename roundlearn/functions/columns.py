"""Column expressions: quoting, text rendering, vectors, tokens, losses.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays in the JVM; no Python UDFs. Expressions with lambdas over arrays are
interpreted per element, the others are part of the generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for equal results.
TEXT_PREFIX = "classify: "      # prompt prefix of the text-to-text scripts
MAX_TOKENS = 128                # input token length
LABEL_TOKENS = 10               # label token length (text-to-text)
IGNORE_INDEX = -100             # loss-ignored label id
PAD_ID = 0
ZSCORE_EPS = 1e-6
F1_EPS = 1e-7
THRESHOLD = 0.5


def quoted(name: str) -> str:
    """Back-quote a column name so dots, dashes, blanks and parentheses are
    taken literally (``tcp.ack``, ``http.request.method-GET``)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


# ---------------------------------------------------------------- text

def canon(c: Column, dtype: T.DataType, upcast: bool = False) -> Column:
    """Render a value the way Python's ``str()`` does for the common range:
    null/NaN -> ``nan``, ints as is, doubles in shortest form with a
    trailing ``.0`` for integral values, booleans ``True``/``False``.

    ``upcast`` renders integers as doubles (``0`` -> ``0.0``), which is what a
    row lambda over an all-numeric row does."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("nan")).when(c, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if upcast:
            return canon(c.cast("double"), T.DoubleType())
        return F.coalesce(c.cast("string"), F.lit("nan"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d, text = c.cast("double"), c.cast("string")
        return F.when(d.isNull() | F.isnan(d), F.lit("nan")).when(text.contains("E"), _plain(text, d)).otherwise(text)
    return F.coalesce(c.cast("string"), F.lit("nan"))


def _plain(text: Column, value: Column) -> Column:
    """A number written with an exponent, as plain digits (magnitudes from
    1e-13 to 1e27; others keep the exponent)."""
    digits = F.when(F.abs(value) < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,10)").cast("string"))
    cut = F.regexp_replace(digits, "0+$", "")
    plain = F.when(cut.endswith("."), F.concat(cut, F.lit("0"))).otherwise(cut)
    return F.when((F.abs(value) >= 1e-13) & (F.abs(value) < 1e27), plain).otherwise(text)


def row_to_text(df: DataFrame, features: Sequence[str], upcast: bool = False,
                sep: str = " ") -> Column:
    """``" ".join(str(row[c]) for c in features)`` in column order (PRJ6a/b/c)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws(sep, *[canon(col(c), types[c], upcast) for c in features])


def prompt_prefix(text: Column, prefix: str = TEXT_PREFIX) -> Column:
    return F.concat(F.lit(prefix), text)


def normalise_text(c: Column) -> Column:
    """``.strip().lower()`` with full whitespace trimming."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def label_text_id(c: Column) -> Column:
    return c.cast("string")


def format_metric(c: Column, digits: int = 4) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double")))


# ------------------------------------------------------------- vectors

def label_pair(type_id: Column, label_id: Column) -> Column:
    return F.array(type_id.cast("int"), label_id.cast("int"))


def label_unpack(pair: Column, i: int) -> Column:
    return F.element_at(pair, i + 1)


def multi_hot(positions: Column, width: int) -> Column:
    """0/1 vector of ``width`` with 1 at each (already offset) position."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda i: F.array_contains(positions, i).cast("int"))


def one_hot(idx: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == idx).cast("int"))


def one_hot_concat(ids: Sequence[Column], widths: Sequence[int]) -> Column:
    return F.concat(*[one_hot(i, w) for i, w in zip(ids, widths)])


def block_slice(arr: Column, offset: int, width: int) -> Column:
    return F.slice(arr, offset + 1, width)


def class_subset(arr: Column, positions: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda i: F.element_at(arr, i + 1))


def threshold_predict(p: Column, thr: float = THRESHOLD) -> Column:
    """Strict ``p > thr`` -> 1 else 0."""
    return (p > F.lit(thr)).cast("int")


# ------------------------------------------------------------- tokens

def tokens(text: Column) -> Column:
    """Whitespace split of the whole text."""
    return F.split(text, r"\s+")


def token_id(tok: Column, vocab: int, fn: str = "md5") -> Column:
    """Stable hashed id. ``md5``: first 28 bits of the md5, modulo the
    vocabulary (reproducible in any SQL engine); ``xxhash64``: Spark's
    built-in 64-bit hash, several times cheaper per token."""
    if fn == "xxhash64":
        return F.pmod(F.xxhash64(tok), F.lit(vocab)).cast("int")
    return (F.conv(F.substring(F.md5(tok), 1, 7), 16, 10).cast("bigint") % F.lit(vocab)).cast("int")


def tokenise_hash(text: Column, vocab: int = 30522, fn: str = "md5") -> Column:
    """Whole text -> hashed token ids (a stand-in for a pretrained tokenizer)."""
    return F.transform(tokens(text), lambda t: token_id(t, vocab, fn))


def pad_truncate(ids: Column, length: int = MAX_TOKENS, pad: int = PAD_ID) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int = MAX_TOKENS) -> Column:
    """``n`` ones then zeros, ``n = min(len(ids), L)``: a slice of a constant
    array, so ``ids`` is evaluated once per row (a lambda that references
    an outer expression re-evaluates it for every element once the
    optimizer inlines it)."""
    n = F.least(F.size(ids), F.lit(length))
    base = F.array(*([F.lit(1)] * length + [F.lit(0)] * length))
    return F.slice(base, F.lit(length + 1) - n, F.lit(length))


def label_mask(ids: Column, pad: int = PAD_ID, ignore: int = IGNORE_INDEX) -> Column:
    return F.transform(ids, lambda t: F.when(t == pad, F.lit(ignore)).otherwise(t))


def label_unmask(ids: Column, pad: int = PAD_ID, ignore: int = IGNORE_INDEX) -> Column:
    return F.transform(ids, lambda t: F.when(t == ignore, F.lit(pad)).otherwise(t))


# ------------------------------------------------------- probabilities

def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _per_element(arr: Column, scalar: Column) -> Column:
    """``scalar`` repeated to the length of ``arr``: zipping against it lets a
    lambda use a per-row value without referencing an outer expression
    (which the optimizer would inline and re-evaluate for every element)."""
    return F.array_repeat(scalar, F.size(arr))


def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.zip_with(logits, _per_element(logits, m), lambda v, mm: F.exp(v - mm))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.zip_with(e, _per_element(e, s), lambda v, ss: v / ss)


def logsumexp(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.zip_with(logits, _per_element(logits, m), lambda v, mm: F.exp(v - mm))
    return m + F.log(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v))


def bce_with_logits(x: Column, z: Column) -> Column:
    """Numerically stable ``-z log s(x) - (1-z) log(1-s(x))``."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def ce_from_logits(logits: Column, y_index: Column) -> Column:
    """Cross-entropy of one row: logsumexp(logits) - logits[y] (0-based y)."""
    return logsumexp(logits) - F.element_at(logits, y_index + 1)


def argmax_first(arr: Column) -> Column:
    """0-based index of the largest value; the first wins on ties."""
    return F.array_position(arr, F.array_max(arr)).cast("int") - 1


def to_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))
