"""Sparse text features: hashed tokens with logarithmic counts, scaled to
length 1.

The ids are those of ``columns.token_id`` (md5), modulo the number of
dimensions; a worker remembers the ids of the tokens it has met lately. Texts
are cut and counted as arrays, some megabytes at a time, so a worker's memory
does not grow with the batches it is given. Null texts have null features, an
empty text has its one empty token."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DIMS = 4_096
VOCAB = 30_522
CACHED = 100_000           # tokens after which a worker forgets those not met lately
PART_BYTES = 2 << 20       # texts of a batch that are cut together
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def token_id(token: str, vocab: int = VOCAB) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % vocab


def _portions(b: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PART_BYTES`` of text in column ``col``
    (one row at least)."""
    texts = b.column(col)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    ends = ends[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + PART_BYTES, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all texts (split at white space), end to end, and how
    many each text has; a null text has none."""
    raw = [None if t is None else t.encode() for t in texts.to_pylist()]
    sizes = np.fromiter((len(t or b"") for t in raw), np.int64, len(raw))
    there = np.fromiter((t is not None for t in raw), bool, len(raw))
    at = np.frombuffer(b"".join(t for t in raw if t), np.uint8)
    blank = _BLANK[at]
    stops = np.cumsum(sizes)
    begins = (stops - sizes)
    fresh = np.zeros(len(at), bool)            # first bytes of texts
    fresh[begins[sizes > 0]] = True
    run = blank.copy()                         # first bytes of runs of white space, each of which ends a token
    run[1:] &= ~blank[:-1] | fresh[1:]
    runs = np.flatnonzero(run)
    n = np.searchsorted(runs, stops) - np.searchsorted(runs, begins) + there
    # without the white space the tokens lie end to end
    word = at[~blank]
    upto = runs - np.searchsorted(np.flatnonzero(blank), runs)
    ends = np.zeros(int(n.sum()), np.int64)
    last = (np.cumsum(n) - 1)[there]           # a text's last token ends where the text does
    inner = np.ones(len(ends), bool)
    inner[last] = False
    ends[inner] = upto
    ends[last] = stops[there] - np.searchsorted(np.flatnonzero(blank), stops[there])
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(word))
    return tokens.dictionary_encode(), n


class _Ids:
    """The ids of tokens; remembers those met lately."""

    def __init__(self, vocab: int):
        self.vocab = vocab
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def of(self, tokens: pa.DictionaryArray) -> np.ndarray:
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        words = tokens.dictionary.to_pylist()
        young, old, ids = self.young, self.old, []
        for w in words:
            i = young.get(w)
            if i is None:
                i = old.get(w)
                if i is None:
                    i = token_id(w, self.vocab)
                if len(young) <= 2 * CACHED:
                    young[w] = i
            ids.append(i)
        return np.array(ids, np.int32)[tokens.indices.to_numpy()] if ids else np.zeros(0, np.int32)


def _lists(sizes: np.ndarray, values: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values), mask=null)


def hashed_ids(rows: DataFrame, text_col: str, keep: list[str], vocab: int = VOCAB, out: str = "ids") -> DataFrame:
    """``keep`` and the token ids of whole texts, as ``columns.tokenise_hash``
    gives them. Texts repeat their tokens, so a worker hashes each distinct
    one once and looks the others up, where an expression hashes all."""
    src = rows.select(*keep, text_col)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        known = _Ids(vocab)
        for b in batches:
            for p in _portions(b, len(keep)):
                tokens, n = cut(p.column(len(keep)))
                ids = _lists(n, known.of(tokens), p.column(len(keep)).is_null())
                yield pa.RecordBatch.from_arrays([*p.columns[:-1], ids], names=[*p.schema.names[:-1], out])
    return src.mapInArrow(run, schema)


def text_vectors(rows: DataFrame, text_col: str, keep: list[str], dims: int = DIMS, vocab: int = VOCAB, out: str = "f") -> DataFrame:
    """``keep`` and the sparse features ``out`` (struct of idx and val)."""
    src = rows.select(*keep, text_col)
    kind = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, kind)])

    def run(batches):
        known = _Ids(vocab)
        for b in batches:
            for p in _portions(b, len(keep)):
                tokens, n = cut(p.column(len(keep)))
                key = np.repeat(np.arange(len(n)) * dims, n) + known.of(tokens) % dims
                key, times = np.unique(key, return_counts=True)
                row, val = key // dims, np.log1p(times)
                val /= np.sqrt(np.bincount(row, val * val, minlength=len(n)))[row]
                sizes, null = np.bincount(row, minlength=len(n)), p.column(len(keep)).is_null()
                f = pa.StructArray.from_arrays([_lists(sizes, (key % dims).astype(np.int32), null), _lists(sizes, val, null)],
                                               names=["idx", "val"], mask=null)
                yield pa.RecordBatch.from_arrays([*p.columns[:-1], f], names=[*p.schema.names[:-1], out])
    return src.mapInArrow(run, schema)


def vectors_sql(id_col: str, ids_sql: str, source: str, dims: int = DIMS) -> str:
    """(id, j, v) of the same features with the bias as dimension -1;
    ``ids_sql`` gives the list of token ids of a row of ``source``."""
    return f"""SELECT id, j, ln(1 + c) / sqrt(sum(ln(1 + c) * ln(1 + c)) OVER (PARTITION BY id)) AS v FROM
  (SELECT id, tok % {dims} AS j, count(*) AS c FROM (SELECT {id_col} AS id, unnest({ids_sql}) AS tok FROM {source}) GROUP BY 1, 2)
  UNION ALL SELECT {id_col}, -1, 1.0 FROM {source}"""
