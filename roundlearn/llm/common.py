"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.session import scratch_path, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh table in the shared checkpoint folder and
    read it back: lineage is cut, and a lost executor loses nothing."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], base: str) -> str:
    """A column name that no column of the caller has (names compare
    without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(id_col: Column) -> Column:
    """True for rows whose crc32(id as text) mod 4 is 2; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def parts(texts: pa.Array, size: int) -> Iterator[slice]:
    """Slices of a column of texts with about ``size`` bytes each."""
    first, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        total += n
        if total >= size or i == len(texts) - 1:
            yield slice(first, i + 1)
            first, total = i + 1, 0


class IntMap:
    """A map of non-negative integers for lookups of whole arrays (open
    addressing, linear probes)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            slot, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slot], self.values[slot] = keys[won], values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) for each key; values of keys not found mean nothing."""
        at = self._home(keys)
        there = self.keys[at]
        found = there == keys
        open_ = np.flatnonzero(~found & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (there >= 0)]
        return found, self.values[at]
