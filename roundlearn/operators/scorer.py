"""A saved model as a scorer: loaded once by a worker, cached by version.

The model (heads saved by round, ``sinks.save_heads``) is packed into bytes by
the driver and broadcast; what a task's closure holds is its version and the
broadcast's handle, not the model. A Python worker unpacks a version when it
first meets it and keeps the last few, over batches and tasks."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 4                   # versions that a worker holds
_loaded: dict[str, "LinearModel"] = {}
loads = 0                  # versions that this worker has unpacked


@dataclass(frozen=True)
class LinearModel:
    names: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias


def pack(spark: SparkSession, path: str, order: dict[str, int]) -> bytes:
    """Saved centroid heads (class, dim, value) as bytes, in the class order
    given; classes without a head are left out. One row a class and dim."""
    rows = spark.read.parquet(path).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    rows = sorted((r for r in rows if str(r["class"]) in order), key=lambda r: order[str(r["class"])])
    mu = np.array([[x["value"] for x in r["v"]] for r in rows], np.float64)
    out = io.BytesIO()
    np.savez(out, names=np.array([str(r["class"]) for r in rows]), weights=mu, bias=-0.5 * (mu * mu).sum(axis=1))
    return out.getvalue()


def loaded(version: str, packed) -> LinearModel:
    """The model of a version, unpacked if this worker has not met it."""
    global loads
    if version not in _loaded:
        while len(_loaded) >= KEPT:
            _loaded.pop(next(iter(_loaded)))
        with np.load(io.BytesIO(packed.value)) as z:
            _loaded[version] = LinearModel(z["names"], z["weights"], z["bias"])
        loads += 1
    return _loaded[version]


def score(rows: DataFrame, version: str, packed, vec_col: str, keep: list[str]) -> DataFrame:
    """``keep``, the predicted class (the first on ties; null for a null
    vector) and how many versions the worker had unpacked by then."""
    import pandas as pd
    src = rows.select(*keep, vec_col)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        from roundlearn.operators import scorer
        for pdf in batches:
            model = scorer.loaded(version, packed)
            there = pdf[vec_col].notna().to_numpy()
            pred = np.full(len(pdf), None, dtype=object)
            if there.any():
                x = np.stack(pdf.loc[there, vec_col].to_numpy()).astype(np.float64)
                pred[there] = model.names[model.scores(x).argmax(axis=1)]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame({"pred": pred, "loads": scorer.loads})], axis=1)
    return src.mapInPandas(run, f"{kinds}, pred string, loads int")
