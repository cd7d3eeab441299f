"""Embeddings as packed doubles; those that may take no part are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import map_batches


def usable(embeddings: DataFrame, *keep: str) -> DataFrame:
    """vec_id, the columns in keep, and raw: the vector as little-endian doubles.

    Without rows whose vector is null, empty, zero, or has a null, NaN or infinite component. Vectors of another length than
    the most frequent one among the rest take no part either (ties: the longer one), as no measure relates them.
    """
    def step(batch):
        column = batch.column(batch.num_columns - 1)
        lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        flat = column.flatten()
        good_value = np.isfinite(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
        values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        raws = []
        for length, end in zip(lengths.tolist(), ends.tolist(), strict=True):
            part = values[end - length:end]
            fine = length > 0 and good_value[end - length:end].all() and part.any()
            raws.append(part.astype("<f8").tobytes() if fine else None)
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(raws, pa.binary())],
                                          names=["vec_id", *keep, "raw"])

    rows = embeddings.select("vec_id", *keep, "embedding")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", *keep))
    return map_batches(rows, step, f"{kinds}, raw binary").where("raw IS NOT NULL AND vec_id IS NOT NULL")


def common_length(rows: DataFrame) -> int:
    """Bytes of the most frequent vector length; 0 without rows."""
    found = rows.groupBy("raw_length").count().orderBy("count", "raw_length", ascending=False).limit(1).collect()
    return found[0][0] if found else 0


def matrix(raws) -> np.ndarray:
    """Rows of doubles from packed vectors of one length."""
    return np.frombuffer(b"".join(bytes(r) for r in raws), "<f8").reshape(len(raws), -1) if len(raws) else np.zeros((0, 0))
