"""``.npy`` files as cells: read by Spark's binaryFile source, so from any store that Spark reaches."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def as_field(array: np.ndarray) -> np.ndarray:
    """float32 (time, lat, lon); two dimensions are one time step, other ranks are refused."""
    if array.ndim == 2:
        array = array[None]
    if array.ndim != 3:
        raise ValueError(f"a field has two or three dimensions, not {array.ndim}")
    return np.ascontiguousarray(array, np.float32)


def read_npy(spark: SparkSession, path: str, t_from: int = 0, t_to: int | None = None) -> DataFrame:
    """(field_id, t, y, x, value) of each file; field_id is its path. Time steps, or those from t_from to t_to, are sent on one by one."""
    names = ["field_id", "t", "y", "x", "value"]

    def cells(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                field = as_field(np.load(io.BytesIO(data.as_py()), allow_pickle=False))
                y, x = (i.ravel().astype(np.int32) for i in np.indices(field.shape[1:]))
                for t in range(t_from, len(field) if t_to is None else min(t_to + 1, len(field))):
                    plane, n = field[t], field[t].size
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, t, np.int32)), pa.array(y), pa.array(x), pa.array(plane.ravel())], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, "field_id string, t int, y int, x int, value float")
