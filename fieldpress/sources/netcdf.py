"""NetCDF files as cells, by xarray where it is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = (".nc", ".nc4", ".netcdf")


def read_netcdf(spark: SparkSession, path: str, variable: str = "wvpa", t_from: int = 0, t_to: int | None = None) -> DataFrame:
    """(field_id, t, y, x, value) of one variable, a task per time step from t_from to t_to. The path must be readable on every executor."""
    try:
        import xarray
    except ImportError as e:
        raise ImportError("reading NetCDF needs xarray and h5netcdf") from e
    from .arrays import as_field

    with xarray.open_dataset(path, engine="h5netcdf") as data:
        if variable not in data:
            raise KeyError(f"no variable {variable!r}; there are {sorted(data.data_vars)}")
        steps = data[variable].shape[0] if data[variable].ndim == 3 else 1

    def cells(batches):
        import numpy as np
        import pyarrow as pa
        import xarray

        with xarray.open_dataset(path, engine="h5netcdf") as data:
            for batch in batches:
                for t in batch["id"].to_pylist():
                    plane = as_field(np.asarray(data[variable][t] if data[variable].ndim == 3 else data[variable]))[0]
                    y, x = (i.ravel().astype(np.int32) for i in np.indices(plane.shape))
                    n = plane.size
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, t, np.int32)), pa.array(y), pa.array(x), pa.array(plane.ravel())], names=["field_id", "t", "y", "x", "value"])

    last = steps if t_to is None else min(t_to + 1, steps)
    return spark.range(t_from, max(last, t_from)).repartition(max(1, last - t_from)).mapInArrow(cells, "field_id string, t int, y int, x int, value float")
