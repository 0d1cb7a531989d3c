"""SQL names: ``field_encode(values, nt, ny, nx, bound)``, ``field_decode(stream)`` (missing cells are NULL) and the table function ``stream_cells(stream)``.

Spark joins no Arrow table function laterally, so ``stream_cells`` makes rows one by one; for large streams ``posexplode(field_decode(stream))``
gives the same cells in C order from Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..config import FieldConfig
from .container import read_container


def register(spark: SparkSession) -> None:
    from ..operators.codec import FieldCodec, decode_box

    def encode(values: pd.Series, nt: pd.Series, ny: pd.Series, nx: pd.Series, bound: pd.Series) -> pd.Series:
        rows = zip(values, nt, ny, nx, bound)
        return pd.Series([FieldCodec(FieldConfig((int(t), int(y), int(x)), float(b), dtype="float64")).encode(np.asarray(v, float)) for v, t, y, x, b in rows])

    def decode(stream: pd.Series) -> pd.Series:
        return pd.Series([decode_box(read_container(s)).ravel().astype(float).tolist() for s in stream])

    class StreamCells:
        def eval(self, stream: bytes):
            field = decode_box(read_container(bytes(stream)))
            for (t, y, x), v in np.ndenumerate(field):
                yield t, y, x, float(v)

    encode.__annotations__ = {"values": pd.Series, "nt": pd.Series, "ny": pd.Series, "nx": pd.Series, "bound": pd.Series, "return": pd.Series}
    decode.__annotations__ = {"stream": pd.Series, "return": pd.Series}
    spark.udf.register("field_encode", pandas_udf(encode, "binary"))
    spark.udf.register("field_decode", pandas_udf(decode, "array<double>"))
    spark.udtf.register("stream_cells", udtf(StreamCells, returnType="t int, y int, x int, value double"))
