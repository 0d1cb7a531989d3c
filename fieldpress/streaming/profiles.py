"""Streams of cells: profiles per event-time window, with late cells cut off by a watermark, and encoding per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codec import encode_cells
from ..operators.grid import is_missing


def windowed_stats(cells: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """n_cells, n_valid, v_min, v_max and v_mean per field_id and window of a stream with columns (field_id, value, ts)."""
    v = F.when(~is_missing(F.col("value")), F.col("value"))
    stats = cells.withWatermark(ts, late).groupBy("field_id", F.window(ts, window).alias("w"))
    stats = stats.agg(F.count("*").alias("n_cells"), F.count(v).alias("n_valid"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"))
    return stats.select("field_id", F.col("w.start").alias("start"), "n_cells", "n_valid", "v_min", "v_max", "v_mean")


def encode_batches(cells: DataFrame, folder: str, error_bound: float, ny: int, nx: int, **options):
    """A writer that appends each micro-batch's cells as encoded chunks. A batch that is run again overwrites its own folder.

    ``options`` are those of ``encode_cells``; a chunk is one time step unless they say otherwise. A chunk whose cells come in
    several batches is one stream in each of them.
    """
    options = {"chunk": 1} | options

    def write(batch: DataFrame, epoch: int) -> None:
        encode_cells(batch, error_bound, ny, nx, **options).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return cells.writeStream.foreachBatch(write)
