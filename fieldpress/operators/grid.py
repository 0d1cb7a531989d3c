"""Fields as cell tables (field_id, t, y, x, value): masks, indices over valid cells, run lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import varint_length

#: Rows of a block of a sequence; windows over neighbours are taken per block, with copies of the rows before it.
BLOCK = 1 << 16


def is_missing(value: Column, missing_value: float = math.nan, dtype: str = "double") -> Column:
    """NULL, NaN, infinite, or equal to the sentinel in the field's own type."""
    inf = float("inf")
    out = value.isNull() | F.isnan(value) | (value == inf) | (value == -inf)
    return out if math.isnan(missing_value) else out | (value == F.lit(missing_value).cast(dtype))


def events_grid(events: DataFrame, origin: str = "2024-01-01") -> DataFrame:
    """Largest value by day, hour and user_id % 32, dense: absent cells have a null value."""
    g = events.groupBy(F.datediff(F.to_date("ts"), F.lit(origin)).alias("t"), F.hour("ts").alias("y"), (F.col("user_id") % 32).cast("int").alias("x")).agg(F.max("value").alias("value"))
    axes = g.agg(F.max("t").alias("last")).filter("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    axes = axes.select("t", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y")).select("t", "y", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("x"))
    return axes.join(g, ["t", "y", "x"], "left").select(F.lit("events").alias("field_id"), "t", "y", "x", "value")


def embedding_grid(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return embeddings.select(F.lit("embeddings").alias("field_id"), F.lit(0).alias("t"), F.col(key).cast("int").alias("y"), F.posexplode(vector).alias("x", "value"))


def densify(cells: DataFrame, nt: int, ny: int, nx: int) -> DataFrame:
    """Adds absent cells of each field with a null value."""
    axes = cells.select("field_id").distinct().select("field_id", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("t"))
    axes = axes.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
    return axes.join(cells, ["field_id", "t", "y", "x"], "left")


def restore_missing(cells: DataFrame, sentinel: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("missing"), F.lit(sentinel)).otherwise(F.col("value")))


def numbered(cells: DataFrame, name: str = "idx", order: tuple[str, ...] = ("y", "x"), major: str = "t") -> DataFrame:
    """Row numbers from 0 within field_id in order of (major, *order). Each slice is ranked by itself, and slices' counts are summed up, so no field is one task's."""
    rank = F.row_number().over(Window.partitionBy("field_id", major).orderBy(*order)) - 1
    before = Window.partitionBy("field_id").orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    base = cells.groupBy("field_id", major).agg(F.count("*").alias("n")).select("field_id", major, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    return cells.withColumn("rank_", rank).join(base, ["field_id", major]).withColumn(name, (F.col("rank_") + F.col("before_")).cast("bigint")).drop("rank_", "before_")


def valid_index(cells: DataFrame) -> DataFrame:
    return numbered(cells.filter(~is_missing(F.col("value"))))


def with_before(df: DataFrame, column: str, n: int, idx: str = "idx") -> DataFrame:
    """Adds ``{column}_1`` ... ``{column}_n``: the values of the rows before, by idx within field_id; null before the first."""
    at = F.floor(F.col(idx) / BLOCK)
    halo = F.when(F.col(idx) % BLOCK >= BLOCK - n, F.array(at, at + 1)).otherwise(F.array(at))
    spread = df.withColumn("block_", F.explode(halo))
    w = Window.partitionBy("field_id", "block_").orderBy(idx)
    spread = spread.withColumns({f"{column}_{k}": F.lag(column, k).over(w) for k in range(1, n + 1)})
    return spread.filter(F.col("block_") == at).drop("block_")


def mask_runs(cells: DataFrame) -> DataFrame:
    """(field_id, run, missing, start, length) of equal neighbours in the flattened mask. Runs are numbered per block; a row for each block is summed up per field."""
    flat = numbered(cells.withColumn("missing", is_missing(F.col("value")).cast("int")))
    edges = with_before(flat, "missing", 1).filter("missing_1 IS NULL OR missing <> missing_1")
    edges = edges.select("field_id", "missing", F.col("idx").alias("start"), F.floor(F.col("idx") / BLOCK).alias("block_"))
    inside = Window.partitionBy("field_id", "block_").orderBy("start")
    edges = edges.withColumns({"rank_": F.row_number().over(inside) - 1, "next_": F.lead("start").over(inside)})
    blocks = edges.groupBy("field_id", "block_").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    along = Window.partitionBy("field_id").orderBy("block_")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("field_id", "block_", before.alias("before_"), F.lead("first").over(along).alias("after_"))
    size = flat.groupBy("field_id").agg(F.count("*").alias("size"))
    edges = edges.join(blocks, ["field_id", "block_"]).join(size, "field_id")
    end = F.coalesce("next_", "after_", "size")
    return edges.select("field_id", (F.col("rank_") + F.col("before_")).cast("int").alias("run"), "missing", "start", (end - F.col("start")).alias("length"))


def rle_sizes(runs: DataFrame) -> DataFrame:
    """Bytes of the run-length layout: 4 of magic, 1 for the first bit, and the runs' varints."""
    return runs.groupBy("field_id").agg((F.sum(varint_length(F.col("length"))) + 5).cast("bigint").alias("rle_bytes"), F.sum("length").alias("cells"))


def mask_bytes(cells: DataFrame) -> DataFrame:
    """(field_id, byte, value): 8 cells a byte, lowest bit first."""
    flat = numbered(cells.withColumn("missing", is_missing(F.col("value")).cast("int")))
    bit = F.expr("shiftleft(missing, cast(idx % 8 as int))")
    return flat.groupBy("field_id", F.floor(F.col("idx") / 8).alias("byte")).agg(F.sum(bit).cast("int").alias("value"))
