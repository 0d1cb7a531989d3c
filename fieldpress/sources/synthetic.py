"""Synthetic fields: a smooth wave in space and time, noise, and a mask of a strip and scattered cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the wave: mean, amplitude, phase per step, share of it along x, noise, shares of the mask.
MEAN, AMPLITUDE, PHASE, SKEW, NOISE, STRIP, SCATTER = 25.0, 12.0, 0.35, 0.5, 0.8, 0.8, 0.35


def synthetic_array(shape: tuple[int, int, int], seed: int = 42, missing: float = 0.12) -> np.ndarray:
    """float32, NaN where missing. Draws: noise of each step in turn, then the scatter."""
    nt, ny, nx = shape
    rng = np.random.default_rng(seed)
    y, x = np.linspace(0, math.pi, ny)[:, None], np.linspace(0, 2 * math.pi, nx)
    planes = [MEAN + AMPLITUDE * np.sin(y + PHASE * t) * np.cos(x - SKEW * PHASE * t) + rng.normal(0, NOISE, (ny, nx)) for t in range(nt)]
    field = np.array(planes, np.float32)
    if missing > 0:
        field[:, : max(1, int(ny * missing * STRIP))] = np.nan
        field[rng.random(shape) > 1 - missing * SCATTER] = np.nan
    return field


def synthetic_wave(spark: SparkSession, shape: tuple[int, int, int], field_id: str = "wave") -> DataFrame:
    """The wave without noise or mask as cells, for any number of cells: nothing but expressions."""
    nt, ny, nx = shape
    cells = spark.range(nt * ny * nx).select((F.col("id") / (ny * nx)).cast("int").alias("t"), ((F.col("id") / nx) % ny).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
    phase = PHASE * F.col("t")
    y, x = F.col("y") * (math.pi / max(ny - 1, 1)), F.col("x") * (2 * math.pi / max(nx - 1, 1))
    return cells.select(F.lit(field_id).alias("field_id"), "t", "y", "x", (MEAN + AMPLITUDE * F.sin(y + phase) * F.cos(x - SKEW * phase)).alias("value"))
