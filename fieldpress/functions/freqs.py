"""Frequency tables that sum to exactly 65536, in closed form: as a DataFrame per context, and in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE_BITS = 16
SCALE = 1 << SCALE_BITS


def normalize_np(counts: np.ndarray) -> np.ndarray:
    """Present symbols get at least 1. What is missing to SCALE is dealt out, or taken back, in rounds over the symbols by falling count."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.int64)
    total = int(counts.sum())
    if not total:
        return out
    present = np.flatnonzero(counts)
    order = present[np.argsort(-counts[present], kind="stable")]
    f = np.maximum(1, counts[order] * SCALE // total)
    need = SCALE - int(f.sum())
    if need >= 0:
        f += need // len(f) + (np.arange(len(f)) < need % len(f))
    else:
        need, low, high = -need, 0, int(f.max())
        while low < high:  # the largest number of whole rounds
            k = (low + high + 1) // 2
            low, high = (k, high) if int(np.minimum(f - 1, k).sum()) <= need else (low, k - 1)
        need -= int(np.minimum(f - 1, low).sum())
        f = np.maximum(1, f - low)
        f[np.flatnonzero(f > 1)[:need]] -= 1
    out[order] = f
    return out


def normalize(counts: DataFrame, keys: list[str], symbol: str, count: str) -> DataFrame:
    """Adds ``freq`` to counts. The tables of all keys are made at once; rounds taken back are bounded by the table's surplus.

    A table with more present symbols than can be served by floors alone gives back in rounds; their number is
    found by a running sum over the distinct excess values instead of a loop.
    """
    per = Window.partitionBy(*keys)
    rank = Window.partitionBy(*keys).orderBy(F.col(count).desc(), symbol)
    df = counts.withColumn("f0", F.expr(f"greatest(1L, {count} * {SCALE}L div sum({count}) over (partition by {', '.join(keys)}))"))
    df = df.withColumns({"r": F.row_number().over(rank) - 1, "size_": F.count("*").over(per), "need": SCALE - F.sum("f0").over(per)})
    # Rounds to take back: sum(min(f0 - 1, k)) is piecewise linear in k; at each distinct excess it is known.
    up = Window.partitionBy(*keys).orderBy("f0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"below": F.sum(F.col("f0") - 1).over(up), "upto": F.count("*").over(up)})
    taken = F.col("below") + (F.col("size_") - F.col("upto")) * (F.col("f0") - 1)  # sum(min(f0 - 1, k)) at k = this excess
    fits = F.when(taken <= -F.col("need"), F.struct(F.col("f0"), F.col("below"), F.col("upto")))
    df = df.withColumn("edge", F.max(fits).over(per))
    k = F.expr("coalesce(edge.f0 - 1, 0L)")
    spent = F.expr("coalesce(edge.below + (size_ - edge.upto) * (edge.f0 - 1), 0L)")
    rest = F.expr("size_ - coalesce(edge.upto, 0L)")
    df = df.withColumns({"k0": k, "spent": spent, "rest": rest})
    df = df.withColumn("k", F.expr("k0 + case when need < 0 and rest > 0 then (-need - spent) div rest else 0L end"))
    df = df.withColumn("f1", F.expr("case when need < 0 then greatest(1L, f0 - k) else f0 + need div size_ + case when r < need % size_ then 1 else 0 end end"))
    df = df.withColumn("left", F.expr(f"case when need < 0 then -need - sum(least(f0 - 1, k)) over (partition by {', '.join(keys)}) else 0L end"))
    last = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("q", F.sum((F.col("f1") > 1).cast("int")).over(last))
    df = df.withColumn("freq", (F.col("f1") - F.when((F.col("need") < 0) & (F.col("f1") > 1) & (F.col("q") <= F.col("left")), 1).otherwise(0)).cast("bigint"))
    return df.select(*counts.columns, "freq")
