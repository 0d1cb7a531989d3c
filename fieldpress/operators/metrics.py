"""Profiles, predictors, residual and error metrics over cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import is_missing, with_before

COLD = 32.0
PREDICTORS = ["previous", "delta", "moving_avg", "linear", "quadratic"]


def field_stats(cells: DataFrame) -> DataFrame:
    """Counts and moments of the cells that aren't NULL or NaN; infinities count as values here."""
    v = F.when(~(F.col("value").isNull() | F.isnan("value")), F.col("value"))
    n, ok = F.count("*"), F.count(v)
    return cells.groupBy("field_id").agg(
        n.alias("n_cells"), ok.alias("n_valid"), (n - ok).alias("n_missing"), F.round(100.0 * (n - ok) / n, 6).alias("missing_pct"),
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.round(F.avg(v), 6).alias("v_mean"), F.round(F.stddev_pop(v), 6).alias("v_std"),
    )


def predictors() -> dict[str, Column]:
    """Predictions of value from value_1 ... value_4; COLD for the first cell, shorter forms until enough are there."""
    a, b, c, d = (F.col(f"value_{k}") for k in range(1, 5))
    cold = F.lit(COLD)
    mean = F.when(a.isNull(), cold).when(b.isNull(), a).when(c.isNull(), (b + a) / 2).when(d.isNull(), (c + b + a) / 3).otherwise((d + c + b + a) / 4)
    return {
        "previous": F.coalesce(a, cold),
        "delta": F.coalesce(2 * a - b, a, cold),
        "moving_avg": mean,
        "linear": F.coalesce(2 * a - b, a, cold),
        "quadratic": F.coalesce(3 * a - 3 * b + c, 2 * a - b, a, cold),
    }


def residuals(valid: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(field_id, idx, predictor, residual) of valid cells (field_id, idx, value)."""
    rules = predictors()
    df = with_before(valid.select("field_id", "idx", "value"), "value", 4)
    picked = {n: (F.col("value") - rules[n]) for n in (names or list(rules))}
    if "delta" in picked:  # subtracted in the order of the differences
        a, b = F.col("value_1"), F.col("value_2")
        picked["delta"] = F.coalesce(F.col("value") - 2 * a + b, F.col("value") - a, F.col("value") - COLD)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), e.alias("residual")) for n, e in picked.items()))).alias("r")
    return df.select("field_id", "idx", rows).select("field_id", "idx", "r.predictor", "r.residual")


def entropy(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Empirical bits per symbol of column for each key: value counts, pre-aggregated, then one sum."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n_"))
    total = F.sum("n_")
    bits = F.log2(total.cast("double")) - F.sum(F.col("n_") * F.log2(F.col("n_").cast("double"))) / total
    return counts.groupBy(*keys).agg(F.round(bits, 6).alias("entropy_bits"))


def residual_metrics(df: DataFrame, keys: list[str], column: str = "residual") -> DataFrame:
    """mae, rmse, max_abs, std, range and entropy of a residual by keys."""
    r = F.col(column)
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(r)), 6).alias("mae"), F.round(F.sqrt(F.avg(r * r)), 6).alias("rmse"),
        F.round(F.max(F.abs(r)), 6).alias("max_abs"), F.round(F.stddev_pop(r), 6).alias("std"), F.round(F.max(r) - F.min(r), 6).alias("range"),
    )
    return stats.join(entropy(df, keys, column), keys)


def quantize(residual: Column, step: float, origin: float = 0.0) -> Column:
    """Lattice symbol with the offset of 2**31: floor((r - o) / step + 1/2), clamped."""
    if step <= 0:
        raise ValueError("step must be positive")
    q = F.floor(F.greatest(F.least((residual - origin) / step + 0.5, F.lit(2147483647.0)), F.lit(-2147483647.0)))
    return q.cast("bigint") - F.lit(2147483648)


def dequantize(symbol: Column, step: float, origin: float = 0.0) -> Column:
    if step <= 0:
        raise ValueError("step must be positive")
    return (symbol + F.lit(2147483648)).cast("double") * step + origin


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, n) over equal bins from the smallest to the largest value; empty bins are left out."""
    ends = df.agg(F.min(column).alias("lo_"), ((F.max(column) - F.min(column)) / bins).alias("width_"))
    at = F.when(F.col("width_") == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo_")) / F.col("width_")), F.lit(bins - 1))).cast("int")
    return df.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def quantile(df: DataFrame, key: str, column: str, p: float, bins: int = 4096) -> DataFrame:
    """(key, quantile): that of column by linear interpolation between its order statistics, exact.

    Counts of equal bins tell in which bins the two order statistics lie; only distinct values of those bins are ranked.
    """
    df = df.select(key, F.col(column).alias("v_")).filter("v_ IS NOT NULL")
    ends = df.groupBy(key).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), ((F.count("*") - 1) * p).alias("at_"))
    width = (F.col("hi_") - F.col("lo_")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v_") - F.col("lo_")) / width), F.lit(bins - 1))).otherwise(0)
    df = df.groupBy(key, "v_").agg(F.count("*").alias("n_")).join(ends, key).withColumn("bin_", bin_)
    sizes = df.groupBy(key, "bin_").agg(F.sum("n_").alias("size_"), F.min("at_").alias("at_"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("below_", before("size_", Window.partitionBy(key).orderBy("bin_")))
    hit = sizes.filter("below_ <= ceil(at_) AND floor(at_) < below_ + size_").select(key, "bin_", "below_")
    inside = df.join(hit, [key, "bin_"]).withColumn("first_", F.col("below_") + before("n_", Window.partitionBy(key, "bin_").orderBy("v_")))
    has = lambda rank: F.max(F.when((F.col("first_") <= rank) & (rank < F.col("first_") + F.col("n_")), F.col("v_")))
    low, high = F.floor("at_"), F.ceil("at_")
    found = inside.groupBy(key).agg(has(low).alias("a_"), has(high).alias("b_"), F.min(F.col("at_") - low).alias("part_"))
    return found.select(key, (F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("part_")).alias("quantile"))


def error_metrics(pairs: DataFrame, bound: float, dtype: str = "double") -> DataFrame:
    """Accuracy of (original, decoded) where both are there; the bound is taken in the field's own type. A bound of 0 asks for nothing."""
    e = F.col("decoded").cast(dtype).cast("double") - F.col("original").cast(dtype).cast("double")
    limit = F.lit(bound).cast(dtype).cast("double")
    over = F.sum((F.abs("e_") > limit).cast("int")) if bound > 0 else F.lit(0)
    respected = (F.max(F.abs("e_")) <= limit) if bound > 0 else F.lit(True)
    errors = pairs.select("field_id", e.alias("e_"))
    stats = errors.groupBy("field_id").agg(
        F.count("*").alias("n"), F.round(F.max(F.abs("e_")), 6).alias("max_abs_error"), F.round(F.sqrt(F.avg(F.col("e_") * F.col("e_"))), 6).alias("rmse"), F.round(F.avg("e_"), 6).alias("bias"),
        over.cast("bigint").alias("violations"), respected.alias("bound_respected"),
    )
    high = quantile(errors.withColumn("e_", F.abs("e_")), "field_id", "e_", 0.99)
    return stats.join(high.select("field_id", F.round("quantile", 6).alias("p99_abs_error")), "field_id")


def sentinel_identity(pairs: DataFrame, sentinel: float) -> DataFrame:
    """(field_id, sentinel_identical): cells that hold the sentinel hold exactly it again, and no others do."""
    return pairs.groupBy("field_id").agg(F.bool_and((F.col("original") == sentinel) == F.coalesce(F.col("decoded") == sentinel, F.lit(False))).alias("sentinel_identical"))


def challenge_violations(pairs: DataFrame, bound: float) -> DataFrame:
    """Share of cells whose missing original isn't missing again, or whose valid one is off by more than the bound."""
    gone = is_missing(F.col("original"))
    bad = F.when(gone, ~is_missing(F.col("decoded"))).otherwise(~F.coalesce(F.abs(F.col("decoded") - F.col("original")) <= bound, F.lit(False)))
    return pairs.groupBy("field_id").agg(F.round(F.avg(bad.cast("double")), 9).alias("violation_share"))


def error_field(pairs: DataFrame) -> DataFrame:
    both = is_missing(F.col("original")) & is_missing(F.col("decoded"))
    return pairs.withColumn("error", F.when(both, 0.0).otherwise(F.col("decoded") - F.col("original")))


def size_metrics(streams: DataFrame) -> DataFrame:
    """Ratio, reduction and bits per cell (valid or not) of encoded streams by field."""
    size, raw = F.sum(F.octet_length("container")), F.sum("uncompressed_size")
    return streams.groupBy("field_id", "error_bound").agg(
        size.cast("bigint").alias("compressed_bytes"), (raw / size).alias("cr"), (100.0 * (1 - size / raw)).alias("reduction_pct"),
        (8.0 * size / F.sum(F.col("nt").cast("long") * F.col("ny") * F.col("nx"))).alias("bits_per_value"), F.max("max_abs_error").alias("max_abs_error"), F.sum("n_repaired").alias("n_repaired"), F.sum("payload_size").alias("payload_bytes"),
    )
