"""Every query of the engine by name, with the SQL that must give the same rows.

Queries run on the events grid: day x hour x (user_id % 32), the largest value in each cell, 65 % of them missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import derive_step
from ..functions.freqs import normalize
from ..functions.ints import unzigzag, varint_hex, varint_length, zigzag
from ..operators import codec, grid, metrics

BOUND = 0.05
STEP = derive_step(BOUND, "float64")
SLICE = 2  # days of a tile: the scan of each starts cold, so that tiles are scanned side by side, by Spark and in SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """
g AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, hour(ts)::INT AS y, (user_id % 32)::INT AS x, max(value)::DOUBLE AS value FROM events GROUP BY ALL),
cells AS (SELECT t, y, x, value FROM (SELECT * FROM (SELECT unnest(range((SELECT max(t) + 1 FROM g)))::INT AS t), (SELECT unnest(range(24))::INT AS y), (SELECT unnest(range(32))::INT AS x)) LEFT JOIN g USING (t, y, x)),
valid AS (SELECT *, row_number() OVER (ORDER BY t, y, x) - 1 AS idx FROM cells WHERE value IS NOT NULL)"""

RESIDUALS = f"""{BASE},
lagged AS (SELECT idx, value AS v, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c, lag(value, 4) OVER w AS d FROM valid WINDOW w AS (ORDER BY idx)),
res AS (SELECT idx, 'previous' AS predictor, v - coalesce(a, 32) AS residual FROM lagged
  UNION ALL SELECT idx, 'delta', coalesce(v - 2 * a + b, v - a, v - 32) FROM lagged
  UNION ALL SELECT idx, 'moving_avg', v - CASE WHEN a IS NULL THEN 32 WHEN b IS NULL THEN a WHEN c IS NULL THEN (b + a) / 2 WHEN d IS NULL THEN (c + b + a) / 3 ELSE (d + c + b + a) / 4 END FROM lagged
  UNION ALL SELECT idx, 'linear', v - coalesce(2 * a - b, a, 32) FROM lagged
  UNION ALL SELECT idx, 'quadratic', v - coalesce(3 * a - 3 * b + c, 2 * a - b, a, 32) FROM lagged)"""

SYMBOLS = f"""{RESIDUALS},
sym AS (SELECT idx, floor(residual * (1 / {STEP!r}::DOUBLE) + 0.5)::BIGINT AS symbol FROM res WHERE predictor = 'previous'),
zz AS (SELECT idx, symbol, CASE WHEN symbol < 0 THEN -2 * symbol - 1 ELSE 2 * symbol END AS z FROM sym)"""

STATS = """count(*) AS n, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual * residual)), 6) AS rmse, round(max(abs(residual)), 6) AS max_abs,
  round(stddev_pop(residual), 6) AS std, round(max(residual) - min(residual), 6) AS range"""

RUNS = f"""{BASE},
flat AS (SELECT row_number() OVER (ORDER BY t, y, x) - 1 AS idx, (value IS NULL)::INT AS missing FROM cells),
edge AS (SELECT idx, missing FROM (SELECT *, lag(missing) OVER (ORDER BY idx) AS before FROM flat) WHERE before IS NULL OR missing <> before),
runs AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS run, missing, idx AS start, lead(idx, 1, (SELECT count(*) FROM cells)) OVER (ORDER BY idx) - idx AS length FROM edge)"""

def _scan_sql(value: str, step: float) -> str:
    """The scan, cell by cell, of each tile of SLICE days: a recursion in which r holds a tile's reconstruction so far."""
    lattice = f"{step!r}::DOUBLE"
    return f"""WITH RECURSIVE {BASE.strip()},
seq AS (SELECT t // {SLICE} AS c, row_number() OVER (PARTITION BY t // {SLICE} ORDER BY t, y, x) - 1 AS k, t, y, x, {value} AS value FROM cells),
rec(c, k, t, y, x, q, recon, r) AS (
  SELECT DISTINCT c, -1::BIGINT, 0, 0, 0, NULL::DOUBLE, NULL::DOUBLE, []::DOUBLE[] FROM seq
  UNION ALL
  SELECT c, k, t, y, x, CASE WHEN value IS NOT NULL THEN q END, CASE WHEN value IS NOT NULL THEN p + q * {lattice} END, list_append(r, CASE WHEN value IS NULL THEN 0 ELSE p + q * {lattice} END)
  FROM (SELECT *, floor((value - p) * (1 / {lattice}) + 0.5) AS q FROM (
    SELECT *, CASE WHEN w > 0 THEN (8 * l + 2 * u + ul + ur + b) / w ELSE 32 END AS p FROM (
      SELECT *, (8 * (l <> 0)::INT + 2 * (u <> 0)::INT + (ul <> 0)::INT + (ur <> 0)::INT + (b <> 0)::INT)::DOUBLE AS w FROM (
        SELECT s.c, s.k, s.t, s.y, s.x, s.value, rec.r AS r,
          CASE WHEN s.x > 0 THEN rec.r[s.k] ELSE 0 END AS l, CASE WHEN s.y > 0 THEN rec.r[s.k - 31] ELSE 0 END AS u,
          CASE WHEN s.x > 0 AND s.y > 0 THEN rec.r[s.k - 32] ELSE 0 END AS ul, CASE WHEN s.x < 31 AND s.y > 0 THEN rec.r[s.k - 30] ELSE 0 END AS ur,
          CASE WHEN s.t % {SLICE} > 0 THEN rec.r[s.k - 767] ELSE 0 END AS b
        FROM rec JOIN seq s ON s.c = rec.c AND s.k = rec.k + 1)))))"""


SCAN = _scan_sql("value", STEP)
STEP32 = derive_step(BOUND, "float32")
SCAN32 = _scan_sql("value::FLOAT::DOUBLE", STEP32)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.events_grid(spark.read.parquet(f"{d}/events.parquet"))


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return grid.valid_index(_cells(spark, d))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.residuals(_valid(spark, d), ["previous"])
    return r.select("field_id", "idx", F.floor(F.col("residual") * (1 / STEP) + 0.5).alias("symbol"))


def _zigzags(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).withColumn("z", zigzag(F.col("symbol")))


def _tiles(spark, d):
    """The grid as a field for each SLICE days, with t from 0 in each."""
    tile = F.floor(F.col("t") / SLICE)
    return _cells(spark, d).withColumns({"field_id": tile.cast("string"), "t": (F.col("t") - tile * SLICE).cast("int")})


def _day():
    return (F.col("field_id").cast("int") * SLICE + F.col("t")).cast("int").alias("t")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each cell and what the codec's streams of the tiles give back for it."""
    back = codec.decode_streams(codec.encode_cells(_tiles(spark, d), BOUND, 24, 32, dtype="float64"))
    back = back.select(_day(), "y", "x", F.when(~F.col("missing"), F.col("value")).alias("decoded"))
    return _cells(spark, d).withColumnRenamed("value", "original").join(back, ["t", "y", "x"], "left")


PAIRS = f"""{SCAN.removeprefix("WITH ")},
pairs AS (SELECT s.t, s.y, s.x, s.value AS original, CASE WHEN abs(s.value - recon) > {BOUND}::DOUBLE THEN s.value ELSE recon END AS decoded FROM seq s LEFT JOIN rec USING (c, k))"""


# ---------------------------------------------------------------- masks and profiles
@query(f"""WITH {BASE} SELECT count(*) AS n_cells, count(value) AS n_valid, count(*) - count(value) AS n_missing, round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 6) AS missing_pct,
min(value) AS v_min, max(value) AS v_max, round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std FROM cells""")
def field_stats(spark, d):
    return metrics.field_stats(_cells(spark, d)).drop("field_id")


@query(f"WITH {BASE} SELECT t, y, x, value IS NULL AS missing FROM cells")
def missing_mask(spark, d):
    return _cells(spark, d).select("t", "y", "x", grid.is_missing(F.col("value")).alias("missing"))


@query(f"WITH {BASE} SELECT t, round(avg((value IS NULL)::INT), 9) AS missing_fraction FROM cells GROUP BY t")
def missing_by_time(spark, d):
    return _cells(spark, d).groupBy("t").agg(F.round(F.avg(grid.is_missing(F.col("value")).cast("int")), 9).alias("missing_fraction"))


@query(f"""WITH {BASE}, m AS (SELECT avg((value IS NULL)::INT) AS f FROM cells GROUP BY t)
SELECT count(*) AS n, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS std, round(min(f), 6) AS low, round(quantile_cont(f, 0.25), 6) AS q25, round(quantile_cont(f, 0.5), 6) AS q50, round(quantile_cont(f, 0.75), 6) AS q75, round(max(f), 6) AS high FROM m""")
def missing_summary(spark, d):
    m = _cells(spark, d).groupBy("t").agg(F.avg(grid.is_missing(F.col("value")).cast("int")).alias("f"))
    q = [F.round(F.expr(f"percentile(f, {p})"), 6).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return m.agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean"), F.round(F.stddev_samp("f"), 6).alias("std"), F.round(F.min("f"), 6).alias("low"), *q, F.round(F.max("f"), 6).alias("high"))


@query(f"""WITH {BASE} SELECT max(t) + 1 AS nt, max(y) + 1 AS ny, max(x) + 1 AS nx, 'float64' AS dtype, 8 * count(*) AS bytes, round(count(*) * 8 / 1e6, 6) AS mb,
round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 6) AS missing_pct, min(value) AS low, max(value) AS high FROM cells""")
def dataset_summary(spark, d):
    n, size = F.count("*"), {f"n{c}": (F.max(c) + 1).alias(f"n{c}") for c in "tyx"}
    return _cells(spark, d).agg(*size.values(), F.lit("float64").alias("dtype"), (8 * n).alias("bytes"), F.round(n * 8 / 1e6, 6).alias("mb"), F.round(100.0 * (n - F.count("value")) / n, 6).alias("missing_pct"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH {PAIRS} SELECT bool_and((coalesce(original, -999) = -999) = (coalesce(decoded, -999) = -999)) AS sentinel_identical FROM pairs")
def sentinel_identity(spark, d):
    p = _pairs(spark, d).withColumns({c: F.coalesce(c, F.lit(-999.0)) for c in ("original", "decoded")})
    return metrics.sentinel_identity(p, -999.0).drop("field_id")


@query(f"WITH {BASE} SELECT t, y, x, idx, value FROM valid")
def valid_index(spark, d):
    return _valid(spark, d).select("t", "y", "x", "idx", "value")


@query(f"WITH {BASE} SELECT t, y, x, coalesce(value, -999.0) AS value FROM cells")
def restore_sentinel(spark, d):
    return grid.restore_missing(_cells(spark, d).withColumn("missing", grid.is_missing(F.col("value"))), -999.0).select("t", "y", "x", "value")


@query(f"WITH {RUNS} SELECT run, missing, start, length FROM runs")
def mask_runs(spark, d):
    return grid.mask_runs(_cells(spark, d)).drop("field_id")


VARINT_LEN = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
HEX2 = "printf('%02X', {0})"
VARINT_HEX = (
    "CASE WHEN {0} < 128 THEN printf('%02X', {0}) WHEN {0} < 16384 THEN printf('%02X%02X', {0} % 128 + 128, {0} // 128)"
    " WHEN {0} < 2097152 THEN printf('%02X%02X%02X', {0} % 128 + 128, ({0} // 128) % 128 + 128, {0} // 16384)"
    " ELSE printf('%02X%02X%02X%02X', {0} % 128 + 128, ({0} // 128) % 128 + 128, ({0} // 16384) % 128 + 128, {0} // 2097152) END"
)


@query(f"WITH {RUNS} SELECT run, {VARINT_HEX.format('length')} AS code FROM runs")
def mask_rle_hex(spark, d):
    return grid.mask_runs(_cells(spark, d)).select("run", varint_hex(F.col("length")).alias("code"))


@query(f"WITH {RUNS} SELECT (5 + sum({VARINT_LEN.format('length')}))::BIGINT AS rle_bytes, sum(length)::BIGINT AS cells FROM runs")
def rle_size(spark, d):
    return grid.rle_sizes(grid.mask_runs(_cells(spark, d))).drop("field_id")


@query(f"WITH {RUNS} SELECT idx // 8 AS byte, sum(missing << (idx % 8)::INT)::INT AS value FROM flat GROUP BY ALL")
def mask_bitpack(spark, d):
    return grid.mask_bytes(_cells(spark, d)).drop("field_id")


@query(f"""WITH {RUNS}, s AS (SELECT (5 + sum({VARINT_LEN.format('length')}))::BIGINT AS rle_bytes, ((sum(length) + 7) // 8)::BIGINT AS bit_bytes FROM runs)
SELECT rle_bytes, bit_bytes, CASE WHEN rle_bytes < bit_bytes THEN 'rle' ELSE 'bits' END AS layout, least(rle_bytes, bit_bytes) AS mask_bytes FROM s""")
def mask_choice(spark, d):
    bits = F.expr("(cells + 7) div 8")
    s = grid.rle_sizes(grid.mask_runs(_cells(spark, d))).select("rle_bytes", bits.alias("bit_bytes"))
    return s.select("*", F.when(F.col("rle_bytes") < F.col("bit_bytes"), "rle").otherwise("bits").alias("layout"), F.least("rle_bytes", "bit_bytes").alias("mask_bytes"))


@query(f"""WITH {RUNS}, turned AS (SELECT row_number() OVER (ORDER BY y, x, t) - 1 AS idx, (value IS NULL)::INT AS missing FROM cells),
e2 AS (SELECT idx FROM (SELECT *, lag(missing) OVER (ORDER BY idx) AS before FROM turned) WHERE before IS NULL OR missing <> before),
r2 AS (SELECT lead(idx, 1, (SELECT count(*) FROM cells)) OVER (ORDER BY idx) - idx AS length FROM e2)
SELECT 'bytes' AS layout, (SELECT count(*) FROM cells) AS bytes UNION ALL SELECT 'bits', (SELECT (count(*) + 7) // 8 FROM cells)
UNION ALL SELECT 'rle_time_lat_lon', (SELECT 5 + sum({VARINT_LEN.format('length')}) FROM runs)::BIGINT UNION ALL SELECT 'rle_lat_lon_time', (SELECT 5 + sum({VARINT_LEN.format('length')}) FROM r2)::BIGINT""")
def mask_candidates(spark, d):
    cells = _cells(spark, d)
    n = cells.agg(F.count("*").alias("n"))
    plain = n.select(F.explode(F.array(F.struct(F.lit("bytes").alias("layout"), F.col("n").alias("bytes")), F.struct(F.lit("bits").alias("layout"), F.expr("(n + 7) div 8").alias("bytes")))).alias("r")).select("r.*")
    turned = cells.select("field_id", F.col("y").alias("t"), F.col("x").alias("y"), F.col("t").alias("x"), "value")
    sizes = [grid.rle_sizes(grid.mask_runs(c)).select(F.lit(name).alias("layout"), F.col("rle_bytes").alias("bytes")) for name, c in (("rle_time_lat_lon", cells), ("rle_lat_lon_time", turned))]
    return plain.unionByName(sizes[0]).unionByName(sizes[1])


@query(f"WITH {PAIRS} SELECT bool_and((original IS NULL) = (decoded IS NULL)) AS identical FROM pairs")
def mask_identity(spark, d):
    return _pairs(spark, d).agg(F.bool_and(grid.is_missing(F.col("original")) == grid.is_missing(F.col("decoded"))).alias("identical"))


# ---------------------------------------------------------------- predictors and residuals
def _predictor(name: str):
    def run(spark, d):
        return metrics.residuals(_valid(spark, d), [name]).select("idx", F.round("residual", 6).alias("residual"))

    run.__name__ = f"pred_{name}"
    query(f"WITH {RESIDUALS} SELECT idx, round(residual, 6) AS residual FROM res WHERE predictor = '{name}'")(run)


for _name in metrics.PREDICTORS:
    _predictor(_name)

ENTROPY = """ent AS (SELECT predictor, round(log2(sum(k)::DOUBLE) - sum(k * log2(k::DOUBLE)) / sum(k), 6) AS entropy_bits FROM (SELECT predictor, symbol, count(*) AS k FROM qs GROUP BY ALL) GROUP BY predictor)"""
QUANTIZED = f"{RESIDUALS}, qs AS (SELECT idx, predictor, floor(residual * (1 / {STEP!r}::DOUBLE) + 0.5)::BIGINT AS symbol FROM res), {ENTROPY}"


@query(f"WITH {RESIDUALS} SELECT predictor, {STATS} FROM res GROUP BY predictor")
def residual_metrics(spark, d):
    return metrics.residual_metrics(metrics.residuals(_valid(spark, d)), ["predictor"]).drop("entropy_bits")


def _quantized(spark, d):
    return metrics.residuals(_valid(spark, d)).withColumn("symbol", F.floor(F.col("residual") * (1 / STEP) + 0.5))


@query(f"WITH {QUANTIZED} SELECT predictor, entropy_bits FROM ent")
def residual_entropy(spark, d):
    return metrics.entropy(_quantized(spark, d), ["predictor"], "symbol")


@query(f"WITH {QUANTIZED} SELECT predictor, entropy_bits, row_number() OVER (ORDER BY entropy_bits, predictor)::INT AS place FROM ent")
def predictor_ranking(spark, d):
    e = metrics.entropy(_quantized(spark, d), ["predictor"], "symbol")  # one row per predictor
    return e.withColumn("place", F.row_number().over(Window.orderBy("entropy_bits", "predictor")))


@query(f"""WITH {RESIDUALS}, c AS (SELECT count(*) AS n FROM valid),
p AS (SELECT CASE WHEN idx < n // 2 THEN 'train' WHEN idx < 3 * n // 4 THEN 'validation' ELSE 'test' END AS part, residual FROM res, c WHERE predictor = 'previous') SELECT part, {STATS} FROM p GROUP BY part""")
def partition_metrics(spark, d):
    r = metrics.residuals(_valid(spark, d), ["previous"])
    n = r.groupBy("field_id").agg(F.count("*").alias("n"))
    part = F.expr("case when idx < n div 2 then 'train' when idx < 3 * n div 4 then 'validation' else 'test' end")
    return metrics.residual_metrics(r.join(n, "field_id").withColumn("part", part), ["part"]).drop("entropy_bits")


@query(f"""WITH {RESIDUALS}, p AS (SELECT residual FROM res WHERE predictor = 'previous'), e AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 100 AS w FROM p)
SELECT least(floor((residual - lo) / w), 99)::INT AS bin, count(*) AS n FROM p, e GROUP BY ALL""")
def residual_histogram(spark, d):
    return metrics.histogram(metrics.residuals(_valid(spark, d), ["previous"]), "residual")


@query(f"WITH {RESIDUALS} SELECT idx, floor(residual / {STEP!r}::DOUBLE + 0.5)::BIGINT - 2147483648 AS symbol FROM res WHERE predictor = 'previous'")
def quantize(spark, d):
    return metrics.residuals(_valid(spark, d), ["previous"]).select("idx", metrics.quantize(F.col("residual"), STEP).alias("symbol"))


@query(f"WITH {RESIDUALS} SELECT idx, round(floor(residual / {STEP!r}::DOUBLE + 0.5) * {STEP!r}::DOUBLE, 6) AS residual FROM res WHERE predictor = 'previous'")
def dequantize(spark, d):
    q = metrics.residuals(_valid(spark, d), ["previous"]).select("idx", metrics.quantize(F.col("residual"), STEP).alias("symbol"))
    return q.select("idx", F.round(metrics.dequantize(F.col("symbol"), STEP), 6).alias("residual"))


@query(f"SELECT 'float32' AS dtype, {derive_step(0.05)!r}::DOUBLE AS step, {derive_step(0.05) / 2!r}::DOUBLE AS half UNION ALL SELECT 'float64', 2 * greatest(0.05::DOUBLE, 2.220446049250313e-16), greatest(0.05::DOUBLE, 2.220446049250313e-16)")
def derived_step(spark, d):
    rows = spark.createDataFrame([("float32", 2.0**-23), ("float64", 2.0**-52)], "dtype string, eps double")
    return rows.select("dtype", (2 * F.greatest(F.lit(BOUND), "eps")).alias("step"), F.greatest(F.lit(BOUND), "eps").alias("half"))


# ---------------------------------------------------------------- the scan
@query(f"{SCAN} SELECT t, y, x, q::BIGINT AS symbol FROM rec WHERE q IS NOT NULL")
def scan_symbols(spark, d):
    return codec.scan_cells(_tiles(spark, d), BOUND, 24, 32).select(_day(), "y", "x", "symbol")


@query(f"{SCAN} SELECT t, y, x, recon FROM rec WHERE q IS NOT NULL")
def scan_recon(spark, d):
    return codec.scan_cells(_tiles(spark, d), BOUND, 24, 32).select(_day(), "y", "x", "recon")


@query(f"{SCAN32} SELECT t, y, x, q::BIGINT AS symbol, recon FROM rec WHERE q IS NOT NULL")
def scan_float32(spark, d):
    return codec.scan_cells(_tiles(spark, d), BOUND, 24, 32, dtype="float32").select(_day(), "y", "x", "symbol", "recon")


@query(f"{SCAN} SELECT s.t, s.y, s.x, q IS NULL AS missing, CASE WHEN abs(s.value - recon) > 0.05::DOUBLE THEN s.value ELSE recon END AS value FROM rec JOIN seq s USING (c, k)")
def scan_decode(spark, d):
    streams = codec.encode_cells(_tiles(spark, d), BOUND, 24, 32, dtype="float64")
    cells = codec.decode_streams(streams)
    return cells.select(_day(), "y", "x", "missing", F.when(~F.col("missing"), F.col("value")).alias("value"))


@query(f"{SCAN32} SELECT s.t, s.y, s.x, q IS NULL AS missing, CASE WHEN abs(s.value - recon::FLOAT::DOUBLE) > 0.05::FLOAT::DOUBLE THEN s.value ELSE recon::FLOAT::DOUBLE END AS value FROM rec JOIN seq s USING (c, k)")
def stream_float32(spark, d):
    """Streams in the default type, decoded again, with their repairs."""
    cells = codec.decode_streams(codec.encode_cells(_tiles(spark, d), BOUND, 24, 32))
    return cells.select(_day(), "y", "x", "missing", F.when(~F.col("missing"), F.col("value")).alias("value"))


@query(f"{SCAN}, ranked AS (SELECT q FROM rec WHERE q IS NOT NULL), k AS (SELECT q, count(*) AS n FROM ranked GROUP BY q) SELECT sum(n)::BIGINT AS n, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS entropy_bits FROM k")
def pred_stencil(spark, d):
    s = codec.scan_cells(_tiles(spark, d), BOUND, 24, 32).withColumn("field_id", F.lit("events"))
    return s.groupBy("field_id").agg(F.count("*").alias("n")).join(metrics.entropy(s, ["field_id"], "symbol"), "field_id").drop("field_id")


# The same as one field of all days: what the recursive SQL is too slow for. Tests compare them with the walk.
@query()
def scan_symbols_all(spark, d):
    return codec.scan_cells(_cells(spark, d), BOUND, 24, 32).select("t", "y", "x", "symbol")


@query()
def scan_recon_all(spark, d):
    return codec.scan_cells(_cells(spark, d), BOUND, 24, 32).select("t", "y", "x", "recon")


@query()
def scan_decode_all(spark, d):
    cells = codec.decode_streams(codec.encode_cells(_cells(spark, d), BOUND, 24, 32, dtype="float64"))
    return cells.select("t", "y", "x", "missing", F.when(~F.col("missing"), F.col("value")).alias("value"))


@query()
def pred_stencil_all(spark, d):
    s = codec.scan_cells(_cells(spark, d), BOUND, 24, 32)
    return s.groupBy("field_id").agg(F.count("*").alias("n")).join(metrics.entropy(s, ["field_id"], "symbol"), "field_id").drop("field_id")


# ---------------------------------------------------------------- accuracy
ERRORS = "abs(decoded - original)"


@query(f"""WITH {PAIRS} SELECT count(*) AS n, round(max({ERRORS}), 6) AS max_abs_error, round(sqrt(avg((decoded - original) ** 2)), 6) AS rmse, round(avg(decoded - original), 6) AS bias,
(count(*) FILTER ({ERRORS} > 0.03::DOUBLE))::BIGINT AS violations, max({ERRORS}) <= 0.03::DOUBLE AS bound_respected, round(quantile_cont({ERRORS}, 0.99), 6) AS p99_abs_error FROM pairs WHERE original IS NOT NULL""")
def error_metrics(spark, d):
    return metrics.error_metrics(_pairs(spark, d).filter("original IS NOT NULL"), 0.03).drop("field_id")


@query(f"WITH {PAIRS} SELECT round(quantile_cont({ERRORS}, 0.99), 6) AS p99 FROM pairs WHERE original IS NOT NULL")
def p99_error(spark, d):
    errors = _pairs(spark, d).filter("original IS NOT NULL").select("field_id", F.abs(F.col("decoded") - F.col("original")).alias("error"))
    return metrics.quantile(errors, "field_id", "error", 0.99).select(F.round("quantile", 6).alias("p99"))


@query(f"WITH {PAIRS} SELECT t, y, x, original AS value FROM pairs WHERE {ERRORS} > 0.03::DOUBLE")
def violations(spark, d):
    return _pairs(spark, d).filter(F.abs(F.col("decoded") - F.col("original")) > 0.03).select("t", "y", "x", F.col("original").alias("value"))


@query(f"WITH {PAIRS} SELECT t, y, x, CASE WHEN {ERRORS} > 0.03::DOUBLE THEN original ELSE decoded END AS value FROM pairs")
def repairs(spark, d):
    p = _pairs(spark, d)
    fixes = p.filter(F.abs(F.col("decoded") - F.col("original")) > 0.03).select("field_id", "t", "y", "x", F.col("original").alias("exact"))
    return p.join(fixes, ["field_id", "t", "y", "x"], "left").select("t", "y", "x", F.coalesce("exact", "decoded").alias("value"))


@query(f"WITH {PAIRS} SELECT round(avg(CASE WHEN original IS NULL THEN (decoded IS NOT NULL)::INT ELSE (NOT {ERRORS} <= 0.03::DOUBLE)::INT END), 9) AS violation_share FROM pairs")
def challenge_violations(spark, d):
    return metrics.challenge_violations(_pairs(spark, d), 0.03).drop("field_id")


@query(f"WITH {PAIRS} SELECT t, y, x, round(CASE WHEN original IS NULL AND decoded IS NULL THEN 0 ELSE decoded - original END, 6) + 0 AS error FROM pairs")
def error_field(spark, d):
    return metrics.error_field(_pairs(spark, d)).select("t", "y", "x", (F.round("error", 6) + F.lit(0.0)).alias("error"))  # no negative zeros


# ---------------------------------------------------------------- integers, tables, decisions
@query(f"WITH {SYMBOLS} SELECT idx, symbol, z FROM zz")
def zigzags(spark, d):
    return _zigzags(spark, d).drop("field_id")


@query(f"WITH {SYMBOLS} SELECT idx, symbol FROM zz")
def unzigzags(spark, d):
    return _zigzags(spark, d).select("idx", unzigzag(F.col("z")).alias("symbol"))


@query(f"WITH {SYMBOLS} SELECT idx, {VARINT_LEN.format('z')} AS length FROM zz")
def varint_len(spark, d):
    return _zigzags(spark, d).select("idx", varint_length(F.col("z")).alias("length"))


@query(f"WITH {SYMBOLS} SELECT idx, {VARINT_HEX.format('z')} AS code FROM zz")
def varint_codes(spark, d):
    return _zigzags(spark, d).select("idx", varint_hex(F.col("z")).alias("code"))


@query(f"WITH {SYMBOLS} SELECT sum({VARINT_LEN.format('z')})::BIGINT AS bytes FROM zz")
def varint_size(spark, d):
    return _zigzags(spark, d).agg(F.sum(varint_length(F.col("z"))).alias("bytes"))


WIDTH = "CASE WHEN low >= -128 AND high <= 127 THEN 1 WHEN low >= -32768 AND high <= 32767 THEN 2 WHEN low >= -2147483648 AND high <= 2147483647 THEN 4 ELSE 8 END"


@query(f"WITH {SYMBOLS} SELECT block, n, low, high, {WIDTH} AS width FROM (SELECT idx // 2048 AS block, count(*) AS n, min(symbol) AS low, max(symbol) AS high FROM sym GROUP BY ALL)")
def block_width(spark, d):
    s = _symbols(spark, d).groupBy(F.floor(F.col("idx") / 2048).alias("block")).agg(F.count("*").alias("n"), F.min("symbol").alias("low"), F.max("symbol").alias("high"))
    return s.withColumn("width", F.expr(WIDTH))


CONTEXT = f"{SYMBOLS}, cx AS (SELECT symbol, CASE WHEN p <= 1 THEN 0 WHEN p <= 8 THEN 1 ELSE 2 END AS ctx FROM (SELECT symbol, abs(lag(symbol, 1, 0) OVER (ORDER BY idx)) AS p FROM sym)), cc AS (SELECT ctx, symbol, count(*) AS n FROM cx GROUP BY ALL)"


def _contexts(spark, d):
    before = F.abs(F.coalesce("symbol_1", F.lit(0)))
    s = grid.with_before(_symbols(spark, d), "symbol", 1)
    return s.withColumn("ctx", F.when(before <= 1, 0).when(before <= 8, 1).otherwise(2)).groupBy("ctx", "symbol").agg(F.count("*").alias("n"))


@query(f"WITH {CONTEXT} SELECT ctx, symbol, n FROM cc")
def context_counts(spark, d):
    return _contexts(spark, d)


# Contexts here have few symbols: what is missing to 65536 is never negative, and dealt out in order of (-n, symbol).
@query(f"""WITH {CONTEXT}, f AS (SELECT *, greatest(1, n * 65536 // (sum(n) OVER (PARTITION BY ctx))::BIGINT) AS f0, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, symbol) - 1 AS r, count(*) OVER (PARTITION BY ctx) AS k FROM cc),
h AS (SELECT *, 65536 - (sum(f0) OVER (PARTITION BY ctx))::BIGINT AS need FROM f)
SELECT ctx, symbol, n, (f0 + need // k + CASE WHEN r < need % k THEN 1 ELSE 0 END)::BIGINT AS freq FROM h""")
def freq_normalized(spark, d):
    return normalize(_contexts(spark, d), ["ctx"], "symbol", "n")


@query(f"""WITH {CONTEXT}, t AS (SELECT ctx, sum(n) AS total, sum(n * log2(n::DOUBLE)) AS nl, count(*) AS used FROM cc GROUP BY ctx)
SELECT round(sum(total * log2(total::DOUBLE) - nl) / 8 + 44 + (sum(total)::BIGINT // 2048) + 3 * sum(used), 3)::DOUBLE AS bytes FROM t""")
def ctx_size_estimate(spark, d):
    t = _contexts(spark, d).groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nl"), F.count("*").alias("used"))
    bits = F.sum(F.col("total") * F.log2(F.col("total").cast("double")) - F.col("nl"))
    return t.agg(F.round(bits / 8 + 44 + F.expr("sum(total) div 2048") + 3 * F.sum("used"), 3).alias("bytes"))


BYTES = " UNION ALL ".join(f"SELECT block, z >> {7 * k} & 127 | CASE WHEN length > {k + 1} THEN 128 ELSE 0 END AS byte FROM coded WHERE length > {k}" for k in range(10))
#: The choice between RANGE and RAW: up to four times the byte table is made from the blocks chosen so far, and the choice again from the table.
DECIDED = f"""{SYMBOLS},
coded AS (SELECT idx // 2048 AS block, z, {VARINT_LEN.format("z")} AS length FROM zz),
h AS (SELECT block, byte, count(*) AS n FROM ({BYTES}) GROUP BY ALL),
raw AS (SELECT block, n * {WIDTH} AS raw_bytes FROM (SELECT idx // 2048 AS block, count(*) AS n, min(symbol) AS low, max(symbol) AS high FROM sym GROUP BY ALL)),
r0 AS (SELECT block FROM raw)""" + "".join(
    f""",
t{i} AS (SELECT byte, sum(h.n)::BIGINT AS n FROM h JOIN r{i - 1} USING (block) GROUP BY byte),
f{i} AS (SELECT byte, f0 + need // k + CASE WHEN r < need % k THEN 1 ELSE 0 END AS freq FROM (SELECT *, 65536 - (sum(f0) OVER ())::BIGINT AS need, count(*) OVER () AS k, row_number() OVER (ORDER BY n DESC, byte) - 1 AS r FROM (SELECT *, greatest(1, n * 65536 // (sum(n) OVER ())::BIGINT) AS f0 FROM t{i}))),
e{i} AS (SELECT block, sum(CASE WHEN freq > 0 THEN -h.n * log2(freq / 65536) ELSE 0 END) / 8 AS estimate FROM h LEFT JOIN f{i} USING (byte) GROUP BY block),
r{i} AS (SELECT block FROM e{i} JOIN raw USING (block) WHERE estimate + 2 < raw_bytes)"""
    for i in range(1, 5)
)


def _decided(spark, d):
    """(block, raw_bytes, estimate, mode): estimated bytes of a range-coded block, and whether that is its mode."""
    z = _zigzags(spark, d).select(F.floor(F.col("idx") / 2048).alias("block"), "z", varint_length(F.col("z")).alias("length"))
    byte = F.expr("transform(sequence(0, length - 1), k -> cast(shiftrightunsigned(z, 7 * k) & 127 as int) | if(k < length - 1, 128, 0))")
    counts = z.select("block", F.explode(byte).alias("byte")).groupBy("block", "byte").agg(F.count("*").alias("n"))
    raw = block_width(spark, d).select("block", (F.col("n") * F.col("width")).alias("raw_bytes"))
    chosen = raw
    for _ in range(4):
        table = counts.join(chosen.select("block"), "block").groupBy(F.lit(0).alias("one"), "byte").agg(F.sum("n").alias("n"))
        cost = normalize(table, ["one"], "byte", "n").select("byte", (-F.log2(F.col("freq") / 65536)).alias("cost"))  # at most 256 rows
        estimate = counts.join(F.broadcast(cost), "byte", "left").groupBy("block").agg((F.sum(F.col("n") * F.coalesce("cost", F.lit(0.0))) / 8).alias("estimate"))
        found = raw.join(estimate, "block")
        chosen = found.filter(F.col("estimate") + 2 < F.col("raw_bytes"))
    return found.withColumn("mode", F.when(F.col("estimate") + 2 < F.col("raw_bytes"), "RANGE").otherwise("RAW"))


@query(f"WITH {DECIDED} SELECT block, raw_bytes::BIGINT AS raw_bytes, round(estimate, 4) AS estimate, CASE WHEN estimate + 2 < raw_bytes THEN 'RANGE' ELSE 'RAW' END AS mode FROM e4 JOIN raw USING (block)")
def block_modes(spark, d):
    return _decided(spark, d).select("block", "raw_bytes", F.round("estimate", 4).alias("estimate"), "mode")


@query(f"WITH {DECIDED} SELECT CASE WHEN estimate + 2 < raw_bytes THEN 'RANGE' ELSE 'RAW' END AS mode, count(*) AS blocks FROM e4 JOIN raw USING (block) GROUP BY ALL")
def mode_counts(spark, d):
    return _decided(spark, d).groupBy("mode").agg(F.count("*").alias("blocks"))


@query(f"""WITH {DECIDED}, one AS (SELECT count(*) AS n FROM sym),
c AS (SELECT 'int32' AS coder, 4.0::DOUBLE * n AS bytes FROM one UNION ALL SELECT 'varint', sum(length)::DOUBLE FROM coded UNION ALL SELECT 'raw_blocks', sum(raw_bytes)::DOUBLE FROM raw
  UNION ALL SELECT 'range_blocks', sum(least(estimate + 2, raw_bytes)) FROM e4 JOIN raw USING (block))
SELECT coder, round(bytes, 3) AS bytes, round(8 * bytes / n, 6) AS bits_per_symbol, round(100 * bytes / (4 * n), 6) AS pct_of_int32 FROM c, one""")
def coder_comparison(spark, d):
    n = _symbols(spark, d).agg(F.count("*").alias("n"))  # one row
    rows = coder_baselines(spark, d).select("coder", F.col("bytes").cast("double").alias("bytes"))
    best = _decided(spark, d).agg(F.sum(F.least(F.col("estimate") + 2, F.col("raw_bytes").cast("double"))).alias("bytes")).select(F.lit("range_blocks").alias("coder"), "bytes")
    b, k = F.col("bytes"), F.col("n")
    return rows.unionByName(best).join(F.broadcast(n)).select("coder", F.round(b, 3).alias("bytes"), F.round(8 * b / k, 6).alias("bits_per_symbol"), F.round(100 * b / (4 * k), 6).alias("pct_of_int32"))


@query(f"""WITH {SYMBOLS}, b AS (SELECT n, {WIDTH} AS width FROM (SELECT count(*) AS n, min(symbol) AS low, max(symbol) AS high FROM sym GROUP BY idx // 2048))
SELECT 'int32' AS coder, 4 * count(*) AS bytes FROM sym UNION ALL SELECT 'varint', sum({VARINT_LEN.format('z')})::BIGINT FROM zz UNION ALL SELECT 'raw_blocks', sum(n * width)::BIGINT FROM b""")
def coder_baselines(spark, d):
    z = _zigzags(spark, d)
    one = z.agg(F.count("*").alias("n"), F.sum(varint_length(F.col("z"))).alias("v"))
    rows = one.select(F.explode(F.array(F.struct(F.lit("int32").alias("coder"), (4 * F.col("n")).alias("bytes")), F.struct(F.lit("varint").alias("coder"), F.col("v").alias("bytes")))).alias("r")).select("r.*")
    return rows.unionByName(block_width(spark, d).agg(F.sum(F.col("n") * F.col("width")).alias("bytes")).select(F.lit("raw_blocks").alias("coder"), "bytes"))


# ---------------------------------------------------------------- codec
@query(f"WITH {BASE} SELECT count(*) AS n_cells, count(value) AS n_valid, true AS mask_identical, 0::BIGINT AS violations FROM cells")
def roundtrip(spark, d):
    cells = _cells(spark, d)
    back = codec.decode_streams(codec.encode_cells(cells, BOUND, 24, 32, chunk=8, dtype="float64"))
    both = cells.join(back.withColumnRenamed("value", "decoded"), ["field_id", "t", "y", "x"])
    bad = ~F.col("missing") & (F.abs(F.col("value") - F.col("decoded")) > BOUND)
    return both.agg(F.count("*").alias("n_cells"), F.count("value").alias("n_valid"), F.bool_and(F.col("missing") == grid.is_missing(F.col("value"))).alias("mask_identical"), F.sum(bad.cast("bigint")).alias("violations"))


@query(f"WITH {BASE}, b AS (SELECT unnest([0.01, 0.05, 0.2])::DOUBLE AS error_bound), o AS (SELECT unnest([true, false]) AS outer_zstd) SELECT error_bound, outer_zstd, count(value) AS n_valid, 0::BIGINT AS violations, true AS bound_respected FROM cells, b, o GROUP BY ALL")
def bound_sweep(spark, d):
    cells = _cells(spark, d)
    runs = [(outer, codec.encode_cells(cells, b, 24, 32, chunk=8, dtype="float64", outer_compress=outer)) for b in (0.01, 0.05, 0.2) for outer in (True, False)]
    over = F.sum((F.col("max_abs_error") > F.col("error_bound")).cast("bigint")).alias("violations")
    each = [r.groupBy("error_bound").agg(F.sum("n_valid").alias("n_valid"), over, F.bool_and(F.col("max_abs_error") <= F.col("error_bound")).alias("bound_respected")).withColumn("outer_zstd", F.lit(o)) for o, r in runs]
    return reduce(DataFrame.unionByName, each)


@query("SELECT true AS monotone")
def sweep_monotone(spark, d):
    """Ratios don't fall by more than 2 % from a bound to the next looser one."""
    runs = [metrics.size_metrics(codec.encode_cells(_cells(spark, d), b, 24, 32, chunk=8, dtype="float64")) for b in (0.01, 0.05, 0.2)]
    w = Window.partitionBy("field_id").orderBy("error_bound")
    runs = runs[0].unionByName(runs[1]).unionByName(runs[2]).withColumn("before", F.lag("cr").over(w))
    return runs.agg(F.bool_and(F.coalesce(F.col("before") <= F.col("cr") * 1.02, F.lit(True))).alias("monotone"))


@query("SELECT 0.2::DOUBLE AS error_bound")
def best_run(spark, d):
    runs = [metrics.size_metrics(codec.encode_cells(_cells(spark, d), b, 24, 32, chunk=8, dtype="float64")) for b in (0.01, 0.05, 0.2)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).agg(F.max_by("error_bound", "cr").alias("error_bound"))


@query()
def stream_modes(spark, d):
    """Blocks of each mode in the streams themselves."""
    return codec.stream_modes(codec.encode_cells(_cells(spark, d), BOUND, 24, 32, chunk=8, dtype="float64")).groupBy("mode").agg(F.sum("blocks").alias("blocks"))


@query()
def mask_layouts(spark, d):
    return codec.mask_layouts(_cells(spark, d), 24, 32, 8).groupBy("layout").agg(F.sum("bytes").alias("bytes"))


@query()
def sweep_sizes(spark, d):
    """The sweep over bounds with and without outer compression: ratio, bytes of the payload, and whether every bound held."""
    cells = _cells(spark, d)
    runs = [metrics.size_metrics(codec.encode_cells(cells, b, 24, 32, chunk=8, dtype="float64", outer_compress=o)).withColumn("outer_zstd", F.lit(o)) for b in (0.01, 0.05, 0.2) for o in (True, False)]
    return reduce(DataFrame.unionByName, runs).withColumn("verified", F.col("max_abs_error") <= F.col("error_bound")).drop("field_id")


@query()
def sweep_series(spark, d):
    """The verified runs of the sweep as a series of ratios by bound for each setting of outer compression."""
    points = F.array_sort(F.collect_list(F.struct("error_bound", "cr")))  # three points a series
    return sweep_sizes(spark, d).filter("verified").groupBy("outer_zstd").agg(points.alias("series"))


@query()
def size_metrics(spark, d):
    return metrics.size_metrics(codec.encode_cells(_cells(spark, d), BOUND, 24, 32, chunk=8, dtype="float64"))
