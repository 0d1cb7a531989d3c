"""Every catalog query against its SQL, and the DataFrame operators on small cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpress.cli import main
from fieldpress.functions.freqs import normalize, normalize_np
from fieldpress.operators import codec, grid, metrics
from fieldpress.plans import catalog
from fieldpress.sources import read_npy, synthetic_array, synthetic_wave
from fieldpress.streaming.profiles import encode_batches, windowed_stats

from .test_kernels import walked

FOLDER = "/root/testdata/sf0.001"


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{FOLDER}/events.parquet')")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    expected = ordered(cursor.fetchall(), [c[0] for c in cursor.description])
    df = catalog.QUERIES[name](spark, FOLDER)
    assert ordered(df.collect(), df.columns) == expected and expected


def test_numbers_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 8)
    cells = spark.createDataFrame([("f", i // 10, i % 10, 0, float(i)) for i in range(50)], "field_id string, t int, y int, x int, value double")
    rows = grid.with_before(grid.valid_index(cells), "value", 3).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(50))
    assert [(r.value_1, r.value_3) for r in rows] == [(i - 1.0 if i > 0 else None, i - 3.0 if i > 2 else None) for i in range(50)]


def test_normalize_takes_back(spark):
    counts = [10**6] + [1] * 3000
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(counts)] + [("b", 1, 5), ("b", 2, 7)], "ctx string, symbol long, n long")
    rows = normalize(df, ["ctx"], "symbol", "n").collect()
    assert [r.freq for r in sorted(rows) if r.ctx == "a"] == normalize_np(np.array(counts)).tolist()
    assert [r.freq for r in sorted(rows) if r.ctx == "b"] == normalize_np(np.array([5, 7])).tolist()


def test_chunks_and_pruning(spark, tmp_path):
    field = synthetic_array((6, 8, 10))
    np.save(tmp_path / "f.npy", field)
    cells = read_npy(spark, str(tmp_path / "f.npy"))
    some = read_npy(spark, str(tmp_path / "f.npy"), 2, 3).collect()
    assert {r.t for r in some} == {2, 3} and len(some) == 160 and read_npy(spark, str(tmp_path / "f.npy"), 9).count() == 0
    streams = codec.encode_cells(cells, 0.05, 8, 10, chunk=2).cache()
    assert streams.count() == 3 and all(r.bound_respected for r in streams.collect())
    got = codec.decode_streams(streams, 2, 3).collect()
    assert {r.t for r in got} == {2, 3} and len(got) == 160
    for r in got:
        v = field[r.t, r.y, r.x]
        assert r.missing == np.isnan(v) and (r.missing or abs(r.value - v) <= np.float32(0.05))


def test_wave_and_stream(spark, tmp_path):
    wave = synthetic_wave(spark, (3, 4, 5))
    assert wave.count() == 60 and abs(wave.filter("t = 0 AND y = 0 AND x = 0").first().value - 25) < 1e-9
    folder = str(tmp_path / "in")
    wave.withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, t)")).write.parquet(folder)
    stats = windowed_stats(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))
    q = stats.writeStream.format("memory").queryName("profiles").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n_cells, r.n_valid) for r in spark.table("profiles").collect()) == [(20, 20)] * 3


def test_cli(tmp_path):
    runs = main(["--shape", "2", "12", "20", "--sweep", "--json", str(tmp_path / "r.json")])
    assert len(runs) == 3 and all(r["bound_respected"] and r["mask_identical"] for r in runs) and (tmp_path / "r.json").exists()


def test_sql_names(spark):
    from fieldpress.functions.sql import register

    register(spark)
    spark.createDataFrame([([1.0, float("nan"), 2.0, 3.0],)], "v array<double>").createOrReplaceTempView("fields")
    spark.sql("SELECT field_encode(v, 1, 2, 2, 0.05D) AS s FROM fields").createOrReplaceTempView("encoded")
    back = spark.sql("SELECT field_decode(s) AS v FROM encoded").first().v
    assert back[1] is None and all(abs(a - b) <= 0.05 for a, b in zip([back[0], *back[2:]], [1, 2, 3]))
    assert spark.sql("SELECT c.* FROM encoded, LATERAL stream_cells(s) c").count() == 4
    spark.sql("SELECT id, s FROM encoded, range(5)").createOrReplaceTempView("many")
    rows = spark.sql("SELECT id, t, y, x, value FROM many, LATERAL stream_cells(s) c").collect()
    assert sorted((r.id, r.t, r.y, r.x) for r in rows) == [(i, 0, y, x) for i in range(5) for y in range(2) for x in range(2)]


def test_scan_of_all_days(spark):
    cells = catalog._cells(spark, FOLDER).collect()
    field = np.full((max(r.t for r in cells) + 1, 24, 32), np.nan)
    for r in cells:
        field[r.t, r.y, r.x] = np.nan if r.value is None else r.value
    missing = np.isnan(field)
    symbols, state = walked(field, missing, catalog.STEP)
    places = list(zip(*(i.tolist() for i in np.nonzero(~missing))))
    run = lambda name: catalog.QUERIES[name](spark, FOLDER).collect()
    assert len(field) > catalog.SLICE and max(t for t, _, _ in places) >= catalog.SLICE
    assert {(r.t, r.y, r.x): r.symbol for r in run("scan_symbols_all")} == dict(zip(places, symbols))
    assert {(r.t, r.y, r.x): r.recon for r in run("scan_recon_all")} == {p: state[p] for p in places}
    back = run("scan_decode_all")
    assert len(back) == field.size
    for r in back:
        v, at = field[r.t, r.y, r.x], state[r.t, r.y, r.x]
        assert r.missing == np.isnan(v) and r.value == (None if r.missing else v if abs(v - at) > catalog.BOUND else at)
    k = np.unique(symbols, return_counts=True)[1]
    (one,) = run("pred_stencil_all")
    assert one.n == len(symbols) and abs(one.entropy_bits - (np.log2(k.sum()) - (k * np.log2(k)).sum() / k.sum())) < 1e-5


def test_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 8)
    rng = np.random.default_rng(2)
    value = [None if v else 1.0 for v in np.repeat(rng.random(30) < 0.5, rng.integers(1, 20, 30))]
    cells = spark.createDataFrame([(f, i // 10, i % 10, 0, v) for f in "ab" for i, v in enumerate(value)], "field_id string, t int, y int, x int, value double")
    got = sorted(tuple(r) for r in grid.mask_runs(cells).collect())
    edges = [i for i in range(len(value)) if i == 0 or (value[i] is None) != (value[i - 1] is None)]
    assert got == [(f, k, int(value[i] is None), i, j - i) for f in "ab" for k, (i, j) in enumerate(zip(edges, [*edges[1:], len(value)]))]


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_quantiles(spark, p):
    rng = np.random.default_rng(5)
    groups = {"a": rng.lognormal(0, 3, 999), "b": np.round(rng.normal(0, 2, 500)), "c": np.array([4.0]), "d": np.full(7, 2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)], "k string, v double")
    got = {r.k: r["quantile"] for r in metrics.quantile(df, "k", "v", p).collect()}
    assert set(got) == set(groups) and all(np.isclose(got[k], np.quantile(x, p)) for k, x in groups.items())


def test_sizes_modes_and_layouts(spark):
    streams = codec.encode_cells(catalog._cells(spark, FOLDER), catalog.BOUND, 24, 32, chunk=8, dtype="float64").collect()
    size, cells = sum(len(r.container) for r in streams), sum(r.nt * r.ny * r.nx for r in streams)
    (one,) = catalog.QUERIES["size_metrics"](spark, FOLDER).collect()
    assert one.compressed_bytes == size and abs(one.bits_per_value - 8 * size / cells) < 1e-9 and abs(one.cr - 8 * cells / size) < 1e-9
    modes = {r["mode"]: r.blocks for r in catalog.QUERIES["stream_modes"](spark, FOLDER).collect()}
    assert sum(modes.values()) == sum(-(-r.n_valid // 2048) for r in streams)
    layouts = {r.layout: r.bytes for r in catalog.QUERIES["mask_layouts"](spark, FOLDER).collect()}
    assert layouts["bits"] == sum(-(-r.nt * 768 // 8) for r in streams) and layouts["runs_or_bits"] <= layouts["bits"] and len(layouts) == 5
    sweep = catalog.QUERIES["sweep_sizes"](spark, FOLDER).collect()
    assert len(sweep) == 6 and all(r.verified for r in sweep)
    by = {(r.error_bound, r.outer_zstd): r.compressed_bytes for r in sweep}
    assert by[0.01, True] > by[0.05, True] > by[0.2, True] and all(by[b, True] <= by[b, False] for b, _ in by)
    assert all(r.payload_bytes < r.compressed_bytes for r in sweep if not r.outer_zstd)
    series = {r.outer_zstd: [p.error_bound for p in r.series] for r in catalog.QUERIES["sweep_series"](spark, FOLDER).collect()}
    assert series == {True: [0.01, 0.05, 0.2], False: [0.01, 0.05, 0.2]}


def test_errors_in_the_fields_type(spark):
    near = float(np.float32(1.05))
    pairs = spark.createDataFrame([("f", 1.0, near), ("f", 2.0, 2.0)], "field_id string, original double, decoded double")
    (r,) = metrics.error_metrics(pairs, near - 1.0, "float").collect()
    assert r.violations == 0 and r.bound_respected
    (r,) = metrics.error_metrics(pairs, 0).collect()
    assert r.bound_respected and r.violations == 0
    same = spark.createDataFrame([("f", -9.0, -9.0), ("f", 1.0, 1.1), ("g", -9.0, 1.0)], "field_id string, original double, decoded double")
    assert {r.field_id: r.sentinel_identical for r in metrics.sentinel_identity(same, -9.0).collect()} == {"f": True, "g": False}


def test_streamed_batches(spark, tmp_path):
    rows = [("f", t, y, x, -9.0 if x == 1 else t + y + x * 0.5) for t in range(2) for y in range(3) for x in range(4)]
    spark.createDataFrame(rows, "field_id string, t int, y int, x int, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("field_id string, t int, y int, x int, value double").parquet(str(tmp_path / "in"))
    q = encode_batches(stream, str(tmp_path / "out"), 0.05, 3, 4, dtype="float64", missing_value=-9.0, outer_compress=False).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    back = codec.decode_streams(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert len(back) == 24 and all(r.missing == (r.x == 1) and (r.missing or abs(r.value - (r.t + r.y + r.x * 0.5)) <= 0.05) for r in back)
