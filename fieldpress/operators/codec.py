"""Fields in, framed streams out, and back: array helpers, and DataFrames with a task per field and chunk."""

from __future__ import annotations

import math
import struct
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FieldConfig
from ..functions.container import MODEL_VERSION, ContainerError, read_container, write_container
from ..functions.masks import pack_mask, unpack_mask
from ..functions.scan import decode_valid, encode_valid, scan_encode
from ..functions.symbols import decode_symbols, encode_symbols, modes_of, pack_repairs, unpack_repairs


def missing_mask(values: np.ndarray, missing_value: float) -> np.ndarray:
    """Not finite, or equal to the sentinel in the field's own dtype."""
    out = ~np.isfinite(values)
    if not math.isnan(missing_value):
        out |= values == values.dtype.type(missing_value)
    return out


class FieldCodec:
    """encode and decode single arrays; ``timings`` has the seconds of the last call's stages."""

    def __init__(self, config: FieldConfig):
        self.config, self.timings = config, {}

    def as_field(self, data) -> np.ndarray:
        """An array of the config's shape and dtype: floats are cast, and other data of the same size is taken as its bytes."""
        a, c = np.asarray(data), self.config
        if a.dtype.kind == "f":
            if a.size != math.prod(c.shape):
                raise ValueError(f"{a.size} cells instead of {math.prod(c.shape)}")
            with np.errstate(over="ignore"):
                return np.ascontiguousarray(a, c.np_dtype).reshape(c.shape)
        raw = np.ascontiguousarray(a).tobytes() if not isinstance(data, (bytes, bytearray, memoryview)) else bytes(data)
        if len(raw) != math.prod(c.shape) * c.np_dtype.itemsize:
            raise ValueError(f"{len(raw)} bytes don't make a field of shape {c.shape}")
        return np.frombuffer(raw, c.np_dtype).reshape(c.shape)

    def _lap(self, name: str) -> None:
        now = time.perf_counter()
        self.timings[name], self._last = now - self._last, now

    def encode(self, data) -> bytes:
        c, self.timings, self._last = self.config, {}, time.perf_counter()
        field = self.as_field(data)
        missing = missing_mask(field, c.missing_value)
        valid = field[~missing]
        self._lap("mask")
        symbols, recon = encode_valid(valid, missing, c.step)
        self._lap("scan")
        decoded = recon.astype(c.np_dtype)
        error = np.abs(valid.astype(np.float64) - decoded.astype(np.float64))
        bad = np.flatnonzero(~(error <= float(c.np_dtype.type(c.effective_bound))))
        error[bad] = 0.0
        self._lap("verify")
        entropy = encode_symbols(symbols)
        residual = struct.pack("<Q", len(entropy)) + entropy + pack_repairs(bad, valid[bad], c.dtype)
        self._lap("entropy")
        mask = pack_mask(missing)
        self._lap("pack")
        most = float(error.max(initial=0.0))
        header = {
            "shape": list(c.shape), "dtype": c.dtype, "missing_value": "nan" if math.isnan(c.missing_value) else c.missing_value,
            "error_bound": c.error_bound, "quant_step": c.step, "origin": 0.0, "mode": 1, "effective_error_bound": c.effective_bound,
            "n_valid": len(valid), "n_repaired": len(bad), "codec_version": MODEL_VERSION,
            "metrics": {"max_abs_error": most, "n_repaired": len(bad), "uncompressed_size": field.nbytes, "payload_size": len(mask) + len(residual), "bound_respected": most <= c.effective_bound},
        }
        out = write_container(header, mask, residual, outer=c.outer_compress)
        self._lap("frame")
        return out

    def decode(self, stream: bytes, out: np.ndarray | None = None) -> np.ndarray:
        c, self.timings, self._last = self.config, {}, time.perf_counter()
        if out is not None and (not isinstance(out, np.ndarray) or out.dtype != c.np_dtype or not out.flags.c_contiguous or out.nbytes != math.prod(c.shape) * c.np_dtype.itemsize):
            raise ValueError("out must be a contiguous array of the field's dtype and size")
        box = read_container(bytes(stream))
        if box.model_version != MODEL_VERSION:
            raise ContainerError(f"unsupported model version {box.model_version}")
        if box.header["dtype"] != c.dtype or tuple(box.header["shape"]) != c.shape:
            raise ContainerError(f"a stream of {box.header['dtype']}{tuple(box.header['shape'])}, not {c.dtype}{c.shape}")
        self._lap("frame")
        field = decode_box(box, self._lap)
        if out is None:
            return field
        out.reshape(-1)[:] = field.reshape(-1)
        return out


def decode_box(box, lap=lambda stage: None) -> np.ndarray:
    """The field of a container; ``lap`` is called with the name of each stage when it has ended."""
    head = box.header
    shape, dtype = tuple(head["shape"]), np.dtype(head["dtype"])
    missing = unpack_mask(box.mask, math.prod(shape)).reshape(shape)
    lap("mask")
    (size,) = struct.unpack_from("<Q", box.residual)
    symbols = decode_symbols(box.residual[8 : 8 + size], int(head["n_valid"]))
    lap("entropy")
    places, values = unpack_repairs(box.residual[8 + size :], head["dtype"])
    lap("repairs")
    valid = decode_valid(symbols, missing, head["quant_step"], head["origin"]).astype(dtype)
    lap("scan")
    field = np.full(shape, math.nan if head["missing_value"] == "nan" else head["missing_value"], dtype)
    valid[places] = values
    field[~missing] = valid
    lap("fill")
    return field


# ---------------------------------------------------------------- DataFrames
STREAMS = "field_id string, t0 int, nt int, ny int, nx int, dtype string, error_bound double, n_valid long, n_repaired long, max_abs_error double, bound_respected boolean, uncompressed_size long, payload_size long, v_min double, v_max double, container binary"


def encode_cells(cells: DataFrame, error_bound: float, ny: int, nx: int, chunk: int | None = None, dtype: str = "float32", missing_value=math.nan, outer_compress: bool = True) -> DataFrame:
    """STREAMS from cells (field_id, t, y, x, value): a row per field, or per ``chunk`` time steps of it.

    One chunk per field is the parity mode. Chunks start cold, cost some ratio, and bound a task's memory; use them for fields
    that don't fit a task. Absent cells, NULL, NaN and infinities are missing. v_min and v_max let scans skip chunks.
    """
    FieldConfig((1, ny, nx), error_bound, missing_value, dtype, outer_compress)  # fails here, not in a task
    start = F.lit(0) if chunk is None else F.floor(F.col("t") / chunk).cast("int") * chunk
    cells = cells.select("field_id", F.col("t").cast("int").alias("t"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"), start.alias("t0"))

    def encode(key, table):
        field_id, t0 = (k.as_py() for k in key)
        t, y, x = (table[c].to_numpy() for c in "tyx")
        nt = int(t.max()) - t0 + 1 if chunk is None else min(chunk, int(t.max()) - t0 + 1)
        grid = np.full((nt, ny, nx), np.nan if math.isnan(config_missing) else config_missing)
        grid[t - t0, y, x] = table["value"].to_numpy(zero_copy_only=False)
        codec = FieldCodec(FieldConfig((nt, ny, nx), error_bound, missing_value, dtype, outer_compress))
        field = codec.as_field(grid)
        stream = codec.encode(field)
        head = read_container(stream).header
        ok = field[~missing_mask(field, config_missing)]
        low, high = (float(ok.min()), float(ok.max())) if len(ok) else (None, None)
        m = head["metrics"]
        row = [field_id, t0, nt, ny, nx, dtype, float(error_bound), head["n_valid"], head["n_repaired"], m["max_abs_error"], m["bound_respected"], m["uncompressed_size"], m["payload_size"], low, high, stream]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row, types)], names=[c.split()[0] for c in STREAMS.split(", ")])

    from ..config import check_missing

    config_missing = check_missing(missing_value)
    return cells.groupBy("field_id", "t0").applyInArrow(encode, STREAMS)


def decode_streams(streams: DataFrame, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """Cells (field_id, t, y, x, value, missing) of streams; chunks outside [t_from, t_to] are skipped before they are decoded."""
    if t_from is not None:
        streams = streams.filter(F.col("t0") + F.col("nt") > t_from)
    if t_to is not None:
        streams = streams.filter(F.col("t0") <= t_to)
    names = ["field_id", "t", "y", "x", "value", "missing"]

    def rows(batches):
        for batch in batches:
            for field_id, t0, data in zip(batch["field_id"].to_pylist(), batch["t0"].to_pylist(), batch["container"]):
                box = read_container(data.as_py())
                field = decode_box(box)
                sentinel = box.header["missing_value"]
                missing = unpack_mask(box.mask, field.size)
                t, y, x = (i.ravel().astype(np.int32) for i in np.indices(field.shape))
                values = np.where(missing, math.nan if sentinel == "nan" else sentinel, field.ravel().astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([field_id] * field.size, pa.string()), pa.array(t + np.int32(t0)), pa.array(y), pa.array(x), pa.array(values), pa.array(missing)], names=names)

    cells = streams.select("field_id", "t0", "container").mapInArrow(rows, "field_id string, t int, y int, x int, value double, missing boolean")
    if t_from is not None:
        cells = cells.filter(F.col("t") >= t_from)
    return cells.filter(F.col("t") <= t_to) if t_to is not None else cells


def stream_modes(streams: DataFrame) -> DataFrame:
    """(field_id, t0, mode, blocks): how many blocks of each stream are coded in which mode."""
    names = ["RAW", "RANGE", "CTX"]

    def rows(batches):
        for batch in batches:
            out = []
            for field_id, t0, data in zip(batch["field_id"].to_pylist(), batch["t0"].to_pylist(), batch["container"]):
                residual = read_container(data.as_py()).residual
                (size,) = struct.unpack_from("<Q", residual)
                modes = modes_of(residual[8 : 8 + size])
                out += [(field_id, t0, names[m], modes.count(m)) for m in sorted(set(modes))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["field_id", "t0", "mode", "blocks"])

    return streams.select("field_id", "t0", "container").mapInArrow(rows, "field_id string, t0 int, mode string, blocks long")


def mask_layouts(cells: DataFrame, ny: int, nx: int, chunk: int) -> DataFrame:
    """(field_id, t0, layout, bytes): a chunk's mask as bits, as runs or bits, both again in zstd, and in zstd with time innermost."""
    import zstandard

    def sizes(key, table):
        t, y, x = (table[c].to_numpy() for c in "tyx")
        t0 = key[1].as_py()
        missing = np.ones((int(t.max()) - t0 + 1, ny, nx), bool)
        missing[t - t0, y, x] = ~np.isfinite(table["value"].to_numpy(zero_copy_only=False))
        bits = lambda m: np.packbits(m.ravel(), bitorder="little").tobytes()
        small = lambda data: len(zstandard.ZstdCompressor(level=3).compress(data))
        found = {"bits": len(bits(missing)), "runs_or_bits": len(pack_mask(missing)), "bits_zstd": small(bits(missing)), "runs_or_bits_zstd": small(pack_mask(missing)), "lat_lon_time_zstd": small(pack_mask(missing.transpose(1, 2, 0)))}
        return pa.table({"field_id": [key[0].as_py()] * len(found), "t0": pa.array([t0] * len(found), pa.int32()), "layout": list(found), "bytes": list(found.values())})

    start = F.floor(F.col("t") / chunk).cast("int") * chunk
    cells = cells.select("field_id", F.col("t").cast("int").alias("t"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"), start.alias("t0"))
    return cells.groupBy("field_id", "t0").applyInArrow(sizes, "field_id string, t0 int, layout string, bytes long")


def scan_cells(cells: DataFrame, error_bound: float, ny: int, nx: int, dtype: str = "float64") -> DataFrame:
    """(field_id, t, y, x, symbol, recon) of the valid cells: the scan alone, one task per field."""
    from ..config import derive_step

    step = derive_step(error_bound, dtype)

    def scan(table):
        t, y, x = (table[c].to_numpy() for c in "tyx")
        grid = np.full((int(t.max()) + 1, ny, nx), np.nan, np.dtype(dtype))
        grid[t, y, x] = table["value"].to_numpy(zero_copy_only=False)
        missing = ~np.isfinite(grid)
        symbols, recon = scan_encode(grid, missing, step)
        t, y, x = (i.astype(np.int32) for i in np.nonzero(~missing))
        return pa.table([pa.array([table["field_id"][0].as_py()] * len(t), pa.string()), t, y, x, symbols, recon[~missing]], names=["field_id", "t", "y", "x", "symbol", "recon"])

    cells = cells.select("field_id", F.col("t").cast("int").alias("t"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    return cells.groupBy("field_id").applyInArrow(scan, "field_id string, t int, y int, x int, symbol long, recon double")
