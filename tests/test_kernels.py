"""Integers, tables, coders, masks, containers, the scan and the codec, without Spark."""

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldpress.config import FieldConfig, check_bound, check_missing, check_shape, derive_step
from fieldpress.functions import rans, symbols
from fieldpress.functions.container import ContainerError, read_container, write_container
from fieldpress.functions.freqs import SCALE, normalize_np
from fieldpress.functions.ints import unzigzag_np, varint_pack, varint_unpack, zigzag_np
from fieldpress.functions.masks import RLE_MAGIC, pack_mask, unpack_mask
from fieldpress.functions.scan import scan_decode, scan_encode
from fieldpress.functions.symbols import CTX, decode_symbols, encode_symbols, modes_of, pack_repairs, unpack_repairs
from fieldpress.operators.codec import FieldCodec
from fieldpress.sources.synthetic import synthetic_array

LONGS = st.integers(-(2**62), 2**62)


@given(st.lists(LONGS, max_size=50))
def test_zigzag_and_varints(values):
    s = np.array(values, np.int64)
    z = zigzag_np(s)
    assert (unzigzag_np(z) == s).all()
    assert (varint_unpack(varint_pack(z), len(z)) == z).all()


def test_varint_bytes():
    assert varint_pack(np.array([0, 1, 127, 128, 300])).hex() == "00017f8001ac02"
    for bad, n in ((b"\x80", 1), (b"\x01\x80", 1), (b"\x01", 2), (b"\x01", 0)):
        with pytest.raises(ValueError):
            varint_unpack(bad, n)


def one_by_one(counts):
    """Normalisation as a loop of single steps."""
    total = sum(counts)
    f = [max(1, c * SCALE // total) if c else 0 for c in counts]
    order = sorted((i for i, c in enumerate(counts) if c), key=lambda i: (-counts[i], i))
    need, at = SCALE - sum(f), 0
    while need:
        i = order[at % len(order)]
        if need > 0:
            f[i], need = f[i] + 1, need - 1
        elif f[i] > 1:
            f[i], need = f[i] - 1, need + 1
        at += 1
    return f


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 10**6)), min_size=1, max_size=300).filter(any))
def test_normalized_tables(counts):
    assert normalize_np(np.array(counts)).tolist() == one_by_one(counts)


def test_normalized_with_many_rare_symbols():
    counts = [10**9] + [1] * 4000
    assert normalize_np(np.array(counts)).tolist() == one_by_one(counts)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_rans(data):
    x = np.frombuffer(data, np.uint8)
    f = normalize_np(np.bincount(x, minlength=256))
    assert (rans.decode(rans.encode(x, f), len(x), f) == x).all()


def test_rans_errors():
    f = normalize_np(np.bincount([1, 2, 2], minlength=256))
    stream = rans.encode(np.array([1, 2, 2] * 50), f)
    for call in (lambda: rans.encode(np.array([3]), f), lambda: rans.encode(np.array([256]), f), lambda: rans.decode(stream[:5], 150, f), lambda: rans.encode(np.array([1]), f + 1), lambda: rans.encode(np.array([1]), -f)):
        with pytest.raises(ValueError):
            call()


def streams():
    rng = np.random.default_rng(0)
    yield from (np.array(x, np.int64) for x in ([], [0], [1, -1, 2, -2, 0], range(-5000, 5000), [-(2**40), 2**40, 0], [-(2**62), 2**62]))
    yield rng.normal(0, 1000, 5000).astype(np.int64)
    yield np.cumsum(rng.integers(-2, 3, 5000))
    yield rng.integers(-(2**20), 2**20, 3000)
    yield np.where(rng.random(6000) < 0.5, 0, rng.integers(-(2**45), 2**45, 6000))


@pytest.mark.parametrize("symbols", list(streams()), ids=range(10))
def test_symbol_streams(symbols):
    assert (decode_symbols(encode_symbols(symbols), len(symbols)) == symbols).all()


def test_symbol_modes_and_errors():
    walk = np.cumsum(np.random.default_rng(1).integers(-2, 3, 5000))
    assert set(modes_of(encode_symbols(walk))) == {CTX}
    wide = np.random.default_rng(2).integers(-(2**20), 2**20, 3000)
    assert CTX not in modes_of(encode_symbols(wide))
    with pytest.raises(ValueError):
        decode_symbols(b"x", 0)
    with pytest.raises(ValueError):
        decode_symbols(encode_symbols(walk), 9000)


@pytest.mark.parametrize("dtype", ["float32", "float64"])
def test_repairs(dtype):
    p, v = unpack_repairs(pack_repairs(np.array([3, 17]), np.array([1.5, -2.25]), dtype), dtype)
    assert p.tolist() == [3, 17] and v.tolist() == [1.5, -2.25] and v.dtype == dtype
    with pytest.raises(ValueError):
        unpack_repairs(b"\x01\0\0\0", dtype)


def test_masks():
    rng = np.random.default_rng(5)
    bits, half = rng.random(1000) < 0.5, np.arange(4096) < 2048
    assert not pack_mask(bits).startswith(RLE_MAGIC) and pack_mask(half).startswith(RLE_MAGIC)
    for m in (bits, half, np.zeros(0, bool), np.ones(7, bool)):
        assert (unpack_mask(pack_mask(m), len(m)) == m).all()
    for bad in (RLE_MAGIC, RLE_MAGIC + b"\0\x80", RLE_MAGIC + b"\0\x7f\x7f", pack_mask(half)[:-1], b"\0"):
        with pytest.raises(ValueError):
            unpack_mask(bad, 100)


def test_container():
    data = write_container({"b": 1, "a": 2}, b"m" * 500, b"r" * 500)
    box = read_container(data)
    assert (box.mask, box.residual, box.flags) == (b"m" * 500, b"r" * 500, 1) and b'{"a":2,"b":1}' in data
    assert read_container(write_container({}, b"m" * 500, np.random.default_rng(0).bytes(50))).flags == 2
    assert read_container(write_container({}, b"m", b"r", outer=False)).flags == 0

    def signed(body):
        return body + struct.pack("<I", zlib.crc32(body))

    bad = [b"", b"XXXX" + data[4:], data[:-1] + bytes([data[-1] ^ 1]), signed(data[:4] + b"\x63\0" + data[6:-4]), signed(data[:-40]), data[:10]]
    for b in bad:
        with pytest.raises(ContainerError):
            read_container(b)


def walked(values, missing, step):
    """The scan cell by cell."""
    nt, ny, nx = values.shape
    state, out = np.zeros(values.shape), []
    for t in range(nt):
        for y in range(ny):
            for x in range(nx):
                if missing[t, y, x]:
                    continue
                near = [(8.0, t, y, x - 1), (2.0, t, y - 1, x), (1.0, t, y - 1, x - 1), (1.0, t, y - 1, x + 1), (1.0, t - 1, y, x)]
                total = weight = 0.0
                for w, a, b, c in near:
                    if a >= 0 and b >= 0 and 0 <= c < nx and state[a, b, c] != 0:
                        total, weight = total + w * state[a, b, c], weight + w
                p = total / weight if weight else 32.0
                q = math.floor((float(values[t, y, x]) - p) * (1.0 / step) + 0.5)
                out.append(q)
                state[t, y, x] = p + q * step
    return out, state


@pytest.mark.parametrize("shape", [(4, 16, 32), (1, 1, 1), (3, 1, 7), (2, 5, 1)])
def test_wavefront_is_the_walk(shape):
    field = np.random.default_rng(3).normal(0, 3, shape).astype(np.float32)
    missing = np.random.default_rng(4).random(shape) < 0.2
    symbols, recon = scan_encode(field, missing, 0.1)
    expected, state = walked(field, missing, 0.1)
    assert symbols.tolist() == expected and (recon == state).all()
    assert (scan_decode(symbols, missing, 0.1) == state).all()


@pytest.mark.parametrize("dtype", ["float32", "float64"])
@pytest.mark.parametrize("bound", [0, 0.01, 0.05, 0.2])
def test_codec_bounds(dtype, bound):
    field = synthetic_array((4, 16, 32)).astype(dtype)
    codec = FieldCodec(FieldConfig(field.shape, bound, dtype=dtype))
    stream = codec.encode(field)
    assert stream == codec.encode(field)
    back = codec.decode(stream)
    ok = ~np.isnan(field)
    assert (np.isnan(back) == ~ok).all() and back.dtype == dtype
    assert np.abs(back[ok].astype(float) - field[ok].astype(float)).max() <= float(np.dtype(dtype).type(codec.config.effective_bound))
    out = np.empty(field.shape, dtype)
    assert codec.decode(stream, out) is out and np.array_equal(out, back, equal_nan=True)


def test_codec_cases():
    sizes = [len(FieldCodec(FieldConfig((8, 90, 180), b)).encode(synthetic_array((8, 90, 180)))) for b in (0.01, 0.05, 0.2)]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] <= 8 * 90 * 180 * 4 / 2
    empty = np.full((2, 3, 4), np.nan, np.float32)
    assert np.isnan(FieldCodec(FieldConfig(empty.shape, 0.1)).decode(FieldCodec(FieldConfig(empty.shape, 0.1)).encode(empty))).all()
    one = np.array([[[42.5]]], np.float32)
    assert abs(FieldCodec(FieldConfig((1, 1, 1), 0.01)).decode(FieldCodec(FieldConfig((1, 1, 1), 0.01)).encode(one))[0, 0, 0] - 42.5) <= 0.01
    c = FieldCodec(FieldConfig((1, 2, 2), 0.1, missing_value=-999.0))
    assert c.decode(c.encode(np.array([[1, -999], [np.inf, 2]]))).ravel()[[1, 2]].tolist() == [-999, -999]
    huge = FieldCodec(FieldConfig((1, 1, 2), 0.01))
    assert huge.decode(huge.encode(np.array([[3e30, 1.0]]))).ravel()[0] == np.float32(3e30)
    with pytest.raises(ValueError):
        FieldCodec(FieldConfig((1, 2, 3), 0.1)).decode(c.encode(np.ones((2, 2))))
    with pytest.raises(ValueError):
        c.decode(c.encode(np.ones((2, 2))), np.empty((1, 2, 2)))


def test_config():
    c = FieldConfig((4, 5), 0.1)
    assert c.shape == (1, 4, 5) and FieldConfig.from_config(c.get_config()).get_config() == c.get_config()
    assert check_bound(0) == 0 and math.isnan(check_missing("NaN")) and check_shape([2, 3, 4]) == (2, 3, 4)
    assert derive_step(0) == 2 * np.finfo(np.float32).eps
    for bad in (-0.1, math.inf, math.nan):
        with pytest.raises(ValueError):
            check_bound(bad)
    for bad in ("0.1", True, None):
        with pytest.raises(TypeError):
            check_bound(bad)
    for bad in ((0, 3, 4), (2,), (2, 3, 4, 5), (1.5, 3, 4), (True, 2, 3)):
        with pytest.raises(ValueError):
            check_shape(bad)
    for bad in ("fill", math.inf):
        with pytest.raises(ValueError):
            check_missing(bad)
    for bad in ({"id": "x", "shape": [1, 2], "error_bound": 1}, {"id": "fieldpress", "shape": [1, 2]}):
        with pytest.raises(ValueError):
            FieldConfig.from_config(bad)
    with pytest.raises(ValueError):
        FieldConfig((1, 2), 0.1, dtype="int32")


def test_bits_that_spell_the_magic_come_back():
    bits = np.unpackbits(np.frombuffer(RLE_MAGIC + b"\xa5\x5a\x99", np.uint8), bitorder="little").astype(bool)
    assert (unpack_mask(pack_mask(bits), len(bits)) == bits).all()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 2049, 50_000])
def test_lanes(n):
    rng = np.random.default_rng(n)
    s = np.round(rng.laplace(0, 6, n)).astype(np.int64)
    if n:
        low = int(s.min())
        counts = symbols.context_counts(s)
        tables = np.array([normalize_np(c) for c in counts])
        data = rans.encode(s - low, tables, symbols.contexts(s))
        assert (rans.decode(data, n, tables, symbols.BUCKETS, low) + low == s).all()
        if n > 1024:
            with pytest.raises(ValueError):
                rans.decode(data[:-2], n, tables, symbols.BUCKETS, low)
    assert (symbols.decode_symbols(symbols.encode_symbols(s), n) == s).all()
