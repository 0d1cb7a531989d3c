"""Static range coding by asymmetric numeral systems (Duda, 2013) in lanes, with 16-bit tables and 16-bit renormalisation.

The symbols are cut into lanes of equal length (the last may be shorter), each with a state of its own in
[2**16, 2**32); a NumPy step takes one symbol of every lane. Symbols are fed last to first, so that decoding reads forwards. Stream,
little-endian: u32 number of lanes, u32 state of each, then u16 words in the order in which decoding asks for them: step by
step, lane by lane. ``tables`` are rows of frequencies; ``context`` chooses a row per symbol.
"""

from __future__ import annotations

import struct

import numpy as np

from .freqs import SCALE, SCALE_BITS

LOW = 1 << 16
#: Symbols of a lane at least, and lanes at most.
LANE, LANES = 1024, 4096


def lane_length(n: int) -> int:
    """Symbols of each lane but the last."""
    return -(-n // max(1, min(LANES, n // LANE))) if n else 0


def _checked(tables: np.ndarray) -> np.ndarray:
    tables = np.atleast_2d(np.asarray(tables, np.int64))
    if (tables < 0).any():
        raise ValueError("negative frequency")
    if not np.isin(tables.sum(axis=1), (0, SCALE)).all():
        raise ValueError(f"a table's sum is neither 0 nor {SCALE}")
    return tables


def _steps(values: np.ndarray, length: int, fill: int) -> np.ndarray:
    """A row per step with a cell per lane; cells behind the last symbol hold ``fill``."""
    lanes = -(-len(values) // length)
    out = np.full(lanes * length, fill, np.uint32)
    out[: len(values)] = values
    return np.ascontiguousarray(out.reshape(lanes, length).T)


def encode(index: np.ndarray, tables: np.ndarray, context: np.ndarray | None = None) -> bytes:
    tables = _checked(tables)
    index = np.asarray(index, np.int64)
    if len(index) and (index.min() < 0 or index.max() >= tables.shape[1]):
        raise ValueError("symbol outside the table")
    at = index if context is None else context * tables.shape[1] + index
    f = tables.ravel()[at]
    if (f == 0).any():
        raise ValueError("symbol without probability")
    if not len(index):
        return struct.pack("<I", 0)
    length = lane_length(len(index))
    # A frequency of SCALE leaves a state as it is: lanes that have ended stay out of the way.
    f = _steps(f, length, SCALE)
    start = _steps((np.cumsum(tables, axis=1) - tables).ravel()[at], length, 0)
    x = np.full(f.shape[1], LOW, np.uint32)
    words, sent = np.empty(f.shape, np.uint16), np.empty(f.shape, bool)
    bits = np.uint32(SCALE_BITS)
    for step in range(length - 1, -1, -1):
        full = (x >> bits) >= f[step]
        words[step], sent[step] = x, full
        x = np.where(full, x >> bits, x)
        whole = x // f[step]
        x = (whole << bits) + (x - whole * f[step]) + start[step]
    return struct.pack("<I", len(x)) + x.astype("<u4").tobytes() + words[sent].astype("<u2").tobytes()


def decode(data: bytes, n: int, tables: np.ndarray, buckets: tuple[int, int] | None = None, lowest: int = 0) -> np.ndarray:
    """n indices. With ``buckets`` the row follows the magnitude of the symbol before in the lane (index + lowest); the first has row 0."""
    tables = _checked(tables)
    if len(data) < 4:
        raise ValueError("truncated stream")
    (lanes,) = struct.unpack_from("<I", data)
    length = lane_length(n)
    if lanes != (-(-n // length) if n else 0):
        raise ValueError(f"{lanes} lanes for {n} symbols")
    if len(data) < 4 + 4 * lanes or len(data) % 2:
        raise ValueError("truncated stream")
    if not n:
        return np.zeros(0, np.int64)
    x = np.frombuffer(data, "<u4", lanes, 4).astype(np.uint32)
    words = np.frombuffer(data, "<u2", offset=4 + 4 * lanes).astype(np.uint32)
    # By row and slot: the symbol, its frequency, and the slot's place among those of the symbol.
    symbol, freq, place = (np.zeros((len(tables), SCALE), np.uint32) for _ in range(3))
    for r, t in enumerate(tables):
        if t.any():
            symbol[r] = np.repeat(np.arange(t.size), t)
            freq[r] = t[symbol[r]]
            place[r] = np.arange(SCALE) - (np.cumsum(t) - t)[symbol[r]]
    symbol, freq, place = symbol.ravel(), freq.ravel(), place.ravel()
    row_of = None
    if buckets:
        size = np.abs(np.arange(tables.shape[1]) + lowest)
        row_of = ((size > buckets[0]).astype(np.uint32) + (size > buckets[1])) << np.uint32(SCALE_BITS)
    row = np.zeros(lanes, np.uint32)
    out, at, bits, low = np.zeros((length, lanes), np.uint32), 0, np.uint32(SCALE_BITS), np.uint32(SCALE - 1)
    short = n - (lanes - 1) * length  # symbols of the last lane
    for step in range(length):
        if step == short:
            x, row = x[:-1], row[:-1]
        slot = row + (x & low)
        s = symbol[slot]
        x = freq[slot] * (x >> bits) + place[slot]
        need = np.flatnonzero(x < LOW)
        if at + len(need) > len(words):
            raise ValueError("truncated stream")
        x[need] = x[need] << bits | words[at : at + len(need)]
        at += len(need)
        out[step, : len(s)] = s
        if row_of is not None:
            row = row_of[s]
    return out.T.ravel()[:n].astype(np.int64)
