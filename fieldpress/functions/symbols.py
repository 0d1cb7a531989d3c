"""Entropy coding of symbol streams: RAW, RANGE or CTX blocks of 2048 symbols, the cheapest by estimate.

Layout, little-endian: u32 blocks; a byte per block (width << 4 | mode); u64 length of the raw section and the section; then
for RANGE blocks u16 varint bytes each, u32 symbols, u32 + table varints, u32 + stream; or for CTX
u32 span, i64 smallest symbol, u32 tables, each u32 + varints, u32 + stream.
"""

from __future__ import annotations

import struct

import numpy as np

from . import rans
from .freqs import SCALE, normalize_np
from .ints import unzigzag_np, varint_pack, varint_unpack, zigzag_np

BLOCK, SPAN_LIMIT = 2048, 8192
RAW, RANGE, CTX = 0, 1, 2
BUCKETS = (1, 8)
#: Parts of the layout: number of blocks, length of the raw section, context tables, length of a table or stream.
BLOCKS, SECTION, TABLES, LENGTH = "<I", "Q", "<IqI", "<I"


def n_blocks(n: int) -> int:
    return -(-n // BLOCK)


def widths(symbols: np.ndarray) -> np.ndarray:
    """Bytes of a symbol of each block: the narrowest signed integer."""
    at = np.arange(0, len(symbols), BLOCK)
    low, high = np.minimum.reduceat(symbols, at), np.maximum.reduceat(symbols, at)
    out = np.full(len(at), 8)
    for bits in (32, 16, 8):
        out[(low >= -(1 << bits - 1)) & (high < 1 << bits - 1)] = bits // 8
    return out


def contexts(symbols: np.ndarray) -> np.ndarray:
    """The magnitude of the symbol before, in three classes; the first symbol of each coding lane has none before it."""
    before = np.abs(np.r_[0, symbols[:-1]].astype(np.int64))
    before[:: rans.lane_length(len(symbols))] = 0
    return (before > BUCKETS[0]).astype(np.int64) + (before > BUCKETS[1])


def context_counts(symbols: np.ndarray) -> np.ndarray | None:
    low = int(symbols.min())
    span = int(symbols.max()) - low + 1
    if span > SPAN_LIMIT:
        return None
    return np.bincount(contexts(symbols) * span + (symbols - low), minlength=3 * span).reshape(3, span)


def context_size(symbols: np.ndarray) -> float | None:
    """Estimated bytes of the CTX payload: conditional entropy, 3 bytes for each used entry, and the layout's fixed parts."""
    counts = context_counts(symbols)
    if counts is None:
        return None
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    bits = -(counts * np.log2(p, where=counts > 0, out=np.zeros_like(p))).sum()
    fixed = struct.calcsize(BLOCKS + SECTION) + struct.calcsize(TABLES) + 4 * struct.calcsize(LENGTH)
    return bits / 8 + fixed + len(symbols) // BLOCK + 3 * int((counts > 0).sum())


def _range_choice(pieces: list[np.ndarray], raw_sizes: np.ndarray) -> np.ndarray:
    """Which blocks are range coded: up to 4 rounds of building the shared table from the chosen ones and choosing again."""
    chosen = np.ones(len(pieces), bool)
    histograms = np.array([np.bincount(p, minlength=256) for p in pieces])
    for _ in range(4):
        f = normalize_np(histograms[chosen].sum(axis=0) if chosen.any() else np.zeros(256, np.int64))
        cost = np.where(f > 0, -np.log2(np.maximum(f, 1) / SCALE), 0.0)  # a byte that no chosen block has costs nothing
        again = histograms @ cost / 8 + 2 < raw_sizes
        if (again == chosen).all():
            break
        chosen = again
    return chosen


def _sized(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _range_payload(symbols: np.ndarray) -> bytes:
    width = widths(symbols)
    blocks = np.split(symbols, np.arange(BLOCK, len(symbols), BLOCK))
    varints = [varint_pack(zigzag_np(b)) for b in blocks]
    raw = [b.astype(f"<i{w}").tobytes() for b, w in zip(blocks, width)]
    chosen = _range_choice([np.frombuffer(v, np.uint8) for v in varints], np.array([len(r) for r in raw]))
    section = b"".join(r for r, c in zip(raw, chosen) if not c)
    out = [struct.pack("<I", len(blocks)), bytes((w << 4 | (RANGE if c else RAW)) for w, c in zip(width.tolist(), chosen)), struct.pack("<Q", len(section)), section]
    if chosen.any():
        some = [v for v, c in zip(varints, chosen) if c]
        stream = np.frombuffer(b"".join(some), np.uint8)
        f = normalize_np(np.bincount(stream, minlength=256))
        out.append(struct.pack(f"<{len(some)}HI", *map(len, some), sum(len(b) for b, c in zip(blocks, chosen) if c)))
        out.append(_sized(varint_pack(f.astype(np.uint64)), rans.encode(stream, f)))
    return b"".join(out)


def _context_payload(symbols: np.ndarray) -> bytes | None:
    counts = context_counts(symbols)
    if counts is None:
        return None
    low, blocks = int(symbols.min()), n_blocks(len(symbols))
    tables = np.array([normalize_np(c) for c in counts])
    stream = rans.encode(symbols - low, tables, contexts(symbols))
    head = struct.pack("<I", blocks) + bytes([CTX]) * blocks + struct.pack("<QIqI", 0, counts.shape[1], low, 3)
    return head + _sized(*(varint_pack(t.astype(np.uint64)) for t in tables), stream)


def encode_symbols(symbols: np.ndarray) -> bytes:
    symbols = np.asarray(symbols, np.int64)
    if not len(symbols):
        return b""
    estimate = context_size(symbols)
    last = len(symbols) - (n_blocks(len(symbols)) - 1) * BLOCK
    sizes = np.full(n_blocks(len(symbols)), BLOCK)
    sizes[-1] = last
    if estimate is not None and estimate < int((widths(symbols) * sizes).sum()):
        return _context_payload(symbols)
    a, b = _range_payload(symbols), _context_payload(symbols)
    return b if b is not None and len(b) < len(a) else a


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, fmt: str) -> tuple:
        out = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return out

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def decode_symbols(payload: bytes, n: int) -> np.ndarray:
    if not n:
        if payload:
            raise ValueError("a payload for no symbols")
        return np.zeros(0, np.int64)
    r = _Reader(payload)
    (found,) = r.unpack("<I")
    if found != n_blocks(n):
        raise ValueError(f"{found} blocks instead of {n_blocks(n)}")
    modes = r.take(found)
    raw = r.take(r.unpack("<Q")[0])
    sizes = [min(BLOCK, n - i * BLOCK) for i in range(found)]
    kinds = [m & 15 for m in modes]
    parts: list[np.ndarray | None] = [None] * found
    at = 0
    for i, m in enumerate(modes):
        if kinds[i] == RAW:
            size = (m >> 4) * sizes[i]
            if at + size > len(raw):
                raise ValueError("truncated raw section")
            parts[i] = np.frombuffer(raw, f"<i{m >> 4}", sizes[i], at).astype(np.int64)
            at += size
    if some := [i for i in range(found) if kinds[i] == CTX]:
        span, low, tables = r.unpack("<IqI")
        if tables != 3:
            raise ValueError(f"{tables} context tables instead of 3")
        freqs = np.array([varint_unpack(r.take(r.unpack("<I")[0]), span).astype(np.int64) for _ in range(3)])
        values = rans.decode(r.take(r.unpack("<I")[0]), sum(sizes[i] for i in some), freqs, BUCKETS, low) + low
        for i, part in zip(some, np.split(values, np.cumsum([sizes[i] for i in some])[:-1])):
            parts[i] = part
    if some := [i for i in range(found) if kinds[i] not in (RAW, CTX)]:
        counts = r.unpack(f"<{len(some)}H")
        (total,) = r.unpack("<I")
        freqs = varint_unpack(r.take(r.unpack("<I")[0]), 256).astype(np.int64)
        stream = rans.decode(r.take(r.unpack("<I")[0]), sum(counts), freqs)
        values = unzigzag_np(varint_unpack(stream.astype(np.uint8).tobytes(), total))
        for i, part in zip(some, np.split(values, np.cumsum([sizes[i] for i in some])[:-1])):
            parts[i] = part
    return np.concatenate(parts)


def modes_of(payload: bytes) -> list[int]:
    if not payload:
        return []
    (n,) = struct.unpack_from("<I", payload)
    return [b & 15 for b in payload[4 : 4 + n]]


def pack_repairs(positions: np.ndarray, values: np.ndarray, dtype: str) -> bytes:
    if len(positions) != len(values):
        raise ValueError("positions and values differ in number")
    return struct.pack("<I", len(positions)) + b"".join(struct.pack("<q", p) + v.tobytes() for p, v in zip(positions.tolist(), np.asarray(values, np.dtype(dtype).newbyteorder("<"))))


def unpack_repairs(data: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype([("p", "<i8"), ("v", np.dtype(dtype).newbyteorder("<"))])
    if len(data) < 4:
        raise ValueError("truncated repairs")
    (n,) = struct.unpack_from("<I", data)
    if len(data) < 4 + n * kind.itemsize:
        raise ValueError("truncated repairs")
    rows = np.frombuffer(data, kind, n, 4)
    return rows["p"].astype(np.int64), rows["v"].astype(dtype)
