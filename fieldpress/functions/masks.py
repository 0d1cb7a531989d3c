"""Packed missing masks: run lengths if strictly smaller, else 8 cells a byte, lowest bit first.

A bit mask whose first bytes happen to spell the magic of run lengths would be taken for them, so it is written as run lengths.
"""

from __future__ import annotations

import numpy as np

from .ints import varint_pack, varint_unpack

#: Fixed value: the first bytes of a run-length mask.
RLE_MAGIC = b"HMR1"


def pack_mask(missing: np.ndarray) -> bytes:
    flat = np.asarray(missing, bool).ravel()
    if not len(flat):
        return b""
    edges = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    runs = RLE_MAGIC + bytes([int(flat[0])]) + varint_pack(np.diff(edges))
    bits = np.packbits(flat, bitorder="little").tobytes()
    return runs if len(runs) < len(bits) or bits.startswith(RLE_MAGIC) else bits


def unpack_mask(data: bytes, n: int) -> np.ndarray:
    if data.startswith(RLE_MAGIC):
        if len(data) < 5:
            raise ValueError("truncated run-length mask")
        body = data[5:]
        count = int(np.count_nonzero(np.frombuffer(body, np.uint8) < 128))
        if body and body[-1] >= 128:
            raise ValueError("bad varint in run-length mask")
        runs = varint_unpack(body, count).astype(np.int64)
        ends = np.cumsum(runs)
        if len(ends) and ends[-1] > n:
            if (ends >= n).argmax() < len(ends) - 1 and n in ends:
                raise ValueError("trailing bytes after run-length mask")
            raise ValueError("a run is too long for the mask")
        if not len(ends) or ends[-1] < n:
            raise ValueError("truncated run-length mask")
        return np.repeat((np.arange(len(runs)) + data[4]) % 2 == 1, runs)
    if len(data) != -(-n // 8):
        raise ValueError(f"bit mask of {len(data)} bytes for {n} cells")
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)
