"""Framed streams: prefix, JSON header, mask, residuals, CRC-32. See ``LAYOUT``.

LAYOUT, little-endian: magic(4) u16 version, u16 flags, u32 model version, u32 header length; header JSON (sorted keys, no blanks);
u64 + mask; u64 + residuals; u32 CRC-32 of all bytes before. Flags: 1 both payloads, 2 the mask, 4 the residuals are zstd.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import zstandard

MAGIC, VERSION, MODEL_VERSION, LEVEL = b"FPRS", 3, 3, 3
BOTH, MASK, RESIDUAL = 1, 2, 4
PREFIX = struct.Struct("<4sHHII")


class ContainerError(ValueError):
    """The bytes aren't a whole, supported container."""


@dataclass(frozen=True)
class Container:
    flags: int
    model_version: int
    header: dict
    mask: bytes
    residual: bytes


def write_container(header: dict, mask: bytes, residual: bytes, model_version: int = MODEL_VERSION, outer: bool = True) -> bytes:
    flags, payloads = 0, [mask, residual]
    if outer:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        small = [squeeze.compress(p) if p else p for p in payloads]
        better = [not p or len(s) < len(p) for p, s in zip(payloads, small)]
        payloads = [s if b else p for p, s, b in zip(payloads, small, better)]
        flags = BOTH if all(better) else MASK * better[0] + RESIDUAL * better[1]
    text = json.dumps(header, separators=(",", ":"), sort_keys=True).encode()
    body = PREFIX.pack(MAGIC, VERSION, flags, model_version, len(text)) + text
    body += b"".join(struct.pack("<Q", len(p)) + p for p in payloads)
    return body + struct.pack("<I", zlib.crc32(body))


def read_container(data: bytes) -> Container:
    if len(data) < PREFIX.size + 4:
        raise ContainerError("too short for a container")
    magic, version, flags, model, size = PREFIX.unpack_from(data)
    if magic != MAGIC:
        raise ContainerError(f"bad magic {magic!r}")
    if version != VERSION:
        raise ContainerError(f"unsupported version {version}")
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ContainerError("checksum mismatch")
    at, end = PREFIX.size + size, len(data) - 4
    if at > end:
        raise ContainerError("truncated header")
    try:
        header = json.loads(data[PREFIX.size : at])
    except ValueError as e:
        raise ContainerError(f"bad header: {e}") from None
    payloads = []
    for name in ("mask", "residual"):
        if at + 8 > end:
            raise ContainerError(f"truncated length of the {name}")
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 8 + n > end:
            raise ContainerError(f"truncated {name}")
        payloads.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    for i, flag in enumerate((BOTH | MASK, BOTH | RESIDUAL)):
        if flags & flag and payloads[i]:
            try:
                payloads[i] = zstandard.ZstdDecompressor().decompress(payloads[i], max_output_size=1 << 31)
            except zstandard.ZstdError as e:
                raise ContainerError(f"bad zstd payload: {e}") from None
    return Container(flags, model, header, *payloads)
