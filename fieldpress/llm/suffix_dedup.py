"""Operator 8: byte-level repeats through a hash-compared suffix sort.

Every 200-byte string that starts twice, in one document or in two, is removed wherever it stands. A suffix
array over all bytes can't be sorted by a cluster without shuffling many times the corpus, so the sort is
sparse and in buckets: ``repeats`` leaves the suffixes whose anchor (the smallest 64-byte run of each string)
stands more than once, and brings the different contexts of one anchor together. A bucket's suffixes are put in order by a
mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
hashes (8 steps for 200 bytes). Neighbours whose extension reaches 200 bytes are compared byte by byte, so that
no hash collision joins them. All removals come out of that order: it gives runs of repeated strings in a context,
with a digest of their bytes, and a place where the same context stands loses them if its own bytes have that digest.
Anchors with many contexts are made longer until they have few (``repeats.HOT``).

Defined cases: a null or empty text has no bytes; texts of under 200 bytes lose nothing; rows without a doc_id
neither give nor take strings; equal rows repeat each other; every input row gives one output row. The kept
bytes may end inside a UTF-8 sequence, so operators get them as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import _INVERSE, BYTES, _power, prefix
from .repeats import Kind
from .substring_dedup import covered, with_removals


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def _cut_bytes(raw: bytes, x: None, start: int, end: int) -> bytes:
    return raw[start:end]


def _byte_hashes(sent: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(sent, np.uint8)]


def _classes(sent: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    return Suffixes(np.frombuffer(sent, np.uint8), starts, length).classes()


def _digest(sent: bytes) -> int:
    return xxhash.xxh3_64_intdigest(sent) - (1 << 63)


def byte_kind(window: int) -> Kind:
    return Kind(_units, window, max(1, window * 8 // 25), _cut_bytes, _byte_hashes, _classes, _digest)


class Suffixes:
    """Suffixes of ``data`` that start at ``starts``, compared over ``length`` bytes each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.data, self.starts, self.length = data, starts, length
        self.p, self.back = prefix(BYTES[data]), _power(_INVERSE, len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, by binary search over prefix hashes."""
        low, step = np.zeros(len(a), np.int64), 1 << (self.length.bit_length() - 1)
        while step:
            to = np.minimum(low + step, self.length)
            same = (self.p[a + to] - self.p[a]) * self.back[a] == (self.p[b + to] - self.p[b]) * self.back[b]
            low = np.where(same, to, low)
            step >>= 1
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        last = len(self.data) - 1
        return (n < self.length) & (self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)])

    def order(self) -> np.ndarray:
        """Indices of ``starts`` in suffix order (stable). Runs of equal first 8 bytes are found by one integer sort; mergesort orders inside them."""
        s = self.starts
        head = np.zeros(len(s), np.uint64)
        for i in range(8):
            head = (head << np.uint64(8)) | (self.data[s + i].astype(np.uint64) if i < self.length else np.uint64(0))
        order = np.argsort(head, kind="stable")
        key = head[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        run, longest = 1, int(size.max(initial=0))
        while run < longest:
            at = np.flatnonzero(end - begin > run)
            b, e = begin[at], end[at]
            mine = (at - b) // run
            other = b + (mine ^ 1) * run
            low, high = np.minimum(other, e), np.minimum(other + run, e)
            left, base = mine % 2 == 0, np.minimum(other, e)
            me = s[order[at]]
            while (open_ := low < high).any():
                mid = (low + high) // 2
                i = np.flatnonzero(open_)
                you = s[order[mid[i]]]
                # A suffix of the left run goes before equal ones of the right run.
                down = np.where(left[i], self.less(you, me[i]), ~self.less(me[i], you))
                low[i] = np.where(down, mid[i] + 1, low[i])
                high[i] = np.where(down, high[i], mid[i])
            place = b + (mine - mine % 2) * run + (at - b - mine * run) + (low - base)
            moved = order.copy()
            moved[place] = order[at]
            order = moved
            run *= 2
        return order

    def classes(self) -> np.ndarray:
        """A number for each start: equal for those whose ``length`` bytes are equal, verified byte by byte."""
        order = self.order()
        a, b = self.starts[order[:-1]], self.starts[order[1:]]
        same = self.common(a, b) >= self.length
        at = np.flatnonzero(same)
        for some in np.array_split(at, max(1, len(at) * self.length // (1 << 22))):
            reach = np.arange(self.length)
            same[some] = (self.data[a[some][:, None] + reach] == self.data[b[some][:, None] + reach]).all(axis=1)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.r_[0, ~same][: len(order)])
        return out


def _judged(window: int, whole: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * whole)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist()):
                data = kept = text.encode("utf-8", "surrogatepass")
                gone = runs = 0
                spans = [r for r in spans or () if _digest(data[r["s"] : r["s"] + r["n"] + window - 1]) == r["digest"]]
                if spans:
                    mask = covered(len(data), spans, window)
                    gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                out.append((doc, len(data), gone, runs, hashlib.sha256(kept).hexdigest()) + (kept,) * whole)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows


def remove_repeated_bytes(docs: DataFrame, window: int = 200, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also the kept bytes as ``kept``."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    found = with_removals(docs, byte_kind(window), False)
    return found.select("doc_id", "text", "spans").mapInArrow(_judged(window, texts), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
