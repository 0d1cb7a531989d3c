"""Operator 3: benchmark decontamination by SimHash over item-sized windows.

An item's fingerprint is the 64-bit SimHash of its five-word shingles (Charikar, 2002). In a document every window
with as many words as an item is looked at. Fingerprints within ``RADIUS`` bits are found by multi-index hashing
(Norouzi, Punjani, Fleet, 2012): of 8 blocks of 8 bits one must be within RADIUS // 8, so for each block value there is a
row of bits that tells which items of the window's length are near, and no fingerprint within the radius is missed. Exact
weighted similarity (sum of minima over sum of maxima of the shingles' counts) verifies candidates. Windows that hold too few
shingles of any item to reach the similarity are passed over before, which loses nothing. RADIUS 20 is 3.6 standard
deviations above the distance expected at 0.8.

Documents are only mapped; different items are sent to the executors in blocks of at most ``ITEMS`` items and ``ITEM_BYTES``
of text, as many as there are.

Words are runs of letters and digits, lower-cased. Defined cases: null or empty texts match nothing; an item of under five
words is one shingle of its whole sequence and matches where that stands; documents shorter than an item are one window for
it; equal items each match; equal rows each give rows; null ids stay null; other columns aren't looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, mix, numbered, shingle_hashes

N, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 20, 8
ITEMS, ITEM_BYTES = 4096, 32 << 20
_WORDS = re.compile(r"[^\W_]+")
_HASHES = Hashes()


def normal_hashes(text: str | None) -> np.ndarray:
    words = _WORDS.findall(text.lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of the rows of a matrix of shingle hashes."""
    bits = np.unpackbits(mix(shingles).astype("<u8").view(np.uint8).reshape(*shingles.shape, 8), axis=-1)
    on = 2 * bits.sum(axis=1, dtype=np.int64) > shingles.shape[1]
    return np.packbits(on, axis=-1).view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


class _Length:
    """The items of one number of words, with the multi-index of their fingerprints."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        # near[b, v]: a bit for each item, set where its b-th block is within RADIUS // BLOCKS bits of v
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ blocks.T[:, None, :]) <= RADIUS // BLOCKS
        self.near = np.packbits(near, axis=2)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all items within RADIUS of a window's fingerprint."""
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        found = self.near[0, blocks[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.near[b, blocks[:, b]]
        window, at = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items)))
        good = np.bitwise_count(prints[window] ^ self.prints[at]) <= RADIUS
        return zip(window[good].tolist(), self.items[at[good]].tolist())


class Items:
    """A block of items, by their number of words."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found = [(i, h) for i, text in rows if len(h := normal_hashes(text))]
        self.ids = [i for i, _ in found]
        shingles = [shingle_hashes(h, N) for _, h in found]
        self.bags = [Counter(s.tolist()) for s in shingles]
        self.words = np.array([len(h) for _, h in found], np.int64)
        long = [s for s, m in zip(shingles, self.words.tolist()) if m >= N]
        self.known = np.unique(np.concatenate(long)) if long else np.empty(0, np.uint64)
        self.lengths, self.short = {}, {}
        for m in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == m)
            if m >= N:
                self.lengths[m] = _Length(at, np.array([simhash(shingles[i][None, :])[0] for i in at], np.uint64))
            else:
                self.short[m] = {}
                for i in at.tolist():
                    self.short[m].setdefault(int(shingles[i][0]), []).append(i)

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of each item that reaches SIMILARITY, the first of equals."""
        h = normal_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for m, table in self.short.items():
            if len(h) >= m:
                s = shingle_hashes(h, m)
                places = np.flatnonzero(np.isin(s, np.fromiter(table, np.uint64, len(table))))
                for start, value in zip(places.tolist(), s[places].tolist()):
                    for i in table[value]:
                        best.setdefault(i, (1.0, start, m))
        if len(h) >= N and len(self.known):
            self._near(h, best)
        return [(i, start, size, now) for i, (now, start, size) in best.items()]

    def _near(self, h: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        s = shingle_hashes(h, N)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        hit = self.known[at] == s
        if not hit.any():
            return
        hits = np.r_[0, np.cumsum(hit)]
        for m, items in self.lengths.items():
            size = min(m, len(h))
            k = size - N + 1
            enough = np.flatnonzero(hits[k:] - hits[:-k] >= np.ceil(SIMILARITY * (m - N + 1) - 1e-9))
            for some in np.array_split(enough, -(-len(enough) // 4096) or 1):
                if not len(some):
                    continue
                windows, bags = s[some[:, None] + np.arange(k)], {}
                for w, i in items.candidates(simhash(windows)):
                    if w not in bags:
                        bags[w] = Counter(windows[w].tolist())
                    now = similarity(bags[w], self.bags[i])
                    if now >= SIMILARITY and now > best.get(i, (0.0,))[0]:
                        best[i] = now, int(some[w]), size


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The different texts of benchmark (item_id, text), named by their hashes, in blocks of bounded size."""
    rows = benchmark.filter("text IS NOT NULL").select(F.xxhash64("text").alias("k"), "text").dropDuplicates(["k"])
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // ITEMS), -(-2 * size // ITEM_BYTES)) if n > ITEMS or size > ITEM_BYTES else 1
    for b in range(blocks):
        some = rows if blocks == 1 else rows.filter(F.pmod("k", F.lit(blocks)) == b)
        yield Items(sorted((r["k"], r["text"]) for r in some.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for each document and item it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by ITEMS and ITEM_BYTES

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                found = [(doc, items.ids[i], *rest) for doc, x in zip(batch["doc_id"].to_pylist(), batch["text"]) for i, *rest in items.leaks(x.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        part = docs.mapInArrow(rows, "doc_id long, k long, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    ids = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("k"))
    return out.join(ids, "k").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of benchmark, with all their columns."""
    names, text = docs.columns, docs.columns.index("text")
    docs = numbered(docs)
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(x.as_py()) for x in batch[text]], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs.toDF(*names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
