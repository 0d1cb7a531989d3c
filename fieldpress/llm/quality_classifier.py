"""Operator 6: quality by random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing (Kanerva et al., 2000): each term has a sparse random index vector, drawn from its hash; a
term's context vector is the sum of the index vectors of its neighbours within two words. Terms are words (A-Z lower-cased)
and their shapes (runs of capitals, letters, digits; signs as they are; one of their own for words that repeat the
one before), so that unknown words are known by shape.
A document is the mean of its words' and of its shapes' vectors. The network's logits are divided by a temperature
fitted on rows that it wasn't trained on.

Contexts are those of all words of all documents. Terms go to ``WORDS`` + ``SHAPES`` rows by hash, whatever their number, so
that tasks, shuffle, driver and broadcast hold tables of one size at any input, and no word is left out: rare words
that share a row share a vector. Tasks sum contexts up as integers, a shuffle by row adds the sums.

The network alone is fitted on a sample: the ``SAMPLE`` labelled documents with the smallest hashes of doc_id, and the first
of the other kind where those have one kind of label only. Their whole texts, of any length, are pooled by tasks; the driver
gets a vector for each. Every document is scored over its whole text. Inputs are words alone.

Defined cases: a null or empty text has the zero vector and gets the score of that; labels with a null are left out, of
several the largest counts, of several texts of a doc_id that with the smallest hash is fitted on; without labels every score is 0.5, with one kind it is 0 or 1 smoothed by the sample's size;
a null doc_id is scored too and held_out is null; equal texts get equal scores; columns besides doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _INVERSE, _PIECE, _SPACE, BYTES, _power, mix, numbered, prefix, span_hash, written

SAMPLE = 3_000
DIM, REACH, HIDDEN = 64, 2, 32
#: Rows of the table of vectors: for words, and after those for shapes, of which the first is that of words that repeat the one before.
WORDS, SHAPES = 1 << 17, 1 << 12
ROWS = WORDS + SHAPES
SAME = WORDS
#: Parts of the table that are summed up apart; tokens that are worked on at a time; tokens after which a task sends its sums.
PARTS, CHUNK, TOKENS = 64, 8192, 20_000_000
#: Vectors are held as integers of this unit.
UNIT = 1 / 16_384
THRESHOLD = 0.3


# ---------------------------------------------------------------- terms
def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 65, 97, 97, 48
    return lower, kind


_LOWER, _KIND = _classes()


def _rows_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, shape row) of the words of UTF-8 text; no word is made an object."""
    x = np.frombuffer(data, np.uint8)
    space = _SPACE[x]
    change = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, end = change[::2], change[1::2]
    if not len(start):
        return start, start, start
    low = _LOWER[x]
    p = prefix(BYTES[low])
    word = mix((p[end] - p[start]) * _power(_INVERSE, len(p))[start] + (end - start).astype(np.uint64))
    # A shape: the classes of the bytes, of a run of letters or digits one, of a run of the same sign two.
    kind = _KIND[x]
    kind[space] = 0
    again = np.r_[False, kind[1:] == kind[:-1]]
    sign = (kind != 65) & (kind != 97) & (kind != 48)
    kept = ~again | sign & ~np.r_[False, again[:-1]]
    place = np.cumsum(kept)
    q = prefix(BYTES[kind[kept]])
    shape = span_hash(q, place[start] - 1, place[end - 1])
    return start, (word >> np.uint64(32)).astype(np.int64) % WORDS, WORDS + 1 + (shape >> np.uint64(32)).astype(np.int64) % (SHAPES - 1)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words and of the shapes of all texts in a row, and how many words each text has."""
    whole = b"\n".join(texts)
    parts, at = [], 0
    while at < len(whole):  # cut at white space, so that memory doesn't grow with the text
        end = at + _PIECE
        while end < len(whole) and not _SPACE[whole[end]]:
            end += 1
        start, word, shape = _rows_of(whole[at:end])
        parts.append((start + at, word.astype(np.int32), shape.astype(np.int32)))
        at = end
    start, word, shape = (np.concatenate([np.empty(0, np.int32), *c]) for c in (zip(*parts) if parts else ((), (), ())))
    count = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    first = np.cumsum(count) - count
    again = np.r_[False, word[1:] == word[:-1]][: len(word)]
    again[first[(count > 0)]] = False
    shape[again] = SAME
    return word, shape, count


def encoded(texts: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts]


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > _PIECE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield some


def index_vectors() -> np.ndarray:
    """8 of DIM places are +1 or -1, by the row's hash; behind the last row there is a zero one."""
    parts = mix(np.arange(1, ROWS + 1, dtype=np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)
    out, at = np.zeros((ROWS + 1, DIM), np.int32), np.arange(ROWS)
    for part in parts.T:
        out[at, (part >> 1) % DIM] += 2 * (part & 1).astype(np.int32) - 1
    return out.astype(np.int8)


# ---------------------------------------------------------------- contexts of all terms
class Contexts:
    """Sums of the contexts of the terms of texts."""

    def __init__(self):
        self.index = index_vectors()
        self.clear()

    def clear(self) -> None:
        self.sums, self.met, self.tokens = np.zeros((ROWS + 1, DIM), np.int32), np.zeros(ROWS + 1, bool), 0

    def add(self, word: np.ndarray, shape: np.ndarray, count: np.ndarray) -> None:
        count = count[count > 0]
        n = len(word)
        # Between texts there is a gap as wide as a word's reach, of the row behind the last.
        at = np.arange(n) + np.repeat(np.arange(1, len(count) + 1) * REACH, count)
        a = np.full(n + (len(count) + 1) * REACH, ROWS, np.int32)
        b = a.copy()
        a[at], b[at] = word, shape
        for low in range(0, len(a), CHUNK):
            begin, end = max(low - REACH, 0), min(low + CHUNK + REACH, len(a))
            own = self.index[b[begin:end]].astype(np.int32)
            v = own + self.index[a[begin:end]]
            around = own  # a term's own shape is part of its context
            for k in range(1, REACH + 1):
                around[k:] += v[:-k]
                around[:-k] += v[k:]
            some = slice(low - begin, low - begin + min(CHUNK, len(a) - low))
            around = around[some]
            for u in (a[begin:end][some], b[begin:end][some]):
                order = np.argsort(u, kind="stable")
                u = u[order]
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                self.sums[u[first]] += np.add.reduceat(around[order], first, axis=0)
                self.met[u[first]] = True
        self.tokens += n

    def parts(self) -> pa.RecordBatch:
        """PARTIAL: a row for each part of the table that has been met."""
        rows, met = [], self.met[:ROWS]
        for part in range(PARTS):
            at = np.flatnonzero(met[part::PARTS])
            if len(at):
                kind, data = packed(self.sums[part:ROWS:PARTS][at])
                rows.append((part, at.astype("<u4").tobytes(), kind.tobytes(), data))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, types)], names=["part", "rows", "kinds", "sums"])


WIDTHS = np.array([DIM // 2, DIM, 4 * DIM])


def packed(x: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Rows of integers with 4, 8 or 32 bits a number, whichever holds the row: places in WIDTHS, and bytes."""
    most = np.abs(x.astype(np.int64)).max(axis=1, initial=0)
    kind = (most > 7).astype(np.uint8) + (most > 127)
    ends = np.r_[0, np.cumsum(WIDTHS[kind])]
    out = np.zeros(ends[-1], np.uint8)
    for k, w in enumerate(WIDTHS):
        y = x[kind == k]
        y = (y[:, ::2] & 15 | (y[:, 1::2] & 15) << 4).astype(np.uint8) if k == 0 else y.astype(np.int8 if k == 1 else "<i4").view(np.uint8)
        out[ends[:-1][kind == k][:, None] + np.arange(w)] = y
    return kind, out.tobytes()


def unpacked(kind: np.ndarray, data: bytes) -> np.ndarray:
    data, ends, out = np.frombuffer(data, np.uint8), np.r_[0, np.cumsum(WIDTHS[kind])], np.zeros((len(kind), DIM), np.int64)
    for k, w in enumerate(WIDTHS):
        y = data[ends[:-1][kind == k][:, None] + np.arange(w)]
        y = np.stack([y & 15, y >> 4], axis=2).reshape(-1, DIM).astype(np.int64) if k == 0 else y.view(np.int8 if k == 1 else "<i4")
        out[kind == k] = (y ^ 8) - 8 if k == 0 else y
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Contexts()
    for batch in batches:
        for some in _portions(encoded(batch["text"])):
            found.add(*terms(some))
            if found.tokens > TOKENS:
                yield found.parts()
                found.clear()
    if found.tokens:
        yield found.parts()


PARTIAL = "part int, rows binary, kinds binary, sums binary"
SUMMED = "part int, met binary, vectors binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From PARTIAL sorted by part: which rows have been met, and their contexts with length 1."""
    names = ["part", "met", "vectors"]

    def row(part: int, sums: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([met.tobytes()]), pa.array([v.astype("<f2").tobytes()])], names=names)

    last, sums, met = None, None, None
    for batch in batches:
        for part, rows, kinds, data in zip(batch["part"].to_pylist(), batch["rows"], batch["kinds"], batch["sums"]):
            if part != last:
                if last is not None:
                    yield row(last, sums, met)
                size = len(range(part, ROWS, PARTS))
                last, sums, met = part, np.zeros((size, DIM), np.int64), np.zeros(size, bool)
            at = np.frombuffer(rows.as_buffer(), "<u4")
            sums[at] += unpacked(np.frombuffer(kinds.as_buffer(), np.uint8), data.as_buffer())
            met[at] = True
    if last is not None:
        yield row(last, sums, met)


def no_vectors() -> np.ndarray:
    return np.zeros((ROWS, DIM), np.int16)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all rows, in units of UNIT: their contexts in all documents, less the mean of all; zero where none was met."""
    sums = docs.select("text").mapInArrow(_partial, PARTIAL)
    summed = written(sums.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, SUMMED), "contexts")
    parts = [(r["part"], np.frombuffer(r["met"], bool), np.frombuffer(r["vectors"], "<f2").reshape(-1, DIM)) for r in summed.toLocalIterator()]  # PARTS rows
    out = no_vectors()
    # The shared direction of all contexts says nothing; what is left is what tells terms apart.
    parts.sort(key=lambda r: r[0])
    mean = sum((v.sum(axis=0, dtype=np.float64) for _, _, v in parts), np.zeros(DIM)) / max(1, sum(int(met.sum()) for _, met, _ in parts))
    for part, met, v in parts:
        out[part::PARTS] = np.where(met[:, None], np.rint((v.astype(np.float64) - mean) / UNIT).clip(-32_767, 32_767), 0)
    return out


# ---------------------------------------------------------------- texts' vectors
def pooled(vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The means of the vectors of each text's words and shapes: a row for each text. Sums are of integers, so equal texts have equal rows."""
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    done = 0
    for some in _portions(texts):
        word, shape, count = terms(some)
        of = np.repeat(np.arange(len(some)), count)
        total = np.zeros((len(some), 2 * DIM), np.int64)
        for at in range(0, len(of), CHUNK):
            part = slice(at, at + CHUNK)
            first = np.flatnonzero(np.r_[True, of[part][1:] != of[part][:-1]])
            for side, u in ((slice(0, DIM), word), (slice(DIM, None), shape)):
                total[of[part][first], side] += np.add.reduceat(vectors[u[part]].astype(np.int32), first, axis=0)
        out[done : done + len(some)] = total * UNIT / np.maximum(count, 1)[:, None]
        done += len(some)
    return out


# ---------------------------------------------------------------- the network
@dataclass
class Model:
    vectors: Broadcast  # of an array
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-self.logits(x).astype(np.float64) / self.temperature))).clip(0, 1)


def fit(x: np.ndarray, labels: list[int], vectors: Broadcast, seed: int = 17) -> Model:
    """``x``: the pooled vectors of the labelled documents."""
    y = np.array(labels, np.float64)
    zero = np.zeros(2 * DIM)
    model = Model(vectors, zero, zero + 1, np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        model.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 5], order[len(y) // 5 :]
    model.centre, model.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - model.centre) / model.scale
    net = [rng.normal(0, (2 * DIM) ** -0.5, (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
    mean, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    step = 0
    for _ in range(60):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            hidden = np.tanh(z[some] @ net[0] + net[1])
            d = (1 / (1 + np.exp(-(hidden @ net[2] + net[3]))) - y[some]) / len(some)
            back = d[:, None] * net[2] * (1 - hidden**2)
            grads = [z[some].T @ back + 1e-3 * net[0], back.sum(axis=0), hidden.T @ d + 1e-3 * net[2], d.sum()]
            step += 1
            for p, g, m, s in zip(net, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = net[0], net[1], net[2], float(net[3])
    if len(apart):
        out = model.logits(x[apart])
        heat = np.exp(np.linspace(-2, 3, 101))
        loss = [np.logaddexp(0, np.where(y[apart] > 0, -out, out) / t).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
    return model


# ---------------------------------------------------------------- documents
def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, quality, place) of the bounded sample; where only one kind of label is in it, the first of the other kind is added."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    one = one.join(texts.select("doc_id"), "doc_id", "left_semi")
    ends = [some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for some, n in ((one, sample), (one.filter("quality > 0"), 1), (one.filter("NOT quality > 0"), 1))]
    chosen = written(ends[0].union(ends[1]).union(ends[2]).distinct(), "labelled")  # at most ``sample`` rows and one
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows.select("text", "quality", F.xxhash64("doc_id").alias("place"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = written(training_rows(docs, labels), "training")
    kinds = [r["kind"] for r in rows.select((F.col("quality") > 0).alias("kind")).distinct().collect()]
    # Without labels of both kinds no score depends on a vector.
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs) if len(kinds) > 1 else no_vectors())

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(shared.value, encoded(batch["text"]))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch["place"], batch["quality"]], names=["x", "place", "quality"])

    rows = rows.select("text", "place", F.col("quality").cast("int").alias("quality"))
    found = sorted(rows.mapInArrow(vectors_of, "x binary, place long, quality int").collect(), key=lambda r: (r["place"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64).reshape(-1, 2 * DIM)
    return fit(x, [int(r["quality"] > 0) for r in found], shared)


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score between 0 and 1: higher where label 1 is likelier. Words' contexts are those of the documents of ``train``."""
    plain, text = numbered(docs), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                some = batch.slice(at, 500)
                x = pooled(model.vectors.value, encoded(some[text]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(model.scores(x), pa.float64())], names=[*some.schema.names, "score"])

    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, column)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; learned from labels that aren't held out."""
    model = train(docs, labels.filter(~held_out()))
    found = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
