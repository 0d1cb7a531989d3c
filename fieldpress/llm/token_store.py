"""Operator 7: token ids in files of directly addressable codes (Brisaboa, Ladra, Navarro, 2013).

A frame holds whole documents in ascending doc_id order. Its ids are split into 8-bit chunks, lowest first: level 0
has a chunk of each id, level k + 1 one of each id that needs more than k + 1 chunks. A bitmap per level tells
which ids go on, and a rank directory (ones before each 512 bits) gives an id's place on the next level, so
that any token is read in a few steps without decoding a block.

Frame, little-endian: ``FPT1``, u32 levels, u64 documents, u64 ids; i64 doc_ids, u8 has-doc_id flags, u64 ends of
the documents; for each level u64 n, n chunks, ceil(n / 8) bitmap bytes, ceil(n / 512) u64 ranks. A file is
at most ``FRAMES`` frames of about a megabyte, each followed by one line end. Files are written by Spark's own committing writer,
so a lost task leaves nothing behind and any store that Spark reaches will do. Their order is that of the numbers in
their names: that of the task, then that of the file within the task.

Defined cases: a null or empty text has the end id alone; rows without doc_id come first and come back
without one; rows that share a doc_id stand next to each other, in order of their texts' hashes, and may be dealt to
several files; a text of any length is one document of one frame; empty tables make no frames and give no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, written
from .tokens import encoder, vocabulary

MAGIC = b"FPT1"
HEAD = struct.Struct("<4sIQQ")
FRAME_IDS = 1 << 18
#: Frames of a file at most, and bytes of text that a task is given.
FRAMES, TASK_BYTES = 256, 128 << 20
#: Files whose sizes are summed up together before those sums are.
RUN = 4096
RANK_BITS = 512


def pack_ids(ids: np.ndarray) -> list[bytes]:
    """The levels of ``ids``: one bytes object each."""
    out, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64)
        ranks = np.cumsum(ones) - ones
        out.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[more] >> np.uint32(8)
    return out


class Frame:
    """A frame in ``data`` at ``at``; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, levels, docs, self.n_ids = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.has_id = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.ends = np.frombuffer(data, "<u8", docs, at + 9 * docs)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(data, "<u8", -(-n // RANK_BITS), at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 8 * len(ranks)
        self.end = at

    def token(self, i: int) -> int:
        """The i-th id of the frame, by one step per chunk."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return out

    def ids(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= out << np.uint32(8)
            out = here
        return out


def frame(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    levels = pack_ids(ids)
    ends = np.cumsum([len(x) for _, x in docs]).astype("<u8")
    numbers = np.array([d or 0 for d, _ in docs], "<i8")
    flags = bytes(d is not None for d, _ in docs)
    return b"".join([HEAD.pack(MAGIC, len(levels), len(docs), len(ids)), numbers.tobytes(), flags, ends.tobytes(), *levels])


def frames(data: bytes) -> Iterator[Frame]:
    at, view = 0, memoryview(data)
    while at < len(view):
        f = Frame(view, at)
        yield f
        at = f.end + 1


def _frame_rows(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size = encoder(path).encode, [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                held.append((doc, ids))
                size += len(ids)
                if size >= FRAME_IDS:
                    yield pa.RecordBatch.from_pydict({"frame": [frame(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"frame": [frame(held)]})

    return rows


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of docs (doc_id, text) to ``folder``, ascending by doc_id over the files in order of their names."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # A doc_id that many rows have (or none) is dealt out by text, and equal rows by their place in the input.
    order = ["doc_id", F.xxhash64("text"), "place"]
    docs = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = docs.mapInArrow(_frame_rows(tokenizer, end_id), "frame binary")
    found.select(F.col("frame").cast("string").alias("value")).write.options(lineSep="\n", maxRecordsPerFile=FRAMES).text(folder)


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            before = 0
            for f in frames(data.as_buffer()):
                ids = f.ids().astype("<u4")
                ends = f.ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                doc = pa.array(f.doc_ids, mask=f.has_id == 0)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(crc)), doc, pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["path", "doc_id", "at", "n_tokens", "ids_crc32"])
                before += int(ends[-1])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    docs = written(files.mapInArrow(_document_rows, "path string, doc_id long, at long, n_tokens long, ids_crc32 long"), "documents")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    base = docs.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    base = base.withColumns({"task": number(r"part-(\d+)-[^/]*$"), "file": number(r"-c(\d+)[^/]*$")})
    base = base.withColumn("run", F.floor(F.col("task") / RUN))
    runs = base.groupBy("run").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", earlier(Window.orderBy("run")).alias("before_run"))  # a row for RUN tasks
    base = base.withColumn("before", earlier(Window.partitionBy("run").orderBy("task", "file"))).join(runs, "run")
    base = base.select("path", (F.col("before") + F.col("before_run")).alias("before"))
    return docs.join(base, "path").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary())
    return read_tokens(spark, folder)
