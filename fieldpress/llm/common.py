"""What several operators share: tables in the cluster's shared folder, word hashes, span hashes, minimisers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The separators between words: U+0020 and U+0009 to U+000D, which is also what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- tables
def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, the one place that driver and executors share.

    Only where that setting is absent and all runs in one process (tests) is a temporary folder set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldpress-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/fieldpress/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    return folder


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        remove_folder(spark, folder)
    except Exception:  # the session has ended: its own clean-up is all that is left
        pass


def remove_folder(spark: SparkSession, folder: str) -> None:
    if not folder:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table made by ``written`` that nothing reads any more."""
    remove_folder(df.sparkSession, df._folder)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns c0, c1 and so on: names of any kind then get through Python."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def release() -> None:
    """Gives freed memory back to the system: a worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- hashes
class Hashes(dict):
    """64-bit hashes of words, kept until there are ``limit`` of them."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = Hashes()


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial with coefficients ``x`` (modulo 2**64), one longer than ``x``."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _power(_BASE, len(x)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever a span stands."""
    return mix((p[end] - p[start]) * _power(_INVERSE, len(p))[start])


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the whole sequence is one run where there are fewer words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    at = np.arange(len(hashes) - n + 1)
    return span_hash(prefix(hashes), at, at + n)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours in ``h``, the place of the smallest (leftmost of equals).

    Compares the upper 32 bits; which place is taken depends on the run's content alone.
    """
    n = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


#: A random number for each byte value, and which bytes separate words.
BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order; no word is made an object."""
    if len(data) > _PIECE:  # cut at white space, so that memory doesn't grow with the text
        out, at = [], 0
        while at < len(data):
            end = at + _PIECE
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            out.append(_word_hashes(data[at:end]))
            at = end
        return np.concatenate(out)
    return _word_hashes(data)


def word_hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and how many each text has."""
    if sum(map(len, texts)) > _PIECE:
        found = [word_hashes(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint64), *found]), np.array([len(f) for f in found], np.int64)
    start, hashes = _words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def _word_hashes(data: bytes) -> np.ndarray:
    return _words(data)[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    space = _SPACE[x]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.r_[0, change]
    if not space[-1]:
        change = np.r_[change, len(x)]
    p = prefix(BYTES[x])
    start, end = change[::2], change[1::2]
    return start, mix((p[end] - p[start]) * _power(_INVERSE, len(p))[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
