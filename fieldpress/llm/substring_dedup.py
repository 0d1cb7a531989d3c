"""Operator 2: exact substring removal by words, with windows found by level-wise doubling.

Level 1 looks at runs of half a window (25 of 50 words), at those only that every window must contain (its
smallest run; see ``repeats``). Runs that stand in one document alone are dropped; those repeated are extended
to the full length, first as whole contexts and then, where contexts differ, window by window. A window of
50 words is removed if it also starts in a document with a smaller doc_id, so each passage stays once.
``longest_repeats`` carries the doubling on (50, 100, 200, ... words), on the documents that have that many words,
until no candidates survive.

Defined cases: a null or empty text has no words; texts of under ``window`` words lose nothing; a row whose
doc_id is null neither gives nor takes windows; rows that share a doc_id are one document (they don't remove
each other's words); every input row gives one output row; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prefix, span_hash, split_words, word_hashes_of, written
from .repeats import Kind, keyed, repeated

_SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_units(raw: bytes, x: np.ndarray, start: int, end: int) -> bytes:
    return x[start:end].tobytes()


def _unit_hashes(sent: bytes) -> np.ndarray:
    return np.frombuffer(sent, np.uint64)


def _classes(sent: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    p = prefix(_unit_hashes(sent))
    return np.unique(span_hash(p, starts, starts + length), return_inverse=True)[1]


def word_kind(window: int) -> Kind:
    return Kind(word_hashes_of, window, max(1, -(-window // 2)), _cut_units, _unit_hashes, _classes, width=8)


def covered(n_units: int, spans: list[dict], window: int) -> np.ndarray:
    """Which units are covered by the windows that start at s .. s + n - 1 of each span."""
    edge = np.zeros(n_units + 1, np.int64)
    s, n = (np.array([r[c] for r in spans], np.int64) for c in ("s", "n"))
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def with_removals(docs: DataFrame, kind: Kind, others: bool, carry: list[str] | None = None) -> DataFrame:
    """doc_id, t, text (and rest) and the array ``spans`` of repeated windows (null where there are none)."""
    docs = keyed(docs, carry)
    # A set: equal rows find the same spans, and each of them gets every span once.
    spans = repeated(docs, kind, others).groupBy("doc_id", "t").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return docs.join(spans, ["doc_id", "t"], "left")


def longest_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, t, s, n, words): by length (``window``, twice that, and so on) the windows that also start in a document with a smaller doc_id.

    t is ``xxhash64`` of the text: with doc_id it names a row. Ends with the first length of which no window survives.
    """
    docs, out, words = keyed(docs), None, window
    while True:
        found = repeated(docs, word_kind(words), True).select("doc_id", "t", F.inline("spans"))
        found = written(found.select("doc_id", "t", "s", "n", F.lit(words).alias("words")).distinct(), "repeats")
        if found.isEmpty():
            return out if out is not None else found
        out = found if out is None else out.unionByName(found)
        words *= 2
        docs = docs.filter(F.size(F.split("text", r"[\x20\x09-\x0D]+")) >= words)


def _judged(window: int, texts: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * texts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words, kept, gone = split_words(text), text, 0
                n = len(words)
                if spans:
                    mask = covered(n, spans, window)
                    gone = int(mask.sum())
                    if texts:
                        kept = _cut(text.encode("utf-8", "surrogatepass"), mask).decode("utf-8", "surrogatepass")
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                out.append((doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()) + (kept,) * texts)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema]
            rest = ["rest"] if "rest" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in rest)], names=[*schema.names, *rest])

    return rows


def _cut(data: bytes, mask: np.ndarray) -> bytes:
    """The text without its masked words; what stands between kept words stays, once per cut."""
    out, end, cut = [], 0, False
    for found, gone in zip(_SPACED.finditer(data), mask.tolist()):
        if gone:
            cut = True
            continue
        if cut and not out:
            end = found.start()
        out.append(data[max(end, found.start() - 1) if cut else end : found.end()])
        end, cut = found.end(), False
    return b"".join(out) + (b"" if cut else data[end:])


def remove_repeats(docs: DataFrame, window: int = 50, texts: bool = True, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts`` also kept_text; columns ``carry`` of docs in the struct ``rest``."""
    found = with_removals(docs, word_kind(window), True, carry).drop("t")
    fields = [T.StructField(c, T.StringType() if "sha" in c or "text" in c else T.LongType()) for c in ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts]
    return found.mapInArrow(_judged(window, texts), T.StructType(fields + [found.schema[c] for c in ["rest"] * bool(carry)]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
