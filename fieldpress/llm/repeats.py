"""Which windows of a fixed length stand more than once: shared by the two exact repeat removers.

A unit is a word or a byte. Every window of ``window`` units has one *anchor*: the run of ``anchor`` units
inside it with the smallest hash. Equal windows have equal anchors at the same place, so only windows around an anchor
that stands twice can repeat; the windows that have the same anchor in a row share one *context*, the span they
cover together. One row per context is shuffled (about 2 per ``window - anchor`` units), not one per window, and one with all
its places where it stands in a text again and again (a line that is repeated):

1. anchors that stand once are dropped (a sum per anchor hash, pre-aggregated before the shuffle);
2. of equal contexts one stands for all, with their number and their smallest and largest doc_id (pre-aggregated too);
3. the contexts of one anchor are brought together, and their windows compared (``Kind.classes``). The outcome is runs of
   windows of a context, which go back to all places where that context stands.

An anchor with more than ``HOT`` contexts isn't compared yet: its windows have at least half of their other units on one
side of it, and the anchor is made longer by those, which deals its contexts out anew; anchors that now stand once
are dropped, and contexts that are now equal are one. At the latest when anchors are as long as windows, each has
one context: no group is gathered that grows with the data, and no window is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, prefix, release, signed, span_hash, window_minima, written

#: Windows that are worked on at a time, so that memory doesn't grow with a document.
CHUNK = 1 << 19
#: Contexts of one anchor that are compared by one task at most.
HOT = 1024


@dataclass(frozen=True)
class Kind:
    """What is compared: ``units`` gives texts' units in a row, as 64-bit hashes, and how many each text has."""

    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    window: int
    anchor: int
    #: The units of a text from one place to another as they are sent, and as hashes again.
    cut: Callable[[bytes, np.ndarray, int, int], bytes]
    hashes: Callable[[bytes], np.ndarray]
    #: (sent units, starts, length) -> a number for each start, equal where the next ``length`` units are.
    classes: Callable[[bytes, np.ndarray, int], np.ndarray]
    #: A digest of sent units by which each place of a context is verified, if there is one.
    digest: Callable[[bytes], int] | None = None
    #: Bytes that a unit takes when it is sent.
    width: int = 1


def anchors(x: np.ndarray, counts: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts in a row (text, start of the first window in it, windows, place of the anchor from there, anchor hash, context hash), a row for each anchor."""
    windows = len(x) - kind.window + 1
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    for at in range(0, max(windows, 0), CHUNK):
        n = min(CHUNK, windows - at)
        part = x[at : at + n + kind.window - 1]
        inside = np.flatnonzero(text[at : at + n] == text[at + kind.window - 1 : at + n + kind.window - 1])
        if not len(inside):
            continue
        p = prefix(part)
        runs = np.arange(len(part) - kind.anchor + 1)
        h = span_hash(p, runs, runs + kind.anchor)
        place = window_minima(h, kind.window - kind.anchor + 1)[inside]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)])
        count = np.diff(np.r_[new, len(inside)])
        first = inside[new]
        context = span_hash(p, first, first + count + kind.window - 1)
        where = text[first + at]
        yield where, first + at - begin[where], count, place[new] - first, signed(h[place[new]]), signed(mix(context + count.astype(np.uint64)))


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text and a hash t of the text: together they name a row, also where doc_ids repeat. Columns ``carry`` go along in ``rest``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in carry)).alias("rest")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), *more)


def placed(where: np.ndarray, s: np.ndarray, n: np.ndarray, a: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple:
    """Of rows of ``anchors``, the first of each context of a text, and the other places of that context there as a list (null: none)."""
    key = mix(c.view(np.uint64) ^ mix(where.astype(np.uint64)))  # two keys that happen to be equal leave more rows, nothing else
    order = np.argsort(key, kind="stable")
    w_, h_, c_ = where[order], h[order], c[order]
    new = np.flatnonzero(np.r_[True, (w_[1:] != w_[:-1]) | (h_[1:] != h_[:-1]) | (c_[1:] != c_[:-1])])
    more = np.diff(np.r_[new, len(order)]) - 1
    by = np.argsort(order[new])  # as they stood
    new, more = new[by], more[by]
    first, end = order[new], np.cumsum(more)
    others = s[order[np.repeat(new + 1 - (end - more), more) + np.arange(more.sum())]]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(others, pa.int64()), mask=pa.array(more == 0))
    return where[first], s[first], lists, n[first], a[first], h[first], c[first]


ANCHORS = "doc_id long, t long, s long, more array<long>, n int, a int, h long, c long"


def _anchor_rows(kind: Kind):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("more", pa.list_(pa.int64())), ("n", pa.int32()), ("a", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in groups([(doc, t, encoded(x)) for doc, t, x in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), batch["text"]) if doc is not None]):
                doc, t = (np.array([r[i] for r in some], np.int64) for i in (0, 1))
                for found in anchors(*kind.units([r[2] for r in some]), kind):
                    where, s, more, *rest = placed(*found)
                    yield pa.RecordBatch.from_arrays([x if x is more else pa.array(x, f.type) for x, f in zip((doc[where], t[where], s, more, *rest), schema)], schema=schema)
        release()

    return rows


def encoded(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def groups(rows: list[tuple], most: int = 1 << 19) -> Iterator[list[tuple]]:
    """Rows, whose last field is bytes, in groups of about ``most`` bytes: small texts are worked on together."""
    some, size = [], 0
    for r in rows:
        if some and size + len(r[-1]) > most:
            yield some
            some, size = [], 0
        some.append(r)
        size += len(r[-1]) + 1
    if some:
        yield some


def repeated(docs: DataFrame, kind: Kind, others: bool) -> DataFrame:
    """(doc_id, t, spans): windows s to s + n - 1 of each span (s, n, digest) repeat in that row; a row for each context that has some, however often the row has it.

    ``others``: only if the window also starts in a document with a smaller doc_id; else if it starts
    anywhere else at all. Documents without a doc_id neither give nor take windows.
    """
    docs = docs.select("doc_id", "text", "t")
    all_ = written(docs.mapInArrow(_anchor_rows(kind), ANCHORS), "all")
    times = F.sum(F.coalesce(F.size("more"), F.lit(0)) + 1).alias("k")
    per = all_.groupBy("h").agg(*([F.min("doc_id").alias("low"), F.max("doc_id").alias("high")] if others else [times]))
    # Written and read again, a side of a join is shuffled for that join alone, and AQE can split a hot key.
    per = written(per.filter("low < high" if others else "k > 1").select("h"), "anchors")
    found = written(all_.join(per, "h"), "found")
    discard(all_)
    ends = [times, F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    contexts = found.groupBy("h", "c").agg(*ends, F.min("n").alias("n"), F.min("a").alias("a"), F.min(F.struct("doc_id", "t", "s")).alias("one"))
    contexts = written(contexts, "contexts")
    alone = None
    if kind.digest is None:  # contexts are equal if their hashes are: where an anchor has one alone there is nothing to compare
        several = written(contexts.groupBy("h").count().filter("count > 1").select("h"), "several")
        alone = contexts.join(several, "h", "left_anti").filter("low < high" if others else "k > 1")
        alone = alone.select("h", "c", F.lit(0).alias("j"), F.col("n").alias("m"), "low", F.lit(0).cast("long").alias("digest"))
        contexts = contexts.join(several, "h", "left_semi")
    wide = contexts.groupBy("one.doc_id", "one.t").agg(F.collect_list(F.struct("one.s", "n", "a", "h", "c", "k", "low", "high")).alias("spans"))
    listed = written(docs.join(wide, ["doc_id", "t"]).mapInArrow(_context_rows(kind), CONTEXTS), "windows")
    runs = _runs(listed, kind, others)
    runs = runs if alone is None else runs.unionByName(alone)
    # A row for each context, so that a text that has it meets one row, whatever the number of its places there and of its runs.
    runs = written(runs.groupBy("h", "c").agg(F.collect_list(F.struct("j", "m", "low", "digest")).alias("runs")), "runs")
    spans = found.join(runs, ["h", "c"])
    if others:
        spans = spans.withColumn("runs", F.filter("runs", lambda r: r["low"] < F.col("doc_id"))).filter(F.size("runs") > 0)
    places = F.concat(F.array("s"), F.coalesce("more", F.array().cast("array<long>")))
    there = F.transform(places, lambda s: F.transform("runs", lambda r: F.struct((s + r["j"]).alias("s"), r["m"].cast("long").alias("n"), r["digest"].alias("digest"))))
    return spans.select("doc_id", "t", F.flatten(there).alias("spans"))


#: A context: how often it stands, where its anchor begins and how long that is, its windows, and its units.
CONTEXTS = "h long, c long, k long, low long, high long, a int, size int, n int, units binary"
RUNS = "h long, c long, j int, m int, low long, digest long"


def _context_rows(kind: Kind):
    names = ["s", "n", "a", "h", "c", "k", "low", "high"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for doc, t, text, spans in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), batch["text"], batch["spans"].to_pylist()):
                if before == (doc, t):
                    continue  # an equal row: one of them stands for all
                before, raw = (doc, t), encoded(text)
                x = kind.units([raw])[0] if kind.width > 1 else None
                for i in range(0, len(spans), 4096):
                    s, n, a, h, c, k, low, high = ([r[name] for r in spans[i : i + 4096]] for name in names)
                    units = [kind.cut(raw, x, p, p + m + kind.window - 1) for p, m in zip(s, n)]
                    yield _contexts(h, c, k, low, high, a, [kind.anchor] * len(s), n, units)
        release()

    return rows


def _contexts(h, c, k, low, high, a, size, n, units, **more) -> pa.RecordBatch:
    cols = {"h": h, "c": c, "k": k, "low": low, "high": high, "a": a, "size": size, "n": n}
    small = ("a", "size", "n")
    arrays = [pa.array(v, pa.int32() if name in small else pa.int64()) for name, v in cols.items()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(units, pa.binary()), *more.values()], names=[*cols, "units", *more])


def _runs(listed: DataFrame, kind: Kind, others: bool) -> DataFrame:
    """RUNS: windows j to j + m - 1 of a context repeat, and ``low`` is the smallest doc_id that has them."""
    hot = written(listed.groupBy("h").count().filter(F.col("count") > HOT).select("h"), "hot")
    if hot.isEmpty():
        return listed.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_rows(kind, others), RUNS)
    cool = listed.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_rows(kind, others), RUNS)
    parts = listed.join(hot, "h", "left_semi").mapInArrow(_longer_anchors(kind), CONTEXTS + ", h_ long, c_ long, j_ int")
    parts = written(parts, "longer")
    alive = parts.groupBy("h").agg(F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
    alive = written(alive.filter("low < high" if others else "k > 1").select("h"), "anchors")
    parts = written(parts.join(alive, "h"), "longer")
    one = F.any_value(F.struct("a", "size", "n", "units")).alias("one")
    next_ = parts.groupBy("h", "c").agg(F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"), one)
    next_ = written(next_.select("h", "c", "k", "low", "high", "one.*"), "windows")
    back = parts.select("h", "c", "h_", "c_", "j_").join(_runs(next_, kind, others), ["h", "c"])
    return cool.unionByName(back.select(F.col("h_").alias("h"), F.col("c_").alias("c"), (F.col("j") + F.col("j_")).alias("j"), "m", "low", "digest"))


def _longer_anchors(kind: Kind):
    """Contexts cut in two: windows with the longer half of their other units after the anchor, and before it; the anchor takes up that half."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, c, k, low, high, a, size, n, units in zip(*(x.to_pylist() for x in batch.columns)):
                half = (kind.window - size + 1) // 2
                p = prefix(kind.hashes(units))
                turn = min(max(a + size + half - kind.window, 0), n)  # from here on windows have ``half`` units after the anchor
                for j, end, at in ((0, turn, a - half), (turn, n, a)):
                    if end > j:
                        last = end - 1 + kind.window
                        marks = span_hash(p, np.array([at, j]), np.array([at + size + half, last]))
                        own, context = mix(marks + np.array([h & 0xFFFFFFFFFFFFFFFF, end - j], np.uint64))
                        out.append((int(own.view(np.int64)), int(context.view(np.int64)), k, low, high, at - j, size + half, end - j, units[j * kind.width : last * kind.width], h, c, j))
            if out:
                cols = list(zip(*out))
                yield _contexts(*cols[:9], h_=pa.array(cols[9], pa.int64()), c_=pa.array(cols[10], pa.int64()), j_=pa.array(cols[11], pa.int32()))

    return rows


def _sorted_rows(kind: Kind, others: bool):
    """RUNS from contexts sorted by anchor."""

    def runs(held: list[tuple]) -> pa.RecordBatch:
        h, c, k, low, high, n, units = zip(*held)
        n = np.array(n, np.int64)
        begin = np.cumsum([0, *(len(u) // kind.width for u in units[:-1])])
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = kind.classes(b"".join(units), begin[row] + place, kind.window)
        if others:
            order = np.argsort(found, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(found[order]) != 0])
            least = np.minimum.reduceat(np.array(low, np.int64)[row][order], first)[found]
            hit = least < np.array(high, np.int64)[row]
        else:
            hit = np.bincount(found, weights=np.array(k, np.float64)[row])[found] > 1
            least = np.zeros(len(row), np.int64)
        i = np.flatnonzero(hit)
        new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (row[i[1:]] != row[i[:-1]]) | (least[i[1:]] != least[i[:-1]])]) if len(i) else i
        first, m = i[new], np.diff(np.r_[new, len(i)])
        of, j = row[first], place[first]
        digest = [0] * len(of)
        if kind.digest is not None:
            digest = [kind.digest(units[x][a * kind.width : (a + b + kind.window - 1) * kind.width]) for x, a, b in zip(of.tolist(), j.tolist(), m.tolist())]
        cols = [pa.array(np.array(h, np.int64)[of]), pa.array(np.array(c, np.int64)[of]), pa.array(j.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(least[first]), pa.array(digest, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["h", "c", "j", "m", "low", "digest"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch[x].to_pylist() for x in ("h", "c", "k", "low", "high", "n", "units"))):
                if r[0] != last and size > CHUNK // 2:  # a group of at most HOT contexts is never cut
                    yield runs(held)
                    held, size = [], 0
                held.append(r)
                size += r[5]
                last = r[0]
        if held:
            yield runs(held)
        del held
        release()

    return rows
