"""Operator 4: best-fit packing of documents by the linear grouping scheme (Fernandez de la Vega and Lueker, 1981).

Sequences depend on the pieces' lengths alone, and of those there are at most ``size``. So the driver plans with
counts per length, whatever the number of documents, and pieces get their places by their rank in their length:

1. large lengths (over size / 4) are put into ``GROUPS`` groups of equal cardinality and rounded up to the largest of each;
2. the few rounded sizes give a cutting-stock problem, whose linear program is optimised by column generation
   (configurations come from a knapsack); whole numbers of each configuration are used;
3. actual lengths take the place of the rounded ones, which leaves gaps;
4. what is left over and the small lengths go, longest first, into the smallest gap that holds them.

The plan's table has a row for each run of equal sequences and slot, bounded by the number of lengths.

Defined cases: null or empty texts are one end id; rows without a doc_id or with one that others have are packed
like all others; an empty table gives no rows; no columns but doc_id and text are looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, vocabulary

#: Groups of large lengths, the unit to which the largest of a group is rounded up, and the share of a sequence over which a length is large.
GROUPS, UNIT, LARGE = 16, 8, 4


# ---------------------------------------------------------------- the plan
def _configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations) and their amounts: the optimum of the cutting-stock linear program."""
    g = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(40 * g):
        price = np.linalg.solve(columns.T, np.ones(g))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            for i, s in enumerate(sizes):
                if s <= c and best[c - s] + price[i] > best[c] + 1e-12:
                    best[c], take[c] = best[c - s] + price[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(g), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                new[take[c]] += 1
                c -= sizes[take[c]]
        amount, step = np.linalg.solve(columns, demand), np.linalg.solve(columns, new)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    return columns, np.linalg.solve(columns, demand)


class Plan:
    """Sequences for ``counts`` (length -> number of pieces): runs of [number of sequences, lengths in order]."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.gaps, self.by_gap = size, [], {}
        left = dict(counts)
        large = sorted((n for n in left if size // LARGE < n < size), reverse=True)
        if len(large) > 1:
            self._group(left, large)
        for n in sorted(left, reverse=True):
            self._best_fit(n, left[n])
        self.runs = [(m, slots) for gap in self.by_gap for m, slots in self.by_gap[gap]]

    def _group(self, left: dict[int, int], large: list[int]) -> None:
        total = sum(left[n] for n in large)
        groups, members, room = [], [], 0
        for n in large:  # consecutive lengths, split where a group is full
            have = left[n]
            while have:
                if not room:
                    room = -(-total // GROUPS)
                    members.append([])
                    groups.append(n)
                m = min(have, room)
                members[-1].append([n, m])
                have, room = have - m, room - m
        # Rounded up to units besides, which only makes the knapsack smaller: the gaps are filled in the end.
        sizes = [-(-n // UNIT) for n in groups]
        merged: dict[int, list] = {}
        for s, rows in zip(sizes, members):
            merged.setdefault(s, []).extend(rows)
        sizes = list(merged)
        members = [merged[s] for s in sizes]
        demand = np.array([sum(m for _, m in rows) for rows in members], float)
        columns, amounts = _configurations(sizes, demand, self.size // UNIT)
        for j in np.argsort(-columns.sum(axis=0)):
            need = {i: round(columns[i, j]) for i in range(len(sizes)) if columns[i, j] > 0.5}
            n = min([int(amounts[j] + 1e-7), *(sum(m for _, m in members[i]) // k for i, k in need.items())])
            while n > 0:  # runs of sequences in which every slot has one length
                m, taken = n, []
                for i, k in need.items():
                    rows = members[i]
                    if rows[0][1] >= k:
                        taken += [rows[0]] * k
                        m = min(m, rows[0][1] // k)
                    else:
                        taken += [r for r in rows[:k] for _ in range(r[1])][:k]
                        m = 1
                for row in taken:
                    row[1] -= m
                    left[row[0]] -= m
                for i in need:
                    members[i] = [r for r in members[i] if r[1]]
                self._add(m, tuple(r[0] for r in taken))
                n -= m

    def _add(self, m: int, slots: tuple[int, ...]) -> None:
        gap = self.size - sum(slots)
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((m, slots))

    def _best_fit(self, n: int, count: int) -> None:
        while count > 0:
            at = bisect_left(self.gaps, n)
            if at == len(self.gaps):
                each = self.size // n
                if count >= each:
                    self._add(count // each, (n,) * each)
                    count %= each
                else:
                    self._add(1, (n,) * count)
                    count = 0
                continue
            gap = self.gaps[at]
            m, slots = self.by_gap[gap].pop()
            if not self.by_gap[gap]:
                del self.by_gap[gap], self.gaps[at]
            take = min(m, count)
            if take < m:
                self._add(m - take, slots)
            self._add(take, (*slots, n))
            count -= take

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key (length << 40 | first rank), first sequence, offset; sorted by key."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for m, slots in self.runs:
            offset = 0
            for n in slots:
                rank = used.get(n, 0)
                rows.append((n << 40 | rank, sequence, offset))
                used[n] = rank + m
                offset += n
            sequence += m
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        return cols[0], cols[1], cols[2]


# ---------------------------------------------------------------- documents
def _pieces(path: str, end_id: int, size: int):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    some = ids[at : at + 4 * size]
                    n = len(some) // 4
                    local = seen.get(n, 0)
                    seen[n] = local + 1
                    out.append((doc, piece, at // 4, n, zlib.crc32(some), part, local))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows


def _placed(table: tuple[np.ndarray, np.ndarray, np.ndarray]):
    keys, sequences, offsets = table

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            n = batch["length"].to_numpy()
            at = np.searchsorted(keys, (n << 40) | rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << 40) - 1))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    pieces = written(docs.mapInArrow(_pieces(tokenizer, end_id, size), schema), "pieces")
    # A piece's rank in its length: its rank in its task, after those of the tasks before. At most ``size`` rows a task.
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Counts grow with the number of tasks, so they aren't broadcast.
    ranked = pieces.join(counts.select("length", "part", before.alias("before")).hint("merge"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    plan = Plan(lengths, size)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan.table()), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
