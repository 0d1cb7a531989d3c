"""Operator 9: all links between documents whose n-gram sets have a Jaccard similarity of at least num/den, as classes.

1. Documents with equal sets are one: a set goes by a hash of its n-grams.
2. First filter: sets that link share, in the order of hashes, at least e + 1 of the first n - ceil(n * num / den) + 1 + e
   n-grams of each, for any e. Those n-grams alone are counted; a set in which too few stand twice has no partner. The others
   are marked in a bit table of fixed size (``BITS``), which lets some more through where there are many.
3. The global order: every (n-gram, set) that is left goes to a bucket of n-grams, where sets are counted. N-grams of one set
   alone end there; the others go back to their set with their count. A set's list is ordered rarest first.
4. Prefix filter: sets that link share an n-gram among the first n - ceil(n * num / den) + 1 of each, those that one set
   alone has included. So a set with that many n-grams of its own has no partner, and of the others only the
   n-grams left in that prefix, its *head*, make groups. Groups with the same members are one.
5. Stars: a set is compared exactly with central members of its groups. Links make provisional classes, so that large
   groups of copies are connected by as many comparisons as they have members.
6. Prefix tree (``trie``): in groups that still hold several classes, heads in the global order make a tree, and members
   outside the group's largest class walk it: partial overlaps are shared below a node, subtrees whose remaining lengths
   can't reach the overlap needed are pruned, and a pair is met only in the group of its first common n-gram. Large groups
   are cut into blocks of members and blocks of those that walk, and each pair of blocks is a task's.
7. What the tree leaves is verified on whole lists; links make classes of sets by ``connected_components``, and documents
   have the class of their set.

N-grams that a large share of all sets has would crowd a bucket: those that stand out in a task's part are counted apart,
the most frequent of them (at most ``1 / HOT_SHARE``) are known to all tasks and don't go through buckets.

Defined cases: without words or text a set is empty and linked with nothing; with fewer words than n the whole
sequence is one shingle; a row without doc_id gets a null component and links nothing; rows that share a doc_id
are one document; equal rows each give a row; other columns of the input are not looked at. Sets are named by 64 bits
of hash, n-grams by 48 and their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix, prefix, release, shingle_hashes, signed, span_hash, word_hashes, written
from .components import connected_components
from .trie import Trie, needed

#: N-grams that a task holds before it sends them, and that a bucket has on average.
CHUNK, BUCKET = 1 << 20, 1 << 19
#: Sets that a task remembers, so as not to send copies again.
SEEN = 100_000
#: An n-gram that this share of all n-grams in sets is, and so many sets have, doesn't go through its bucket.
HOT_SHARE, HOT_SETS = 1 / (1 << 20), 1 << 16
#: Bits of the table of sets that the first filter leaves.
BITS = 1 << 26
#: Members of a block of a group: a task has one block of members and one of those that walk.
BLOCK = 256
_LOW = np.uint64((1 << 44) - 1)
_MOST = (1 << 19) - 1


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams (A-Z lower-cased)."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower()), n))


def set_hash(s: np.ndarray) -> int:
    return int(signed(mix(span_hash(prefix(s), np.array([0]), np.array([len(s)])) + np.uint64(len(s))))[0]) if len(s) else 0


def trie_join(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """All pairs (i, j), i < j, of sets of similarity >= num / den, by one prefix tree on the driver."""
    some = [i for i, s in enumerate(sets) if len(s)]
    if len(some) < 2:
        return []
    grams, place, count = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, count))] = np.arange(len(grams))
    sizes = np.array([len(sets[i]) for i in some])
    tree = Trie([np.sort(x) for x in np.split(rank[place], np.cumsum(sizes)[:-1])], sizes, np.zeros_like(sizes))
    found = [(some[x], some[y]) for a, b, _ in tree.walk(np.arange(len(some)), num, den) for x, y in zip(tree.order[a].tolist(), tree.order[b].tolist())]
    return sorted((i, j) for i, j in found if i < j)


# ---------------------------------------------------------------- sets and the global order
SETS = "doc_id long, n_shingles long, a long, gram long, sets long"


def _sets(n: int):
    """A row for each document, and rows (gram, sets) of n-grams that stand out among the sets of this task."""
    names = ["doc_id", "n_shingles", "a", "gram", "sets"]
    least = max(2, int(2 * CHUNK * HOT_SHARE * 4))

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, count = np.unique(np.concatenate(held), return_counts=True)
        grams, count = grams[count >= least], count[count >= least]
        no = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays([no, no, no, pa.array(signed(grams)), pa.array(count.astype(np.int64))], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = []
            for doc, x in zip(batch["doc_id"].to_pylist(), batch["text"]):
                s = shingles(x.as_py(), n)
                found.append((len(s), set_hash(s)))
                if doc is not None and len(s):
                    held.append(s)
                    size += len(s)
                if size > 2 * CHUNK:
                    yield often(held)
                    held, size = [], 0
            cols = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))]
            no = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols, no, no], names=names)
        if held:
            yield often(held)
        del held
        release()

    return rows


def _slices(values: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted values, by their upper bits."""
    of = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
        yield int(of[i]), slice(i, j)


# The first filter ------------------------------------------------------------
def _prefix(n: int, num: int, den: int) -> tuple[int, int]:
    """(n-grams that are looked at, how many of them a partner has at least) of a set of n."""
    first = lambda k: k - -(-num * k // den) + 1
    spare = lambda k: min(first(k) // 2, k - first(k))
    return first(n) + spare(n), spare(-(-num * n // den)) + 1  # a partner may be smaller


def _cut(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number."""
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _uncut(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


_TAG = np.uint64((1 << 40) - 1)
COUNTED = "bucket int, grams binary, tags binary, needs binary"


def _distinct(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(hash, n-grams) of the sets of a task, in portions; a set that it has given isn't given again."""
    seen: set[int] = set()
    held, size = [], 0
    for batch in batches:
        for doc, x in zip(batch["doc_id"].to_pylist(), batch["text"]):
            s = shingles(x.as_py(), n)
            if doc is None or not len(s) or (a := set_hash(s)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(a)
            held.append((a, s))
            size += len(s)
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out) if out else [()] * len(names))], names=names)


def _first_grams(n: int, num: int, den: int, buckets: int):
    """COUNTED: n-grams of each set's beginning, and in a bucket behind the others how many of them must stand twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _distinct(batches, n):
            size = [_prefix(len(s), num, den) for _, s in held]
            tags = np.array([a for a, _ in held], np.int64).view(np.uint64) & _TAG
            grams, tag = mix(np.concatenate([s[:k] for (_, s), (k, _) in zip(held, size)])), np.repeat(tags, [k for k, _ in size])
            order = np.argsort(grams)
            grams, tag = grams[order], tag[order]
            out = [(bucket, _cut(grams[some], 5), _cut(tag[some], 5), b"") for bucket, some in _slices(grams, buckets)]
            out.append((buckets + int(tags[0] % np.uint64(buckets)), b"", _cut(tags, 5), np.array([k for _, k in size], "<i4").tobytes()))
            yield _rows(out, ["bucket", "grams", "tags", "needs"])
        release()

    return rows


TWICE = "part int, tags binary, counts binary, needs binary"


def _twice(buckets: int):
    """TWICE: how many n-grams of a bucket each set has that another one has too."""

    def sent(held: list[tuple[np.ndarray, np.ndarray]], needs: bool) -> pa.RecordBatch:
        tag, count = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(tag, kind="stable")
        tag, count, out = tag[order], count[order], []
        for part, some in _slices(tag << np.uint64(24), buckets):
            numbers = count[some].astype("<i4").tobytes()
            out.append((part, _cut(tag[some], 5), b"" if needs else numbers, numbers if needs else b""))
        return _rows(out, ["part", "tags", "counts", "needs"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, needs, m = [], [], 0
        for some in _grouped(batches):
            tag = _uncut(b"".join(r[2] for r in some), 5)
            if some[0][0] >= buckets:
                needs.append((tag, np.frombuffer(b"".join(r[3] for r in some), "<i4")))
            else:
                gram = _uncut(b"".join(r[1] for r in some), 5)
                order = np.lexsort((tag, gram))
                gram, tag = gram[order], tag[order]
                new = np.r_[True, (gram[1:] != gram[:-1]) | (tag[1:] != tag[:-1])]
                gram, tag = gram[new], tag[new]
                same = gram[1:] == gram[:-1]
                tags, count = np.unique(tag[np.r_[False, same] | np.r_[same, False]], return_counts=True)
                held.append((tags, count))
            m += len(tag)
            if m > 2 * CHUNK:
                for x, last in ((held, False), (needs, True)):
                    if x:
                        yield sent(x, last)
                held, needs, m = [], [], 0
        for x, last in ((held, False), (needs, True)):
            if x:
                yield sent(x, last)
        del held, needs
        release()

    return rows


def _places(tags: np.ndarray) -> np.ndarray:
    """Two bits of the table for each tag."""
    return np.concatenate([mix(tags), mix(tags ^ np.uint64(0xA5A5A5A5A5A5A5A5))]) % np.uint64(BITS)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bit) of the sets of which enough n-grams stand twice."""
    for some in _grouped(batches):
        counted = [r for r in some if r[2]]
        needed_ = [r for r in some if r[3]]
        if not counted or not needed_:
            continue
        tags, of = np.unique(_uncut(b"".join(r[1] for r in counted), 5), return_inverse=True)
        count = np.bincount(of, weights=np.frombuffer(b"".join(r[2] for r in counted), "<i4"))
        tag, need = _uncut(b"".join(r[1] for r in needed_), 5), np.frombuffer(b"".join(r[3] for r in needed_), "<i4")
        at = np.searchsorted(tags, tag).clip(max=len(tags) - 1)
        good = (tags[at] == tag) & (count[at] >= need)
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(_places(np.unique(tag[good])).astype(np.int64))], names=["bit"])


def first_filter(docs: DataFrame, total: int, n: int, num: int, den: int) -> np.ndarray:
    """The bit table of the sets that may have a partner; ``BITS`` bits at any input."""
    buckets = max(64, -(-total * 3 * (den - num) // (2 * den * BUCKET)))
    counted = docs.mapInArrow(_first_grams(n, num, den, buckets), COUNTED)
    twice = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_twice(buckets), TWICE)
    bits = twice.repartition("part").sortWithinPartitions("part").mapInArrow(_left, "bit long")
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most BITS / 64 rows
        out[batch["word"].to_numpy()] = batch["bits"].to_numpy()
    return out.view(np.uint64)


def _marked(table: np.ndarray, tags: np.ndarray) -> np.ndarray:
    at = _places(tags)
    on = (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return on[: len(tags)] & on[len(tags) :]


# The global order ------------------------------------------------------------
ENTRIES = "bucket int, grams binary, sets binary, sizes binary"


def _entries(n: int, buckets: int, hot: np.ndarray, table):
    """ENTRIES: for each bucket n-grams, and of which set each is. Behind the buckets go n-grams of ``hot``, and the sizes of sets."""
    names = ["bucket", "grams", "sets", "sizes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _distinct(batches, n):
            tags = np.array([a for a, _ in held], np.int64).view(np.uint64) & _TAG
            held = [x for x, on in zip(held, _marked(table.value, tags)) if on]
            if not held:
                continue
            a, sizes = np.array([k for k, _ in held], np.int64), np.array([len(s) for _, s in held], np.int64)
            grams, of, out = np.concatenate([s for _, s in held]), np.repeat(a, sizes), []
            behind = buckets + int(a[0] % buckets)
            if len(hot):
                apart = np.isin(grams, hot)
                if apart.any():
                    out.append((behind, _cut(grams[apart], 6), of[apart].tobytes(), b""))
                grams, of = grams[~apart], of[~apart]
            order = np.argsort(grams)
            grams, of = grams[order], of[order]
            out += [(bucket, _cut(grams[some], 6), of[some].tobytes(), b"") for bucket, some in _slices(grams, buckets)]
            out.append((behind, b"", a.tobytes(), sizes.astype("<i4").tobytes()))
            yield _rows(out, names)
        release()

    return rows


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that share their first column, from batches sorted by it."""
    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and r[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


SHARED = "part int, sets binary, counts binary, grams binary, dfs binary, sizes binary"


def _shared(buckets: int, hot: np.ndarray, hot_sets: np.ndarray):
    """SHARED: n-grams that several sets have, with the number of sets, dealt out by set; and sets with their sizes."""
    names = ["part", "sets", "counts", "grams", "dfs", "sizes"]
    # Those that go by themselves are known by their lower 48 bits.
    by = np.argsort(hot & np.uint64((1 << 48) - 1), kind="stable")
    short, rank = (hot & np.uint64((1 << 48) - 1))[by], np.argsort(np.argsort(hot_sets, kind="stable"))[by]

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, gram, df = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(a, kind="stable")
        a, gram, df, out = a[order], gram[order], df[order], []
        for part, some in _slices(a, buckets):
            at = np.flatnonzero(np.r_[True, a[some][1:] != a[some][:-1]])
            count = np.diff(np.r_[at, some.stop - some.start]).astype("<i4")
            out.append((part, a[some][at].tobytes(), count.tobytes(), gram[some].tobytes(), df[some].tobytes(), b""))
        return _rows(out, names)

    def sizes(a: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(a, kind="stable")
        a, size = a[order], size[order]
        return _rows([(part, a[some].tobytes(), b"", b"", b"", size[some].tobytes()) for part, some in _slices(a, buckets)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, m = [], 0
        for some in _grouped(batches):
            known = [r for r in some if r[3]]
            if known:
                yield sizes(np.frombuffer(b"".join(r[2] for r in known), np.uint64), np.frombuffer(b"".join(r[3] for r in known), "<i4"))
            some = [r for r in some if r[1]]
            if not some:
                continue
            gram, a = _uncut(b"".join(r[1] for r in some), 6), np.frombuffer(b"".join(r[2] for r in some), np.uint64)
            if some[0][0] < buckets:
                gram |= np.uint64(some[0][0] & 0xFFFF) << np.uint64(48)
                order = np.lexsort((a, gram))
                gram, a = gram[order], a[order]
                new = np.r_[True, (gram[1:] != gram[:-1]) | (a[1:] != a[:-1])]  # a set that several tasks have sent counts once
                gram, a = gram[new], a[new]
                first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                count = np.diff(np.r_[first, len(gram)])
                df = np.repeat(count, count).astype("<i4")
                gram, a, df = gram[df > 1], a[df > 1], df[df > 1]
            else:
                df = np.full(len(gram), _MOST, "<i4") - (len(hot) - 1 - rank[np.searchsorted(short, gram)]).clip(max=_MOST // 2).astype("<i4")
            if len(gram):
                held.append((a, gram, df))
                m += len(gram)
            if m > CHUNK:
                yield sent(held)
                held, m = [], 0
        if held:
            yield sent(held)
        del held
        release()

    return rows


LISTS = "a long, n int, shared int, score int, grams binary, head binary"


def _lists(num: int, den: int):
    """LISTS: a row for each set that may have a partner: its shared n-grams in the global order, and the keys of its head."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _grouped(batches):
            known, some = [r for r in some if r[5]], [r for r in some if r[2]]
            if not some:
                continue
            whole, first = np.unique(np.frombuffer(b"".join(r[1] for r in known), np.uint64), return_index=True)
            size = np.frombuffer(b"".join(r[5] for r in known), "<i4")[first]
            a = np.repeat(np.frombuffer(b"".join(r[1] for r in some), np.uint64), np.frombuffer(b"".join(r[2] for r in some), "<i4"))
            gram, df = np.frombuffer(b"".join(r[3] for r in some), np.uint64), np.frombuffer(b"".join(r[4] for r in some), "<i4")
            key = np.minimum(df, _MOST).astype(np.uint64) << np.uint64(44) | gram & _LOW
            order = np.lexsort((gram, key, a))
            a, gram, key = a[order], gram[order], key[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (gram[1:] != gram[:-1])]
            a, gram, key = a[new], gram[new], key[new]
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            shared, n = np.diff(np.r_[at, len(a)]), size[np.searchsorted(whole, a[at])].astype(np.int64)
            head = n - -(-num * n // den) + 1 - (n - shared)
            keep = np.flatnonzero(head > 0)
            if len(keep):
                end = at + shared
                cols = [signed(a[at[keep]]), n[keep].astype(np.int32), shared[keep].astype(np.int32), ((n - shared) * 1000 // n)[keep].astype(np.int32)]
                lists = [[x[at[i] : e[i]].tobytes() for i in keep] for x, e in ((gram, end), (key, np.minimum(at + head, end)))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.array(x, pa.binary()) for x in lists)], names=["a", "n", "shared", "score", "grams", "head"])
        release()

    return rows


# ---------------------------------------------------------------- groups, stars and trees
def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.unique(np.frombuffer(x.as_buffer(), np.int64)) for x in batch["head"]]
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch["a"].take(pa.array(of)), batch["score"].take(pa.array(of))], names=["token", "a", "score"])


def _verified(num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, one = [], None, np.empty(0, np.uint64)
            for x, gx, gy, nx, ny in zip(batch["x"].to_pylist(), batch["gx"], batch["gy"], batch["nx"].to_pylist(), batch["ny"].to_pylist()):
                if x != last:
                    last, one = x, np.frombuffer(gx.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, np.frombuffer(gy.as_buffer(), np.uint64), assume_unique=True))
                good.append(both >= needed(nx, ny, num, den))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    return rows


def _links(pairs: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (x, y) whose whole lists overlap enough."""
    sides = [lists.select(F.col("a").alias(s), F.col("n").alias(f"n{s}"), F.col("shared").alias(f"s{s}"), F.col("grams").alias(f"g{s}")) for s in "xy"]
    long, short = F.greatest("nx", "ny"), F.least("nx", "ny")
    both = pairs.join(sides[0], "x").join(sides[1], "y").filter(num * long.cast("long") <= den * short.cast("long"))
    both = both.filter((num + den) * F.least("sx", "sy").cast("long") >= num * (long + short).cast("long"))
    return both.select("x", "y", "nx", "ny", "gx", "gy").mapInArrow(_verified(num, den), "x long, y long")


def _walks(num: int, den: int):
    """From members sorted by (token, block, part): pairs of different classes that may link."""
    names = ["token", "block", "part", "a", "label", "outside", "own", "n", "shared", "head"]

    def pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        token = rows[0][0]
        a, label, outside, own, n, shared = (np.array(c) for c in list(zip(*rows))[3:9])
        heads = [np.sort(np.frombuffer(r[9], np.int64)) for r in rows]
        tree = Trie(heads, n.astype(np.int64), shared - np.array([len(h) for h in heads]))
        a, label, outside, own = a[tree.order], label[tree.order], outside[tree.order], own[tree.order]
        out = []
        for x, y, _ in tree.walk(np.flatnonzero(~own), num, den, token):
            good = own[y] & (label[x] != label[y]) & (~outside[y] | (a[x] < a[y]))  # of two that walk one is enough
            out.append((a[x[good]], a[y[good]]))
        return tuple(np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*out) if out else ((), ())))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*(batch[c].to_pylist() for c in names)):
                if held and r[:3] != held[0][:3]:
                    out.append(pairs(held))
                    held = []
                held.append(r)
            if out:
                x, y = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
        if held:
            x, y = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
        del held
        release()

    return rows


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, block, part, a, label, outside, own): members of groups of several classes (own), and again those outside the largest class, which walk."""
    members = members.join(labels.select(F.col("node").alias("a"), "root"), "a", "left").select("token", "a", F.coalesce("root", "a").alias("label"))
    classes = members.groupBy("token", "label").agg(F.count("*").alias("k"))
    groups = classes.groupBy("token").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("classes"))
    blocks, parts = F.ceil(F.col("k") / BLOCK).cast("int"), F.ceil((F.col("k") - F.col("most")) / BLOCK).cast("int")
    groups = written(groups.filter("classes > 1").select("token", "major", blocks.alias("blocks"), parts.alias("parts")), "open")
    some = members.join(groups, "token").withColumn("outside", F.col("label") != F.col("major"))
    some = written(some.withColumns({"block": F.pmod(F.xxhash64("a"), "blocks").cast("int"), "part": F.pmod(F.xxhash64("a", F.lit(1)), "parts").cast("int")}), "grouped")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = some.withColumn("part", each("parts")).withColumn("own", F.lit(True))
    walk = some.filter("outside").withColumn("block", each("blocks")).withColumn("own", F.lit(False))
    return own.unionByName(walk).select("token", "block", "part", "a", "label", "outside", "own")


def set_links(docs: DataFrame, total: int, hot: list, n: int, num: int, den: int) -> DataFrame:
    """(x, y): links between sets (by their hashes) that connect all sets that similarity connects. ``total``: n-grams in all sets; ``hot``: (gram, sets)."""
    buckets = max(64, -(-total // BUCKET))
    often = sorted((int(g) & 0xFFFFFFFFFFFFFFFF, int(k)) for g, k in hot)
    grams, counts = np.array([g for g, _ in often], np.uint64), np.array([k for _, k in often], np.int64)
    table = docs.sparkSession.sparkContext.broadcast(first_filter(docs, total, n, num, den))  # BITS bits
    entries = docs.mapInArrow(_entries(n, buckets, grams, table), ENTRIES)
    shared = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(buckets, grams, counts), SHARED)
    lists = written(shared.repartition("part").sortWithinPartitions("part").mapInArrow(_lists(num, den), LISTS), "lists")
    heads = lists.select("a", "score", "head").mapInArrow(_heads, "token long, a long, score int")
    heads = written(heads, "heads")
    groups = heads.groupBy("token").agg(F.count("*").alias("k"), F.min(F.struct("score", "a")).alias("centre"), F.bit_xor(F.xxhash64("a")).alias("p"), F.bit_xor(F.xxhash64("a", F.lit(7))).alias("q"))
    groups = groups.filter("k > 1").groupBy("k", "p", "q").agg(F.min("token").alias("token"), F.min("centre").alias("centre"))
    groups = written(groups.select("token", "k", "centre"), "groups")
    members = written(heads.select("token", "a").join(groups, "token"), "members")
    discard(heads)
    rest = members.filter(F.col("a") != F.col("centre.a"))
    best = rest.groupBy("a").agg(F.min("centre").alias("one"), F.min_by("centre", "token").alias("two")).select("a", F.explode(F.array("one.a", "two.a")).alias("y"))
    stars = best.unionByName(rest.filter("k = 2").select("a", F.col("centre.a").alias("y"))).withColumnRenamed("a", "x").distinct()
    links = written(_links(written(stars, "stars"), lists, num, den), "links")
    up = links.groupBy("x").agg(F.min("y").alias("y"))  # provisional classes: two steps up the stars
    labels = up.join(up.toDF("y", "z"), "y", "left").select(F.col("x").alias("node"), F.coalesce("z", "y").alias("root"))
    walkers = _open(members.filter("k > 2"), labels)
    walkers = walkers.join(lists.select("a", "n", "shared", "head"), "a").select("token", "block", "part", "a", "label", "outside", "own", "n", "shared", "head")
    near = walkers.repartition("token", "block", "part").sortWithinPartitions("token", "block", "part").mapInArrow(_walks(num, den), "x long, y long")
    near = written(near, "near")
    return links.unionByName(_links(near, lists, num, den))


def ngram_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: classes of similarity >= num / den on n-word shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(docs.mapInArrow(_sets(n), SETS), "sets")
    facts = found.filter("gram IS NULL").select("doc_id", "n_shingles", "a")
    known = facts.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = written(known.groupBy("a").agg(F.min("doc_id").alias("one"), F.count("*").alias("k")), "distinct")
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    often = found.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("sets").alias("sets"))
    hot = often.filter(F.col("sets") >= max(HOT_SETS, total * HOT_SHARE)).collect()  # at most 1 / HOT_SHARE rows
    links = set_links(docs, total, hot, n, num, den)
    for end in ("x", "y"):  # each set goes by its smallest document
        links = links.join(sets.select(F.col("a").alias(end), F.col("one").alias(f"{end}_")), end)
    links = links.select(F.col("x_").alias("a"), F.col("y_").alias("b"))
    placed = facts.join(sets.select("a", "one"), "a", "left")  # null where a document has no class
    # Sets that share a doc_id are connected by it.
    shared = placed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("one").alias("a"), F.max("one").alias("b"), F.countDistinct("one").alias("k"))
    several = placed.join(shared.filter("k > 1").select("doc_id", F.col("a").alias("b")), "doc_id").select(F.col("one").alias("a"), "b")
    roots = connected_components(links.unionByName(several)).toDF("one", "root")
    # A row without words goes with the other rows of its doc_id.
    empty = placed.filter("n_shingles = 0").drop("one").join(shared.select("doc_id", F.col("a").alias("one")), "doc_id", "left")
    out = placed.filter("n_shingles > 0").unionByName(empty).join(roots, "one", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "one", "doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
