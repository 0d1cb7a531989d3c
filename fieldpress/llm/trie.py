"""A prefix tree of ordered token lists, walked for many queries at once.

Lists hold tokens in one global order (rarest first). Sorted, lists with a common beginning are neighbours, so a node
is a range of lists and a run of tokens that they share; long runs are cut at doubling depths. A step takes all
(query, node) pairs of a level one level down: the overlap found so far is carried along and shared by all lists
below a node, and a pair is left as soon as the overlap, together with what can still come on either side, falls short
of the least that any list below needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of the tables that a walk holds at a time.
CELLS = 1 << 22


def needed(nx, ny, num: int, den: int):
    """The least overlap of sets of sizes nx and ny whose Jaccard similarity is num / den or more."""
    return -(-num * (nx + ny) // (num + den))


class Trie:
    """``lists``: sorted arrays of tokens; ``n``: sizes of the whole sets; ``rest``: tokens of each set after its list that others may share."""

    def __init__(self, lists: list[np.ndarray], n: np.ndarray, rest: np.ndarray):
        self.tokens, local = np.unique(np.concatenate(lists), return_inverse=True)
        sizes = np.array([len(x) for x in lists], np.int64)
        ends = np.cumsum(sizes)
        seqs = [local[e - k : e].astype(">u4") for e, k in zip(ends, sizes)]
        self.order = np.array(sorted(range(len(lists)), key=lambda i: seqs[i].tobytes()), np.int64)
        self.size, self.n, self.rest = sizes[self.order], n[self.order], rest[self.order]
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.flat = np.concatenate([seqs[i] for i in self.order]).astype(np.int64)
        self._grow()

    def _common(self) -> list[int]:
        out = [0]
        for i in range(1, len(self.size)):
            k = min(self.size[i - 1], self.size[i])
            a, b = self.begin[i - 1], self.begin[i]
            differ = np.flatnonzero(self.flat[a : a + k] != self.flat[b : b + k])
            out.append(int(differ[0]) if len(differ) else int(k))
        return out

    def _grow(self) -> None:
        common, size = np.array(self._common()), self.size
        m = len(size)
        low, high, start, stop = [0], [m], [0], [0]  # node 0 is the root: no tokens
        child, last, owner, at = [], [], np.zeros(m, np.int64), 0
        while at < len(low):
            a, hi, d = low[at], high[at], stop[at]
            child.append(len(low))
            while a < hi and size[a] == d:  # lists that end here come first
                owner[a] = at
                a += 1
            cuts = [a, *(a + 1 + np.flatnonzero(common[a + 1 : hi] <= d)).tolist(), hi] if a < hi else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                to = int(common[a + 1 : b].min()) if b - a > 1 else int(size[a])
                low.append(a)
                high.append(b)
                start.append(d)
                stop.append(min(to, max(2 * d, d + 8)))
            last.append(len(low))
            at += 1
        self.low, self.high, self.start, self.stop, self.child, self.last = (np.array(x, np.int64) for x in (low, high, start, stop, child, last))
        whole = self.size + self.rest
        self.least = np.array([self.n[a:b].min() for a, b in zip(low, high)], np.int64)
        self.room = np.array([whole[a:b].max() for a, b in zip(low, high)], np.int64) - self.stop
        self.leaf = np.argsort(owner, kind="stable")
        ends = owner[self.leaf]
        self.first_leaf, self.end_leaf = np.searchsorted(ends, np.arange(len(low))), np.searchsorted(ends, np.arange(len(low)), side="right")

    def walk(self, queries: np.ndarray, num: int, den: int, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, list, most they can share) of pairs that may reach the similarity; queries and lists are places in ``order``.

        ``first``: only pairs whose first common token is this one.
        """
        at = int(np.searchsorted(self.tokens, first)) if first is not None else 0
        width = len(self.tokens)
        step = max(1, CELLS // max(width, len(self.flat)))
        for i in range(0, len(queries), step):
            yield from self._walk(queries[i : i + step], num, den, at, first is not None)

    def _walk(self, some, num, den, at, once):
        width = len(self.tokens)
        has = np.zeros((len(some), width), bool)
        for k, x in enumerate(some):
            has[k, self.flat[self.begin[x] : self.begin[x + 1]]] = True
        passed = np.cumsum(has, axis=1, dtype=np.int32)  # tokens of the query's list up to each token
        whole = self.size[some] + self.rest[some]
        nx = self.n[some]
        end = np.array([self.flat[self.begin[x + 1] - 1] if self.size[x] else -1 for x in some], np.int64)
        q, zero = np.arange(len(some)), np.zeros(len(some), np.int64)
        node, over, past = zero, zero, zero  # past: tokens after the query's list, which it may have or not
        while len(q):
            k = self.last[node] - self.child[node]
            q, over, past, first_child, to = np.repeat(q, k), np.repeat(over, k), np.repeat(past, k), np.repeat(self.child[node], k), np.cumsum(k)
            node = first_child + np.arange(len(q)) - np.repeat(to - k, k)
            if not len(q):
                break
            run = self.stop[node] - self.start[node]
            ends = np.cumsum(run)
            flat = np.repeat(self.begin[self.low[node]] + self.start[node], run) + np.arange(ends[-1]) - np.repeat(ends - run, run)
            token = self.flat[flat]
            of = np.repeat(q, run)
            hit = has[of, token]
            over = over + np.add.reduceat(hit, ends - run, dtype=np.int64)
            past = past + np.add.reduceat(token > end[of], ends - run, dtype=np.int64)
            final = token[ends - 1]
            most = over + np.minimum(whole[q] - passed[q, final], self.room[node] + past)
            fits = most >= needed(nx[q], self.least[node], num, den)
            if once:  # a pair with an earlier common token is another group's
                fits &= ~np.logical_or.reduceat(hit & (token < at), ends - run) & ((final < at) | (over > 0))
            q, node, over, past, final = q[fits], node[fits], over[fits], past[fits], final[fits]
            k = self.end_leaf[node] - self.first_leaf[node]
            if k.any():
                x, y = np.repeat(q, k), self.leaf[np.repeat(self.first_leaf[node], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                left = np.repeat(whole[q] - passed[q, final], k)
                can = np.repeat(over, k) + np.minimum(left, self.rest[y] + np.repeat(past, k))
                a, b = nx[x], self.n[y]
                good = (can >= needed(a, b, num, den)) & (num * np.maximum(a, b) <= den * np.minimum(a, b)) & (some[x] != y)
                if good.any():
                    yield some[x[good]], y[good], can[good]
