"""The causal scan as a wavefront.

A cell's prediction needs its left, top, top-left and top-right neighbours and the same cell one step earlier, all of which have a
smaller w = t + 2y + x. Cells of equal w don't need each other, so each w is one NumPy step: T + 2H + W
steps instead of T * H * W, with sums in the fixed order of a cell-by-cell walk, bit for bit.
"""

from __future__ import annotations

import numpy as np

#: Weights of left, top, top-left, top-right and earlier; the prediction where none is available.
WEIGHTS = (8.0, 2.0, 1.0, 1.0, 1.0)
COLD = 32.0
CLAMP = float(2**31 - 1)


class Fronts:
    """The cells that are there in order of w = t + 2y + x: ``order`` has their C-order numbers, ``places`` theirs in a grid padded by one cell on three sides (flat)."""

    def __init__(self, missing: np.ndarray):
        t, h, w = self.shape = missing.shape
        at = np.flatnonzero(~missing.ravel()).astype(np.int32 if missing.size < 1 << 31 else np.int64)
        rows = at // w
        x, days = at - rows * w, rows // h
        y = rows - days * h
        front = days + 2 * y + x
        # A radix sort where numbers are short.
        self.order = np.argsort(front.astype(np.uint16) if t + 2 * h + w < 65_536 else front, kind="stable")
        places = ((days.astype(np.int64) + 1) * (h + 1) + y + 1) * (w + 2) + x + 1
        self.places, self.ends = places[self.order], np.cumsum(np.bincount(front))

    def walk(self, settle) -> np.ndarray:
        """Values of the cells in C order; ``settle(slice, predicted)`` gives those of a slice of ``order``. Cells that aren't there are zero."""
        t, h, w = self.shape
        state = np.zeros((t + 1) * (h + 1) * (w + 2))
        row, plane, begin = w + 2, (h + 1) * (w + 2), 0
        for end in self.ends.tolist():
            here, some, begin = self.places[begin:end], slice(begin, end), end
            total, weight = np.zeros(len(here)), np.zeros(len(here))
            for back, factor in zip((1, row, row + 1, row - 1, plane), WEIGHTS):
                near = state[here - back]
                # A value of zero counts as not available, and adds nothing.
                weight += (near != 0.0) * factor
                near *= factor
                total += near
            cold = weight == 0
            weight[cold] = 1.0
            total /= weight
            total[cold] = COLD
            state[here] = settle(some, total)
        out = np.empty(len(self.order))
        out[self.order] = state[self.places]
        return out


def encode_valid(valid: np.ndarray, missing: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, float64 reconstruction) of the valid cells, given and returned in C order."""
    fronts, inverse = Fronts(missing), 1.0 / step
    data = valid.astype(np.float64)[fronts.order]
    found = np.empty(len(data))

    def settle(some: slice, predicted: np.ndarray) -> np.ndarray:
        q = data[some] - predicted
        q *= inverse
        q += 0.5
        np.clip(np.floor(q, out=q), -CLAMP, CLAMP, out=q)
        found[some] = q
        return predicted + q * step

    recon = fronts.walk(settle)
    symbols = np.empty(len(data), np.int64)
    symbols[fronts.order] = found
    return symbols, recon


def decode_valid(symbols: np.ndarray, missing: np.ndarray, step: float, origin: float = 0.0) -> np.ndarray:
    """The reconstruction of the valid cells, in C order."""
    fronts = Fronts(missing)
    deltas = symbols[fronts.order] * step + origin
    return fronts.walk(lambda some, predicted: predicted + deltas[some])


def _spread(valid: np.ndarray, missing: np.ndarray) -> np.ndarray:
    out = np.zeros(missing.shape)
    out[~missing] = valid
    return out


def scan_encode(values: np.ndarray, missing: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the valid cells in C order, float64 reconstruction with 0.0 where missing)."""
    symbols, recon = encode_valid(values[~missing], missing, step)
    return symbols, _spread(recon, missing)


def scan_decode(symbols: np.ndarray, missing: np.ndarray, step: float, origin: float = 0.0) -> np.ndarray:
    return _spread(decode_valid(symbols, missing, step, origin), missing)
