"""Rolling hashes of windows, and the choice of anchors by content, for Arrow batches.

Of every ``window`` consecutive symbols the anchor is the run of ``short`` symbols with the smallest hash
(the leftmost of equals). Equal windows have equal anchors at the same distance, wherever they
stand, so windows need comparing only where their anchors agree. Neighbouring windows mostly share
their anchor: the windows of one anchor form a *stretch*."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_POWERS: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i below ``count``."""
    if len(_POWERS.get("base", ())) < count:
        size = 1 << int(count - 1).bit_length()
        for name, factor in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["base"][:count], _POWERS["inverse"][:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all of its bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any range of a sequence of symbols, themselves given as 64-bit hashes."""

    def __init__(self, symbols: np.ndarray):
        base, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * base[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts])

    def all_of(self, length: int) -> np.ndarray:
        """The hash of the range of this length from every start."""
        count = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:count]) * self.inverse[:count])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every start, the position of the smallest of ``width`` values, the leftmost of equals."""
    best, at, covered = values, np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = best[:-step], best[step:]
        keep = left <= right
        at = np.where(keep, at[:-step], at[step:])
        best = np.where(keep, left, right)
        covered += step
    return at


def stretches(hashes: Hashes, offsets: np.ndarray, window: int, short: int) -> dict[str, np.ndarray]:
    """The stretches of rows of symbols (row i is offsets[i]:offsets[i + 1]), with for each: its row,
    the first window (``start``, in the row), the number of windows, the hash of its anchor, and the
    hash of all it covers together with the anchor's place in it."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - window + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[rows]
    if not len(starts):
        none = np.empty(0, np.int64)
        return {"row": none, "start": none, "count": none, "anchor": none.astype(np.uint64), "content": none.astype(np.uint64)}
    shorts = hashes.all_of(short)
    owner = leftmost_minima(shorts, window - short + 1)[starts]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
    count = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], owner[first]
    content = hashes.of(begin, count + (window - 1)) ^ mixed((anchor - begin + 1).astype(np.uint64) * BASE + count.astype(np.uint64))
    return {"row": rows[first], "start": begin - offsets[rows[first]], "count": count,
            "anchor": shorts[anchor], "content": content}


def bounded_stretches(symbols, offsets: np.ndarray, window: int, short: int, limit: int = 1 << 18):
    """``stretches`` in portions of at most about ``limit`` windows, so that the arrays of a portion are bounded: long
    rows are cut, with the overlap that their windows need. ``symbols(a, b)`` are the hashes of a range of
    symbols. A stretch that a cut falls into becomes two."""
    held, size = [], 0

    def portion() -> dict[str, np.ndarray]:
        ranges = [(offsets[row] + at, offsets[row] + at + count + window - 1) for row, at, count in held]
        found = stretches(Hashes(np.concatenate([symbols(a, b) for a, b in ranges])),
                          np.concatenate([[0], np.cumsum([b - a for a, b in ranges])]), window, short)
        rows, first = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        return found | {"start": found["start"] + first[found["row"]], "row": rows[found["row"]]}

    for row, count in enumerate((np.diff(offsets) - window + 1).tolist()):
        for at in range(0, count, limit):
            here = min(limit, count - at)
            if held and size + here + window > limit:
                yield portion()
                held, size = [], 0
            held.append((row, at, here))
            size += here + window
    if held:
        yield portion()


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they overlap or touch, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
