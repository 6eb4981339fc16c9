"""Seeded multinomial counts by binomial splitting, computable piece by piece on any task.

Distributing ``n`` draws over cells is the same as splitting them in two by a binomial draw, then
each half again.  Every split has a generator of its own, seeded by the split's place, so a
task that needs the counts of a few cells walks down to them alone, and two tasks agree on every
count without exchanging one.  Counts are vectors over all replicates.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
# Counts a task remembers, in bytes.
HELD_BYTES = 384 << 20


def generator(*place: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(place)))


def split(counts: np.ndarray, left: int, total: int, *place: int) -> np.ndarray:
    """How many of each replicate's draws fall into the left part of a range."""
    if left == 0 or total == 0:
        return np.zeros_like(counts)
    if left == total:
        return counts
    return generator(*place).binomial(counts, left / total)


def interval_counts(counts: np.ndarray, n: int, edges: np.ndarray, *place: int) -> np.ndarray:
    """Draws over ``n`` equally likely rows that fall between consecutive ``edges``.

    ``edges`` ascend from 0 to ``n``; the result is intervals x replicates.  Only splits that an edge
    falls into are walked, so a wide interval costs no more than its two ends.
    """
    out = np.zeros((len(edges) - 1, len(counts)), np.int64)
    open_ = [(0, -(-n // LEAF), counts)]
    while open_:
        lo, hi, counts = open_.pop()
        start, stop = lo * LEAF, min(hi * LEAF, n)
        if start >= stop:
            continue
        first = np.searchsorted(edges, start, side="right") - 1
        last = np.searchsorted(edges, stop, side="left") - 1
        if first == last:
            out[first] += counts
        elif hi - lo == 1:
            size = stop - start
            drawn = generator(*place, lo, hi).multinomial(counts, np.full(size, 1 / size)).T
            inside = np.searchsorted(edges, np.arange(start, stop), side="right") - 1
            np.add.at(out, inside, drawn)
        else:
            mid = (lo + hi) // 2
            left = split(counts, (mid - lo) * LEAF, stop - start, *place, lo, hi)
            open_ += [(lo, mid, left), (mid, hi, counts - left)]
    return out


class EqualCells:
    """Counts of ``n`` draws over ``n`` equally likely cells, for any cells asked for.

    Blocks of cells are kept between calls as long as they fit into ``most_bytes``, a byte for each
    count unless one needs more.  If all blocks fit, asking for a good part of them draws them all.
    """

    def __init__(self, n: int, replicates: int, seed: int | tuple[int, ...], most_bytes: int = HELD_BYTES):
        self.n, self.replicates = n, replicates
        self.place = seed if isinstance(seed, tuple) else (seed,)
        self.blocks = -(-n // LEAF)
        self.most = max(1, most_bytes // (LEAF * replicates))
        self.slot = np.full(self.blocks, -1, np.int64)
        self.used = 0
        # Reserved, not touched: pages are taken as blocks come.
        self.table = np.empty((min(self.most, self.blocks), LEAF, replicates), np.uint8)

    def hold(self, blocks: np.ndarray) -> None:
        """Draw what is not known of distinct ``blocks``, at most ``most`` of them."""
        missing = blocks[self.slot[blocks] < 0]
        if self.blocks <= self.most and len(missing) * 64 >= self.blocks:
            missing = np.flatnonzero(self.slot < 0)
        elif self.used + len(missing) > self.most:
            self.slot[:] = -1
            self.used, missing = 0, blocks
        if len(missing) > len(self.table):
            self.table = np.empty((len(missing), *self.table.shape[1:]), self.table.dtype)
        self._descend(missing)

    def weights(self, cells: np.ndarray) -> np.ndarray:
        """Cells x replicates of cells whose blocks are held, in the narrow type they are kept in."""
        return self.table[self.slot[cells // LEAF], cells % LEAF]

    def counts(self, cells: np.ndarray) -> np.ndarray:
        """Cells x replicates."""
        self.hold(np.unique(cells // LEAF))
        return self.weights(cells).astype(np.int64)

    def _descend(self, blocks: np.ndarray) -> None:
        if not len(blocks):
            return
        start = np.full(self.replicates, self.n, np.int64)
        open_ = [(0, self.blocks, start, blocks)]
        while open_:
            lo, hi, counts, some = open_.pop()
            if hi - lo == 1:
                size = min(LEAF, self.n - lo * LEAF)
                drawn = generator(*self.place, lo, hi).multinomial(counts, np.full(size, 1 / size))
                if drawn.max(initial=0) > np.iinfo(self.table.dtype).max:
                    self.table = self.table.astype(np.uint32)
                self.table[self.used, :size] = drawn.T
                self.slot[lo], self.used = self.used, self.used + 1
                continue
            mid = (lo + hi) // 2
            whole = min(hi * LEAF, self.n) - lo * LEAF
            left = split(counts, (mid - lo) * LEAF, whole, *self.place, lo, hi)
            cut = np.searchsorted(some, mid)
            if cut:
                open_.append((lo, mid, left, some[:cut]))
            if cut < len(some):
                open_.append((mid, hi, counts - left, some[cut:]))
