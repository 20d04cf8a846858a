"""How often cells fire together, as a sparse table of pairs.

Patterns of any number of cells are counted without a cells x cells block per task: the
``HEAVY`` most frequent cells are counted against each other in one small dense block, and
every pair with a rarer cell is listed and added up, a bounded number of pairs at a time. So
a task emits the pairs it saw, and two cells that never meet cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells counted densely (8 MB a task), pairs listed at a time, and pairs kept before they are sent.
HEAVY = 1024
PAIRS = 1 << 20
KEPT = 1 << 21
# Numbers of one 0/1 matrix of patterns.
BLOCK_NUMBERS = 8_000_000

COUNTED = "a int, b int, n long"


def frequent_cells(patterns: DataFrame) -> np.ndarray:
    """The cells of the most patterns, at most ``HEAVY`` of them, ascending."""
    cells = patterns.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    top = cells.orderBy(F.desc("n"), "cell").limit(HEAVY).collect()
    return np.array(sorted(r.cell for r in top), np.int64)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class PairSums:
    """Counts of listed pairs, added up until they are sent."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        key, where = np.unique(key, return_inverse=True)
        self.parts.append((key, np.bincount(where, n, len(key))))
        self.size += len(key)
        if self.size > KEPT:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([x for _, x in self.parts]), len(key))
        self.parts, self.size = [(key, n)], len(key)
        return key, n

    def taken(self) -> pa.RecordBatch:
        key, n = self.merge()
        self.parts, self.size = [], 0
        return counted(key >> 32, key & 0xFFFFFFFF, n)


def counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.rint(n).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])


def co_occurrence(patterns: DataFrame) -> DataFrame:
    """Items in which two cells fire together: (a, b, n) with a <= b, the diagonal included.

    ``patterns(cells, n)`` has to be stored, as it is read twice.
    """
    heavy = frequent_cells(patterns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = np.zeros((len(heavy), len(heavy))), PairSums()
        for batch in batches:
            lists, n = batch.column(0), batch.column(1).to_numpy().astype(np.float64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cells = lists.flatten().to_numpy().astype(np.int64)
            pattern = np.repeat(np.arange(len(n)), lengths)
            place = np.searchsorted(heavy, cells)
            is_heavy = np.zeros(len(cells), bool)
            within = place < len(heavy)
            is_heavy[within] = heavy[place[within]] == cells[within]
            # both frequent: one matrix product for some patterns at a time
            step = max(BLOCK_NUMBERS // max(len(heavy), 1), 1)
            at, row = place[is_heavy], pattern[is_heavy]
            for first in range(0, len(n), step):
                lo, hi = np.searchsorted(row, (first, first + step))
                fired = np.zeros((min(step, len(n) - first), len(heavy)))
                fired[row[lo:hi] - first, at[lo:hi]] = 1.0
                block += fired.T @ (fired * n[first : first + step, None])
            # at least one rarer cell: pairs of it with all cells of the pattern
            start = np.cumsum(lengths) - lengths
            light = np.flatnonzero(~is_heavy)
            size = lengths[pattern[light]]
            cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(size) // PAIRS)))
            for lo, hi in zip(cuts, [*cuts[1:], len(light)]):
                entry, k = light[lo:hi], size[lo:hi]
                one = np.repeat(entry, k)
                other = np.repeat(start[pattern[entry]], k) + spread(k)
                # two rare cells meet twice: the order of their numbers picks one
                wanted = is_heavy[other] | (cells[one] <= cells[other])
                one, other = one[wanted], other[wanted]
                a, b = np.minimum(cells[one], cells[other]), np.maximum(cells[one], cells[other])
                sums.add(a << 32 | b, n[pattern[one]])
                if sums.size > KEPT // 2:
                    yield sums.taken()
        i, j = np.nonzero(np.triu(block))
        yield counted(heavy[i], heavy[j], block[i, j])
        if sums.parts:
            yield sums.taken()

    return patterns.select("cells", "n").mapInArrow(partial, COUNTED).groupBy("a", "b").agg(F.sum("n").alias("n"))
