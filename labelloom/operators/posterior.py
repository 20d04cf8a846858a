"""Shared ground of the two probabilistic label models.

A *cell* is a (labeling function, class voted) pair. A posterior adds, for every vote of
a ballot, the log-likelihood row of its cell to the log-prior and takes the softmax.
That is a row expression over a constant table, or one in Arrow batches over a broadcast one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.vectors import add, softmax
from labelloom.operators.labeling import LabelingFunction, LabelingSet
from labelloom.sizing import constant

# Numbers of a parameter table up to which it is a constant of the plan; a larger one is sent once
# to every executor, and read in Arrow batches.
PLANNED_NUMBERS = 100_000

# Numbers of one block of patterns x classes inside a task (64 MB).
BLOCK_NUMBERS = 8_000_000

ANY_CLASS = None


def annotators(names: list[str]) -> LabelingSet:
    """Functions that may vote for any class (a general vote matrix)."""
    return LabelingSet(tuple(LabelingFunction(i, n, None, ANY_CLASS) for i, n in enumerate(names)))


@dataclass(frozen=True)
class CellMap:
    """Numbers the cells: one per one-class function, K per annotator."""

    lfs: LabelingSet
    classes: tuple[int, ...]

    def place(self, class_idx: int) -> int:
        """Position of a class; one outside the list counts as the first."""
        return self.classes.index(class_idx) if class_idx in self.classes else 0

    def cells(self) -> list[tuple[int, int]]:
        """(function number, class position) per cell."""
        out = []
        for f in self.lfs.functions:
            if f.class_idx is ANY_CLASS:
                out += [(f.lf, k) for k in range(len(self.classes))]
            else:
                out.append((f.lf, self.place(f.class_idx)))
        return out

    def of(self, votes: Column) -> Column:
        """ARRAY<INT> of the cells of a ballot."""
        starts, at = [], 0
        for f in self.lfs.functions:
            starts.append(at)
            at += len(self.classes) if f.class_idx is ANY_CLASS else 1
        first = constant(starts, "array<int>")
        if all(f.class_idx is not ANY_CLASS for f in self.lfs.functions):
            return F.transform(votes, lambda v: F.get(first, v["lf"]))
        several = constant([f.class_idx is ANY_CLASS for f in self.lfs.functions], "array<boolean>")
        classes = constant(list(self.classes), "array<int>")
        place = lambda v: F.greatest(F.array_position(classes, v["c"]) - 1, F.lit(0)).cast("int")
        return F.transform(
            votes, lambda v: F.get(first, v["lf"]) + F.when(F.get(several, v["lf"]), place(v)).otherwise(0)
        )


@dataclass(frozen=True)
class Patterns:
    """Lists of cells by offsets, with the number of items that share each."""

    cells: np.ndarray
    lengths: np.ndarray
    n: np.ndarray

    def pattern(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @staticmethod
    def blocks(batches: Iterable[pa.RecordBatch], n_classes: int) -> Iterator[Patterns]:
        """The patterns (cells, n) of a task, a bounded number at a time."""
        step = max(BLOCK_NUMBERS // max(n_classes, 1), 1)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(0)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield Patterns(lists.flatten().to_numpy(), lengths, part.column(1).to_numpy())


@dataclass(frozen=True)
class LogRows:
    """Log-likelihoods per cell and class.

    The row of a cell is ``base`` everywhere with ``jump`` more at the class ``voted``, or, where
    ``dense_at`` is not negative, that row of ``dense`` (base and jump are 0 there).
    """

    base: np.ndarray
    jump: np.ndarray
    voted: np.ndarray
    dense_at: np.ndarray
    dense: np.ndarray

    @staticmethod
    def of_table(table: np.ndarray) -> LogRows:
        zero = np.zeros(len(table))
        return LogRows(zero, zero, np.zeros(len(table), np.int64), np.arange(len(table)), table)

    @property
    def n_numbers(self) -> int:
        return 3 * len(self.base) + self.dense.size

    def table(self) -> np.ndarray:
        """All rows at full size."""
        out = np.repeat(self.base[:, None], self.dense.shape[1], axis=1)
        out[np.arange(len(out)), self.voted] += self.jump
        is_dense = self.dense_at >= 0
        out[is_dense] = self.dense[self.dense_at[is_dense]]
        return out

    def logits(self, part: Patterns, log_prior: np.ndarray) -> np.ndarray:
        """The prior plus the rows of the cells of each pattern."""
        out = np.repeat(log_prior[None, :], len(part.lengths), axis=0)
        pattern, cells = part.pattern(), part.cells
        out += np.bincount(pattern, self.base[cells], len(part.lengths))[:, None]
        np.add.at(out, (pattern, self.voted[cells]), self.jump[cells])
        at = self.dense_at[cells]
        rows, at = pattern[at >= 0], at[at >= 0]
        # as many rows at a time as a block may have numbers
        step = max(BLOCK_NUMBERS // max(len(log_prior), 1), 1)
        for lo in range(0, len(at), step):
            r = rows[lo : lo + step]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            out[r[first]] += np.add.reduceat(self.dense[at[lo : lo + step]], first, axis=0)
        return out

    def dense_sums(self, cells: np.ndarray, pattern: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, sum of the rows of ``values`` of its patterns) for the cells with dense rows."""
        kept = np.flatnonzero(self.dense_at[cells] >= 0)
        kept = kept[np.argsort(cells[kept], kind="stable")]
        step = max(BLOCK_NUMBERS // max(values.shape[1], 1), 1)
        for lo in range(0, len(kept), step):
            part = kept[lo : lo + step]
            own = cells[part]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield from zip(own[first].tolist(), np.add.reduceat(values[pattern[part]], first, axis=0))


def posterior(cells: Column, log_prior: np.ndarray, rows: LogRows | np.ndarray) -> Column:
    """ARRAY<DOUBLE> of class probabilities of a ballot given as cells.

    A small table of parameters is part of the plan. A larger one is broadcast, as the model
    that holds it is no larger than that, and applied to Arrow batches of ballots.
    """
    if isinstance(rows, np.ndarray):
        rows = LogRows.of_table(rows)
    if len(rows.base) * len(log_prior) <= PLANNED_NUMBERS:
        start = constant(log_prior.tolist(), "array<double>")
        table = constant(rows.table().tolist(), "array<array<double>>")
        return softmax(F.aggregate(cells, start, lambda acc, cell: add(acc, F.get(table, cell))))
    shared = SparkSession.active().sparkContext.broadcast((rows, log_prior))

    def judged(lists: pa.Array) -> pa.Array:
        rows, log_prior = shared.value
        k, step, out = len(log_prior), max(BLOCK_NUMBERS // len(log_prior), 1), []
        for at in range(0, len(lists), step):
            part = lists.slice(at, step).fill_null([])
            lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            logits = rows.logits(Patterns(part.flatten().to_numpy(), lengths, lengths), log_prior)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.ravel())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return F.arrow_udf(judged, "array<double>")(cells)


def cell_patterns(ballots: DataFrame, cell_map: CellMap) -> DataFrame:
    """Distinct ballots as cells, with the number of items: (cells, n).

    Items with the same votes share a posterior, so iterations run over patterns. The
    count is combined before the shuffle, which also takes care of the one pattern
    (no vote at all) that may hold a large part of the items.
    """
    return ballots.groupBy(cell_map.of(F.col("votes")).alias("cells")).agg(F.count("*").alias("n"))
