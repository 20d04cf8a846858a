"""Moment-based label model for conditionally independent labeling functions.

From the vote co-occurrence rates O the model finds mu[cell, y] = P(cell fires | Y = y)
such that mu P mu' matches O off the function's own block and mu P 1 matches its
diagonal, with a ridge towards the starting point (Ratner et al., 2019).

O is a sparse table that never leaves the executors. It is cut into blocks of rows of at most
``BLOCK_NUMBERS`` numbers. All pairs that never meet enter the gradient through a classes x classes
product, so an epoch costs one product of each block with the parameters. With one block (up to
1,024 cells) all epochs run in one task; with more, an epoch is a job over the blocks, and only
cells x classes numbers, the parameters themselves, travel between them and the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import once
from labelloom.functions.vectors import first_argmax, tied_at_top
from labelloom.operators.co_occurrence import co_occurrence
from labelloom.operators.labeling import ABSTAIN, LabelingSet
from labelloom.operators.posterior import CellMap, cell_patterns, posterior
from labelloom.session import release, scratch_table, stored
from labelloom.sizing import constant, local_frame

# Numbers of a block of O as a matrix inside a task (8 MB).
BLOCK_NUMBERS = 1 << 20

# Fixed values of the estimator.
START_PRECISION = 0.7
MU_FLOOR = 0.01
TIE_TOLERANCE = 1e-5


@dataclass(frozen=True)
class LabelModelOptions:
    epochs: int = 1000
    learning_rate: float = 1e-3
    l2: float = 2.0
    # The starting point is scaled by this number from (0, 1]; None draws it from the seed.
    start_scale: float | None = None
    seed: int = 0


@dataclass(frozen=True)
class LabelModel:
    lfs: LabelingSet
    n_classes: int
    mu: np.ndarray  # cells x classes
    balance: np.ndarray

    def mu_frame(self, spark: SparkSession) -> DataFrame:
        cells = CellMap(self.lfs, tuple(range(self.n_classes))).cells()
        rows = [
            (self.lfs.names[lf], voted, y, float(self.mu[i, y]))
            for i, (lf, voted) in enumerate(cells)
            for y in range(self.n_classes)
        ]
        return local_frame(spark, rows, "criterion string, voted_idx int, true_idx int, p double")

    @staticmethod
    def from_frame(params: DataFrame, lfs: LabelingSet, n_classes: int, balance: list[float] | None = None) -> LabelModel:
        """The model of stored parameters (``mu_frame``)."""
        cells = CellMap(lfs, tuple(range(n_classes))).cells()
        row = {(lfs.names[lf], voted): i for i, (lf, voted) in enumerate(cells)}
        mu = np.zeros((len(cells), n_classes))
        for r in params.collect():
            mu[row[r.criterion, r.voted_idx], r.true_idx] = r.p
        return LabelModel(lfs, n_classes, mu, np.array(balance) if balance else np.full(n_classes, 1 / n_classes))


def moments(ballots: DataFrame, lfs: LabelingSet) -> DataFrame:
    """How often two functions vote on the same item: (criterion_a, criterion_b, n_both, rate).

    Each pair that meets is listed once, in function order, and each function with itself.
    """
    lf_patterns = ballots.groupBy(F.col("votes.lf").alias("cells")).agg(F.count("*").alias("n"))
    with scratch_table(lf_patterns, "patterns") as patterns:
        n_items = patterns.agg(F.sum("n")).first()[0] or 0
        pairs = stored(co_occurrence(patterns), "moments")
    names = constant(lfs.names, "array<string>")
    return pairs.select(
        F.get(names, F.col("a")).alias("criterion_a"),
        F.get(names, F.col("b")).alias("criterion_b"),
        F.col("n").alias("n_both"),
        (F.col("n") / F.lit(n_items)).alias("rate"),
    )


def fit(
    ballots: DataFrame,
    lfs: LabelingSet,
    n_classes: int,
    balance: list[float] | None = None,
    options: LabelModelOptions = LabelModelOptions(),
) -> LabelModel:
    """Fit by full-batch Adam on the co-occurrence rates; the balance is uniform unless given."""
    cell_map = CellMap(lfs, tuple(range(n_classes)))
    cells = cell_map.cells()
    p = np.array(balance) if balance else np.full(n_classes, 1 / n_classes)
    with scratch_table(cell_patterns(ballots, cell_map), "patterns") as patterns:
        n_items = patterns.agg(F.sum("n")).first()[0]
        if not n_items:
            raise ValueError("cannot fit a label model to no items")
        pairs = stored(co_occurrence(patterns), "co-occurrence")
    # one number per cell
    propensity = np.zeros(len(cells))
    for r in pairs.filter("a = b").collect():
        propensity[r.a] = r.n / n_items
    descent = Descent.start(propensity, cells, p, options)
    blocks = stored(moment_blocks(pairs, cells, n_items), "moment-blocks")
    mu = descended(blocks, descent, options.epochs)
    release(pairs, blocks)
    floor = min(MU_FLOOR, 1 / 10 ** math.ceil(math.log10(n_items)))
    mu = np.clip(mu, floor, 1 - floor)
    return LabelModel(lfs, n_classes, align_columns(mu, cells, p), p)


# --- descent -------------------------------------------------------------------------


@dataclass
class Descent:
    """Parameters on their way down, with Adam's moments.

    The gradient needs of O only its product with the weighted parameters, which may come from
    many tasks; the rest is a classes x classes product and the functions' own blocks.
    """

    mu: np.ndarray
    anchor: np.ndarray
    propensity: np.ndarray
    owner: np.ndarray  # function of each cell, ascending
    p: np.ndarray
    options: LabelModelOptions
    first: np.ndarray
    second: np.ndarray
    step: int = 0

    @staticmethod
    def start(propensity: np.ndarray, cells: list[tuple[int, int]], p: np.ndarray, options: LabelModelOptions) -> Descent:
        owner, voted = (np.array(x, np.int64) for x in (list(zip(*cells)) or ([], [])))
        anchor = np.zeros((len(cells), len(p)))
        anchor[np.arange(len(cells)), voted] = np.clip(propensity * START_PRECISION / p[voted], 0, 1)
        scale = options.start_scale
        if scale is None:
            scale = np.random.default_rng(options.seed).random()
        zero = np.zeros_like(anchor)
        return Descent(anchor * scale, anchor, propensity, owner, p, options, zero, zero)

    def weighted(self) -> np.ndarray:
        return self.mu * self.p

    def own_blocks(self, weighted: np.ndarray) -> np.ndarray:
        """(mu P mu' restricted to the cells of one function) times the weighted parameters."""
        out = (self.mu * weighted).sum(axis=1, keepdims=True) * weighted
        starts = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1]))
        ends = np.append(starts[1:], len(self.owner))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            out[a:b] = weighted[a:b] @ (self.mu[a:b].T @ weighted[a:b])
        return out

    def move(self, together: np.ndarray) -> None:
        """One epoch; ``together`` is O off the functions' own blocks, times the weighted parameters."""
        o, w = self.options, self.weighted()
        side = self.mu @ self.p - self.propensity
        gap = together - w @ (self.mu.T @ w) + self.own_blocks(w)
        gradient = -4 * gap + 2 * side[:, None] * self.p + 2 * o.l2**2 * (self.mu - self.anchor)
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        scaled = (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        self.mu = self.mu - o.learning_rate * scaled


def rows_per_block(n_cells: int) -> int:
    return max(1, BLOCK_NUMBERS // max(n_cells, 1))


def moment_blocks(pairs: DataFrame, cells: list[tuple[int, int]], n_items: int) -> DataFrame:
    """(block, a, b, rate): the non-zero entries of some rows of O, without the functions' own blocks."""
    spark, n, rows = pairs.sparkSession, len(cells), rows_per_block(len(cells))
    owner = np.array([lf for lf, _ in cells])

    def packed(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        a, b, count = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        # the row without cells only says that there is such a block
        kept = a >= 0
        kept[kept] = owner[a[kept]] != owner[b[kept]]
        whole = lambda x, t: pa.ListArray.from_arrays(pa.array([0, kept.sum()], pa.int32()), pa.array(x[kept], t))
        lists = [whole(a - block * rows, pa.int32()), whole(b, pa.int32()), whole(count / n_items, pa.float64())]
        return pa.Table.from_arrays([pa.array([block], pa.int64()), *lists], ["block", "a", "b", "rate"])

    both = pairs.unionByName(pairs.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    placed = both.withColumn("block", F.expr(f"a div {rows}"))
    every = spark.range(max(1, -(-n // rows))).select(
        F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("n"), F.col("id").alias("block")
    )
    schema = "block long, a array<int>, b array<int>, rate array<double>"
    return placed.unionByName(every).groupBy("block").applyInArrow(packed, schema)


def descended(blocks: DataFrame, descent: Descent, epochs: int) -> np.ndarray:
    """The parameters after all epochs."""
    n, k = descent.mu.shape
    if not n or not epochs:
        return descent.mu
    rows = rows_per_block(n)

    def sent(block: int, values: np.ndarray) -> pa.Table:
        at = pa.array(np.arange(len(values)) + block * rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * k, pa.int32()), pa.array(values.ravel()))
        return pa.table({"cell": at, "x": lists})

    def taken(table: pa.Table) -> tuple[int, np.ndarray]:
        block = table.column("block")[0].as_py()
        a, b, rate = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b", "rate"))
        matrix = np.zeros((min(rows, n - block * rows), n))
        matrix[a, b] = rate
        return block, matrix

    def gathered(df: DataFrame) -> np.ndarray:
        table, out = df.toArrow(), np.zeros((n, k))
        if table.num_rows:
            flat = table.column("x").combine_chunks().flatten().to_numpy()
            out[table.column("cell").to_numpy()] = flat.reshape(-1, k)
        return out

    if rows >= n:

        def all_epochs(table: pa.Table) -> pa.Table:
            block, matrix = taken(table)
            for _ in range(epochs):
                descent.move(matrix @ descent.weighted())
            return sent(block, descent.mu)

        return gathered(blocks.groupBy("block").applyInArrow(all_epochs, "cell long, x array<double>"))

    def product_with(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def product(table: pa.Table) -> pa.Table:
            block, matrix = taken(table)
            return sent(block, matrix @ shared.value)

        return product

    for _ in range(epochs):
        shared = blocks.sparkSession.sparkContext.broadcast(descent.weighted())
        product = blocks.groupBy("block").applyInArrow(product_with(shared), "cell long, x array<double>")
        descent.move(gathered(product))
        shared.destroy()
    return descent.mu


def descend(rates: np.ndarray, cells: list[tuple[int, int]], p: np.ndarray, options: LabelModelOptions) -> np.ndarray:
    """The descent on a matrix of rates at hand. Entries of one function against itself are masked."""
    descent = Descent.start(np.diag(rates), cells, p, options)
    off = np.where(descent.owner[:, None] != descent.owner[None, :], rates, 0.0)
    for _ in range(options.epochs):
        descent.move(off @ descent.weighted())
    return descent.mu


def align_columns(mu: np.ndarray, cells: list[tuple[int, int]], p: np.ndarray) -> np.ndarray:
    """Undo a permutation of the hidden classes: functions should favour the class they vote for.

    Columns may only trade places among classes of equal balance.
    """
    k = len(p)
    gain = np.zeros((k, k))  # gain[voted, hidden]
    np.add.at(gain, [voted for _, voted in cells], mu * p)
    aligned = mu.copy()
    groups: dict[float, list[int]] = {}
    for y, share in enumerate(np.round(p, 3)):
        groups.setdefault(float(share), []).append(y)
    for group in groups.values():
        hidden = best_assignment(gain[np.ix_(group, group)])
        for voted, h in zip(group, hidden):
            aligned[:, voted] = mu[:, group[h]]
    return aligned


def best_assignment(gain: np.ndarray) -> list[int]:
    """For each row the column that maximises the total gain (shortest augmenting paths)."""
    n = len(gain)
    cost = gain.max(initial=0.0) - gain
    row_of = [-1] * n  # row assigned to a column
    u, v = np.zeros(n), np.zeros(n)
    for row in range(n):
        slack = cost[row] - u[row] - v
        back = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        rows_in_tree = [(row, 0.0)]
        while True:
            col = int(np.argmin(np.where(done, np.inf, slack)))
            reach = slack[col]
            done[col] = True
            if row_of[col] < 0:
                break
            other = row_of[col]
            rows_in_tree.append((other, reach))
            better = cost[other] - u[other] - v + reach
            closer = ~done & (better < slack)
            slack = np.where(closer, better, slack)
            back = np.where(closer, col, back)
        for r, seen_at in rows_in_tree:
            u[r] += reach - seen_at
        v[done] -= reach - slack[done]
        while back[col] >= 0:
            row_of[col] = row_of[back[col]]
            col = back[col]
        row_of[col] = row
    answer = [0] * n
    for col, r in enumerate(row_of):
        answer[r] = col
    return answer


def predict_proba(ballots: DataFrame, model: LabelModel, lfs: LabelingSet | None = None) -> DataFrame:
    """Add ``proba``: balance times the likelihood of each vote, normalised. Abstains say nothing."""
    lfs = lfs or model.lfs
    classes = tuple(range(model.n_classes))
    fitted = {f.criterion: f.lf for f in model.lfs.functions}
    row_of = {cell: i for i, cell in enumerate(CellMap(model.lfs, classes).cells())}
    own = CellMap(lfs, classes)
    table = np.array([model.mu[row_of[fitted[lfs.names[lf]], voted]] for lf, voted in own.cells()])
    table = np.log(table.reshape(-1, model.n_classes))
    return ballots.withColumn("proba", posterior(own.of(F.col("votes")), np.log(model.balance), table))


def predict(ballots: DataFrame, model: LabelModel, lfs: LabelingSet | None = None) -> DataFrame:
    """Add ``proba`` and ``pred``; several classes on top make the item an abstain (-1)."""
    scored = predict_proba(ballots, model, lfs)
    pick = once(
        F.col("proba"),
        lambda p: F.when(tied_at_top(p, TIE_TOLERANCE), F.lit(ABSTAIN)).otherwise(first_argmax(p)),
    )
    return scored.withColumn("pred", pick)
