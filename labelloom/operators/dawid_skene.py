"""Regularised Dawid-Skene EM.

The items are reduced once to vote patterns, written to the shared folder. A pass sums, over
the patterns, the soft counts per class and per cell; the update of the parameters is algebra
on those sums. Patterns of up to ``ENTRIES_PER_TASK`` votes are one task, in which all passes
run; with more of them a pass is one Spark job whose tasks each add up their own patterns
before a shuffle joins the sums. No lineage grows over the passes.

The confusion matrix of a function that only votes for one class v has three different numbers
in a row: at v, on the diagonal, and everywhere else. It is kept as three vectors, so that
thousands of classes cost functions x classes numbers. Functions that vote for any class have
whole matrices. Votes add their rows of log-likelihoods by offsets (``reduceat``); the row of a
one-class function read by the class voted is one number and a jump at v.

The entropy penalty of the original objective subtracts the same number from all
classes of an item before the softmax and so changes nothing; it is left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.vectors import first_argmax
from labelloom.operators.labeling import LabelingSet
from labelloom.operators.posterior import ANY_CLASS, CellMap, LogRows, Patterns, cell_patterns, posterior
from labelloom.session import scratch_table
from labelloom.sizing import constant, local_frame

# Fixed values of the estimator.
DEFAULT_ACCURACY = 0.7
ACCURACY_RANGE = (0.3, 0.9)
MIN_VOTES_FOR_ACCURACY = 5
MAX_DATA_WEIGHT = 0.8
GLOBAL_WEIGHT = 0.1
CELL_FLOOR = 1e-6
LOG_FLOOR = 1e-15
LIKELIHOOD_FLOOR = 1e-10

_ALL = -1
# Votes of patterns that one task holds through all passes (4 MB).
ENTRIES_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Options:
    max_iter: int = 30
    tol: float = 1e-4
    prior_strength: float = 50.0
    confusion_smoothing: float = 20.0
    min_class_support: float = 0.1
    # "reference" reads a confusion row by the class voted, "standard" by the true class.
    orientation: str = "reference"


# --- confusion matrices --------------------------------------------------------------


@dataclass(frozen=True)
class Confusions:
    """A matrix (true class x class voted) per function.

    Row t of a one-class function has ``column[t]`` at its class, ``diagonal[t]`` at t and
    ``rest[t]`` elsewhere; where t is its class, the first two are the same entry. ``full``
    holds the matrices of the others, in order of the functions.
    """

    voted: np.ndarray  # class position of one-class functions, -1 for the others
    column: np.ndarray  # one-class functions x classes
    diagonal: np.ndarray
    rest: np.ndarray
    full: np.ndarray  # other functions x classes x classes

    @property
    def k(self) -> int:
        return self.column.shape[1]

    @property
    def is_single(self) -> np.ndarray:
        return self.voted >= 0

    @property
    def at_voted(self) -> np.ndarray:
        return self.voted[self.is_single][:, None] == np.arange(self.k)[None, :]

    def place(self) -> np.ndarray:
        """Number of each function among those of its kind."""
        return np.where(self.is_single, np.cumsum(self.is_single), np.cumsum(~self.is_single)) - 1

    def each(self, op: Callable, *others: Confusions, per_function: np.ndarray | None = None) -> Confusions:
        """``op`` on all entries, with those of ``others`` and a number per function."""
        single, whole = [], []
        if per_function is not None:
            single, whole = [per_function[self.is_single][:, None]], [per_function[~self.is_single][:, None, None]]
        parts = {x: op(getattr(self, x), *[getattr(o, x) for o in others], *single) for x in ("column", "diagonal", "rest")}
        return Confusions(self.voted, **parts, full=op(self.full, *[o.full for o in others], *whole))

    def rows_to_one(self) -> Confusions:
        others = np.where(self.at_voted, (self.k - 1) * self.rest, self.diagonal + (self.k - 2) * self.rest)
        sums = self.column + others
        sums = np.where(sums == 0, 1.0, sums)
        wholes = self.full.sum(axis=-1, keepdims=True)
        return Confusions(
            self.voted, self.column / sums, self.diagonal / sums, self.rest / sums, self.full / np.where(wholes == 0, 1.0, wholes)
        )

    @staticmethod
    def symmetric(voted: np.ndarray, accuracy: np.ndarray, k: int) -> Confusions:
        """Each function's accuracy on the diagonal, the rest spread evenly."""
        single = voted >= 0
        right = np.repeat(accuracy[single][:, None], k, axis=1)
        wrong = (1 - right) / (k - 1)
        at_voted = voted[single][:, None] == np.arange(k)[None, :]
        own, eye = accuracy[~single][:, None, None], np.eye(k)[None, :, :] if (~single).any() else np.zeros((1, k, k))[:0]
        full = own * eye + (1 - own) / (k - 1) * (1 - eye) if (~single).any() else np.zeros((0, k, k))
        return Confusions(voted, np.where(at_voted, right, wrong), right, wrong, full)

    def matrix(self, lf: int) -> np.ndarray:
        at = self.place()[lf]
        if not self.is_single[lf]:
            return self.full[at]
        out = np.repeat(self.rest[at][:, None], self.k, axis=1)
        np.fill_diagonal(out, self.diagonal[at])
        out[:, self.voted[lf]] = self.column[at]
        return out


def default_confusions(voted: np.ndarray, k: int) -> Confusions:
    if k < 2:
        raise ValueError("Dawid-Skene needs at least two classes")
    return Confusions.symmetric(voted, np.full(len(voted), DEFAULT_ACCURACY), k)


@dataclass(frozen=True)
class DawidSkeneModel:
    lfs: LabelingSet
    classes: tuple[int, ...]
    prior: np.ndarray  # K
    confusions: Confusions
    options: Options = Options()
    n_iter: int = 0
    log_likelihood: float = float("nan")

    @property
    def confusion(self) -> np.ndarray:
        """All matrices at full size: functions x true class x class voted."""
        return np.array([self.confusions.matrix(lf) for lf in range(len(self.lfs))])

    def prior_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(p)) for c, p in zip(self.classes, self.prior)]
        return local_frame(spark, rows, "class_idx int, p double")

    def confusion_frame(self, spark: SparkSession) -> DataFrame:
        """(criterion, true_idx, pred_idx, p). Rows are spread out by Spark, from one per function and true class."""
        cm, k = self.confusions, len(self.classes)
        names, place = self.lfs.names, cm.place()
        single, whole = np.flatnonzero(cm.is_single), np.flatnonzero(~cm.is_single)
        classes = constant(list(self.classes), "array<int>")
        head = {
            "criterion": pa.array([names[j] for j in single for _ in range(k)], pa.string()),
            "t": pa.array(np.tile(np.arange(k, dtype=np.int32), len(single))),
            "v": pa.array(np.repeat(cm.voted[single], k).astype(np.int32)),
        } | {x: pa.array(getattr(cm, x).ravel()) for x in ("column", "diagonal", "rest")}
        three = spark.createDataFrame(
            pa.table(head), "criterion string, t int, v int, column double, diagonal double, rest double"
        ).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("p_at"))
        value = F.when(F.col("p_at") == F.col("v"), F.col("column")).when(F.col("p_at") == F.col("t"), F.col("diagonal"))
        out = three.select("criterion", "t", "p_at", value.otherwise(F.col("rest")).alias("p"))
        if len(whole):
            rows = pa.table(
                {
                    "criterion": pa.array([names[j] for j in whole for _ in range(k)], pa.string()),
                    "t": pa.array(np.tile(np.arange(k, dtype=np.int32), len(whole))),
                    "row": pa.array(cm.full[place[whole]].reshape(-1, k).tolist(), pa.list_(pa.float64())),
                }
            )
            full = spark.createDataFrame(rows, "criterion string, t int, row array<double>")
            full = full.select("criterion", "t", F.posexplode("row").alias("p_at", "p"))
            out = out.unionByName(full) if len(single) else full
        return out.select("criterion", F.get(classes, "t").alias("true_idx"), F.get(classes, "p_at").alias("pred_idx"), "p")

    def cell_map(self, lfs: LabelingSet | None = None) -> CellMap:
        return CellMap(lfs or self.lfs, self.classes)

    def log_rows(self, lfs: LabelingSet | None = None) -> LogRows:
        """Log-likelihoods of the cells of ``lfs`` (which may be a part of the fitted ones)."""
        lfs = lfs or self.lfs
        number = {f.criterion: f.lf for f in self.lfs.functions}
        cells = self.cell_map(lfs).cells()
        own = np.array([number[lfs.names[lf]] for lf, _ in cells], np.int64)
        voted = np.array([v for _, v in cells], np.int64)
        cm, by_vote = self.confusions, self.options.orientation == "reference"
        at, single = cm.place()[own], cm.is_single[own]
        short = single & by_vote
        log = lambda x: np.log(x + LOG_FLOOR)
        base, jump = np.zeros(len(cells)), np.zeros(len(cells))
        base[short] = log(cm.rest[at[short], voted[short]])
        jump[short] = log(cm.column[at[short], voted[short]]) - base[short]
        long = np.flatnonzero(~short)
        rows = [cm.column[at[i]] if single[i] else cm.full[at[i], voted[i], :] if by_vote else cm.full[at[i], :, voted[i]] for i in long]
        dense_at = np.full(len(cells), -1, np.int64)
        dense_at[long] = np.arange(len(long))
        return LogRows(base, jump, voted, dense_at, log(np.array(rows).reshape(-1, len(self.classes))))

    def log_prior(self) -> np.ndarray:
        return np.log(self.prior + LOG_FLOOR)


# --- passes --------------------------------------------------------------------------


@dataclass(frozen=True)
class VoteCounts:
    """Numbers of items, of votes per cell, and of patterns per cell."""

    items: int
    votes: np.ndarray
    patterns: np.ndarray

    @staticmethod
    def of(patterns: DataFrame, n_cells: int) -> VoteCounts:
        marked = patterns.select("n", F.explode(F.concat("cells", F.array(F.lit(_ALL)))).alias("cell"))
        found = marked.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
        out = VoteCounts(next((r.n for r in found if r.cell == _ALL), 0), np.zeros(n_cells), np.zeros(n_cells, np.int64))
        for r in found:
            if r.cell != _ALL:
                out.votes[r.cell], out.patterns[r.cell] = r.n, r.k
        return out


def start(lfs: LabelingSet, classes: tuple[int, ...], votes_per_cell: np.ndarray, options: Options) -> DawidSkeneModel:
    """Starting point from vote counts alone."""
    k = len(classes)
    cell_map = CellMap(lfs, classes)
    voted = np.array([-1 if f.class_idx is ANY_CLASS else cell_map.place(f.class_idx) for f in lfs.functions], np.int64)
    base = default_confusions(voted, k)
    cells = cell_map.cells()
    owner, voted_for = (np.array(x, np.int64) for x in (list(zip(*cells)) or ([], [])))
    per_class = np.bincount(voted_for, votes_per_cell, k)
    n_votes = np.bincount(owner, votes_per_cell, len(lfs))

    total = per_class.sum()
    if total:
        prior = (per_class + options.prior_strength) / (total + options.prior_strength * k)
    else:
        prior = np.full(k, 1 / k)
    prior = np.maximum(prior, options.min_class_support / k)
    prior = prior / prior.sum()

    # how far a function's votes are from the prior: over its own cells, then all other classes
    expected = prior[voted_for] * n_votes[owner]
    apart = np.bincount(owner, np.abs(votes_per_cell - expected) - expected, len(lfs)) + n_votes
    gap = apart / (2 * np.maximum(n_votes, 1))
    accuracy = np.clip(1.0 - gap, *ACCURACY_RANGE)
    enough = (n_votes >= MIN_VOTES_FOR_ACCURACY).astype(float)
    own = Confusions.symmetric(voted, accuracy, k)
    confusions = own.each(lambda x, y, e: np.where(e > 0, x, y), base, per_function=enough)
    smoothing = options.confusion_smoothing / 10
    confusions = confusions.each(lambda x: (x + smoothing) / (1 + smoothing * k)).rows_to_one()
    return DawidSkeneModel(lfs, classes, prior, confusions, options)


@dataclass
class SoftCounts:
    """Sums of one pass: mass per class, items a class is best for, the likelihood, and per cell
    the mass (only where matrices are full) and the patterns in which a class has none at all."""

    class_mass: np.ndarray
    best: np.ndarray
    log_likelihood: float
    mass: dict[int, np.ndarray]
    none: dict[tuple[int, int], int]

    @staticmethod
    def over(blocks: Iterator[Patterns], rows: LogRows, log_prior: np.ndarray) -> SoftCounts:
        k = len(log_prior)
        out = SoftCounts(np.zeros(k), np.zeros(k), 0.0, {}, {})
        for part in blocks:
            logits = rows.logits(part, log_prior)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            out.log_likelihood += float((part.n * np.log(p.max(axis=1) + LIKELIHOOD_FLOOR)).sum())
            out.best += np.bincount(p.argmax(axis=1), weights=part.n, minlength=k)
            pattern = part.pattern()
            if not p.all():
                out._count_none(p, part.cells, pattern, k)
            p *= part.n[:, None]
            out.class_mass += p.sum(axis=0)
            for cell, total in rows.dense_sums(part.cells, pattern, p):
                out.mass[cell] = out.mass.get(cell, 0) + total
        return out

    def _count_none(self, p: np.ndarray, cells: np.ndarray, pattern: np.ndarray, k: int) -> None:
        for at in range(0, len(cells), 1 << 12):
            one, c = np.nonzero(p[pattern[at : at + (1 << 12)]] == 0)
            key, times = np.unique(cells[at : at + (1 << 12)][one].astype(np.int64) * k + c, return_counts=True)
            for x, t in zip(key.tolist(), times.tolist()):
                self.none[divmod(x, k)] = self.none.get(divmod(x, k), 0) + t

    def as_rows(self) -> pa.RecordBatch:
        """(part, i, j, value) of all numbers that are not zero."""
        parts, i, j, value = [], [], [], []

        def told(part: str, at: int, row: np.ndarray) -> None:
            hit = np.flatnonzero(row)
            parts.extend([part] * len(hit))
            i.append(np.full(len(hit), at))
            j.append(hit)
            value.append(row[hit])

        told("class_mass", 0, self.class_mass)
        told("best", 0, self.best)
        told("log_likelihood", 0, np.array([self.log_likelihood]))
        for cell, row in self.mass.items():
            told("mass", cell, row)
        for (cell, c), times in self.none.items():
            parts.append("none")
            i.append([cell])
            j.append([c])
            value.append([float(times)])
        columns = [pa.array(np.concatenate(x or [[]]), t) for x, t in ((i, pa.int32()), (j, pa.int32()), (value, pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *columns], ["part", "i", "j", "value"])

    @staticmethod
    def of_rows(sums: DataFrame, k: int) -> SoftCounts:
        """As many numbers as the parameters have, whatever the number of patterns."""
        out = SoftCounts(np.zeros(k), np.zeros(k), 0.0, {}, {})
        for r in sums.collect():
            if r.part == "log_likelihood":
                out.log_likelihood = r.value
            elif r.part == "none":
                out.none[r.i, r.j] = int(r.value)
            elif r.part == "mass":
                out.mass.setdefault(r.i, np.zeros(k))[r.j] = r.value
            else:
                getattr(out, r.part)[r.j] = r.value
        return out


SUMS = "part string, i int, j int, value double"


def soft_counts(patterns: DataFrame, model: DawidSkeneModel) -> SoftCounts:
    """One pass over all patterns: tasks add up their own, a shuffle joins the sums."""
    shared = patterns.sparkSession.sparkContext.broadcast((model.log_rows(), model.log_prior()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, log_prior = shared.value
        yield SoftCounts.over(Patterns.blocks(batches, len(log_prior)), rows, log_prior).as_rows()

    sums = patterns.select("cells", "n").mapInArrow(partial, SUMS)
    out = SoftCounts.of_rows(sums.groupBy("part", "i", "j").agg(F.sum("value").alias("value")), len(model.classes))
    shared.destroy()
    return out


def update(model: DawidSkeneModel, sums: SoftCounts, counts: VoteCounts) -> DawidSkeneModel:
    """New parameters from the soft counts of one pass."""
    opt, k, cm = model.options, len(model.classes), model.confusions
    support = np.maximum(sums.class_mass, opt.min_class_support * counts.items)
    prior = (support + opt.prior_strength) / (counts.items + opt.prior_strength * k)

    cells = model.cell_map().cells()
    owner = np.array([lf for lf, _ in cells], np.int64)
    n_votes = np.bincount(owner, counts.votes, len(model.lfs))
    # one class voted: its share of a row is 1 wherever it has mass, whatever the mass
    place = cm.place()
    hit = np.zeros(cm.column.shape, bool)
    full = np.zeros(cm.full.shape)
    single = cm.is_single[owner]
    hit[place[owner[single]]] = (counts.patterns[single] > 0)[:, None]
    for (cell, c), times in sums.none.items():
        if single[cell] and times == counts.patterns[cell]:
            hit[place[owner[cell]], c] = False
    for cell, row in sums.mass.items():
        if not single[cell]:
            full[place[owner[cell]], :, cells[cell][1]] = row
    column = hit.astype(float)
    fresh = Confusions(cm.voted, column, np.where(cm.at_voted, column, 0.0), np.zeros_like(column), full).rows_to_one()

    base = default_confusions(cm.voted, k)
    weight = np.minimum(MAX_DATA_WEIGHT, n_votes / (100 * k))
    mixed = cm.each(lambda x, y, z, w: w * y + (1 - w - GLOBAL_WEIGHT) * x + GLOBAL_WEIGHT * z, fresh, base, per_function=weight)
    mixed = mixed.each(lambda x: (x + opt.confusion_smoothing) / (1 + opt.confusion_smoothing * k)).rows_to_one()
    mixed = mixed.each(lambda x: np.clip(x, CELL_FLOOR, 1 - CELL_FLOOR)).rows_to_one()
    voting = (n_votes > 0).astype(float)
    return replace(model, prior=prior, confusions=mixed.each(lambda x, y, v: np.where(v > 0, x, y), base, per_function=voting))


def passes(model: DawidSkeneModel, counts: VoteCounts, one_pass: Callable[[DawidSkeneModel], SoftCounts]) -> DawidSkeneModel:
    """EM until the log-likelihood settles (after the sixth pass), or ``max_iter`` passes."""
    previous = -np.inf
    for i in range(model.options.max_iter if counts.items else 0):
        sums = one_pass(model)
        model = replace(update(model, sums, counts), n_iter=i + 1, log_likelihood=sums.log_likelihood)
        varied = np.count_nonzero(sums.best) >= 0.1 * len(model.classes)
        if i > 5 and varied and abs(sums.log_likelihood - previous) < model.options.tol:
            break
        previous = sums.log_likelihood
    return model


def all_passes(patterns: DataFrame, model: DawidSkeneModel, counts: VoteCounts) -> DawidSkeneModel:
    """All passes in the one task that holds the patterns."""
    k = len(model.classes)

    def run(table: pa.Table) -> pa.Table:
        parts = list(Patterns.blocks(table.select(["cells", "n"]).to_batches(), k))
        found = passes(model, counts, lambda m: SoftCounts.over(iter(parts), m.log_rows(), m.log_prior()))
        cm = found.confusions
        numbers = (found.prior, cm.column, cm.diagonal, cm.rest, cm.full, found.n_iter, found.log_likelihood)
        return pa.table({"numbers": pa.array([pickle.dumps(numbers)], pa.binary())})

    whole = patterns.select("cells", "n", F.lit(0).alias("one")).groupBy("one")
    prior, column, diagonal, rest, full, n_iter, likelihood = pickle.loads(whole.applyInArrow(run, "numbers binary").first()[0])
    confusions = Confusions(model.confusions.voted, column, diagonal, rest, full)
    return replace(model, prior=prior, confusions=confusions, n_iter=n_iter, log_likelihood=likelihood)


def voted_classes(ballots: DataFrame) -> tuple[int, ...]:
    rows = ballots.select(F.explode("votes.c").alias("c")).distinct().collect()
    return tuple(sorted(r.c for r in rows))


def fit(
    ballots: DataFrame, lfs: LabelingSet, classes: list[int] | None = None, options: Options = Options()
) -> DawidSkeneModel:
    """The parameters after EM over the ballots."""
    universe = tuple(classes) if classes else voted_classes(ballots)
    if classes:
        stray = set(f.class_idx for f in lfs.functions if f.class_idx not in (None, -1)) - set(universe)
        if stray and set(voted_classes(ballots)) - set(universe):
            raise KeyError(f"votes for classes outside the class list: {sorted(stray)}")
    if len(universe) < 2:
        raise ValueError("Dawid-Skene needs at least two classes")
    cell_map = CellMap(lfs, universe)
    n_cells = len(cell_map.cells())
    with scratch_table(cell_patterns(ballots, cell_map), "patterns") as patterns:
        counts = VoteCounts.of(patterns, n_cells)
        model = start(lfs, universe, counts.votes, options)
        if not counts.items or not options.max_iter:
            return model
        if counts.patterns.sum() <= ENTRIES_PER_TASK:
            return all_passes(patterns, model, counts)
        return passes(model, counts, lambda m: soft_counts(patterns, m))


def predict_proba(ballots: DataFrame, model: DawidSkeneModel, lfs: LabelingSet | None = None) -> DataFrame:
    """Add ``proba``; an item without votes gets the prior."""
    cells = model.cell_map(lfs).of(F.col("votes"))
    return ballots.withColumn("proba", posterior(cells, model.log_prior(), model.log_rows(lfs)))


def predict(ballots: DataFrame, model: DawidSkeneModel, lfs: LabelingSet | None = None) -> DataFrame:
    """Add ``proba`` and ``pred``, the first most probable class."""
    scored = predict_proba(ballots, model, lfs)
    classes = constant(list(model.classes), "array<int>")
    return scored.withColumn("pred", F.get(classes, first_argmax(F.col("proba"))))


def annotator_quality(confusion: DataFrame, n_classes: int) -> DataFrame:
    """Mean diagonal, scaled entropy and strong diagonal entries per function, best first."""
    diagonal = F.col("true_idx") == F.col("pred_idx")
    return (
        confusion.groupBy("criterion")
        .agg(
            F.avg(F.when(diagonal, F.col("p"))).alias("accuracy"),
            (-F.sum(F.col("p") * F.log(F.col("p") + LOG_FLOOR)) / (n_classes * n_classes)).alias("entropy"),
            F.count_if(diagonal & (F.col("p") > 0.5)).alias("n_diagonal_strong"),
        )
        .orderBy(F.desc("accuracy"), "criterion")
    )
