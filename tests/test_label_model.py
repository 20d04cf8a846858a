"""The label model on sparse co-occurrence: pairs, gradient, blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import co_occurrence, label_model
from labelloom.operators.label_model import Descent, LabelModelOptions
from labelloom.operators.labeling import LabelingFunction, LabelingSet
from labelloom.operators.posterior import annotators

VOTED = "item_id long, votes array<struct<lf:int,c:int>>"


def ballots_of(spark, rows):
    """Ballots of a vote matrix, -1 for abstain."""
    return spark.createDataFrame([(i, [(j, c) for j, c in enumerate(r) if c >= 0]) for i, r in enumerate(rows)], VOTED)


def dense(pairs, n):
    out = np.zeros((n, n))
    for r in pairs.collect():
        assert r.a <= r.b and not out[r.a, r.b]
        out[r.a, r.b] = out[r.b, r.a] = r.n
    return out


@pytest.mark.parametrize("heavy, pairs, kept", [(1024, 1 << 20, 1 << 21), (0, 5, 8), (3, 7, 10), (6, 1, 1)])
def test_pairs_by_heavy_and_light_cells(spark, monkeypatch, heavy, pairs, kept):
    for name, value in (("HEAVY", heavy), ("PAIRS", pairs), ("KEPT", kept), ("BLOCK_NUMBERS", 20)):
        monkeypatch.setattr(co_occurrence, name, value)
    rng = np.random.default_rng(heavy)
    fired = rng.random((40, 12)) < np.linspace(0.9, 0.05, 12)
    n = rng.integers(1, 9, 40)
    rows = [([j for j in range(12) if f[j]], int(k)) for f, k in zip(fired, n)]
    patterns = spark.createDataFrame([*rows, ([], 5)], "cells array<int>, n long").repartition(3)
    found = dense(co_occurrence.co_occurrence(patterns), 12)
    assert (found == fired.T.astype(float) @ (fired * n[:, None])).all()


def plain_descend(rates, cells, p, options):
    """The descent with the whole matrix of gaps, as the objective is written down."""
    owner = np.array([lf for lf, _ in cells])
    apart = (owner[:, None] != owner[None, :]).astype(float)
    anchor = np.zeros((len(cells), len(p)))
    for i, (_, c) in enumerate(cells):
        anchor[i, c] = np.clip(rates[i, i] * 0.7 / p[c], 0, 1)
    mu, first, second = anchor * options.start_scale, 0.0, 0.0
    for step in range(1, options.epochs + 1):
        gap = apart * (rates - (mu * p) @ mu.T)
        gradient = -4 * gap @ (mu * p) + 2 * (mu @ p - np.diag(rates))[:, None] * p + 2 * options.l2**2 * (mu - anchor)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        mu = mu - options.learning_rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return mu


@pytest.mark.parametrize("general", [False, True])
def test_sparse_gradient_equals_the_dense_one(general):
    rng = np.random.default_rng(8)
    cells = [(j, c) for j in range(6) for c in range(3)] if general else [(j, j % 3) for j in range(10)]
    fired = rng.random((50, len(cells))) < 0.3
    rates, p = fired.T.astype(float) @ fired / 50, np.array([0.2, 0.5, 0.3])
    options = LabelModelOptions(epochs=200, start_scale=0.6, l2=0.5)
    assert np.allclose(label_model.descend(rates, cells, p, options), plain_descend(rates, cells, p, options), atol=1e-12)


@pytest.mark.parametrize("general", [False, True])
def test_blocks_give_the_same_model(spark, monkeypatch, general):
    """All epochs in one task, or an epoch as a job over blocks of rows."""
    rng = np.random.default_rng(5)
    if general:
        lfs, rows = annotators([f"a{j}" for j in range(5)]), rng.integers(-1, 3, (60, 5)).tolist()
    else:
        lfs = LabelingSet(tuple(LabelingFunction(j, f"f{j}", None, j % 3) for j in range(9)))
        # the last function never votes
        rows = [[j % 3 if j < 8 and rng.random() < 0.4 else -1 for j in range(9)] for _ in range(60)]
    table, options = ballots_of(spark, rows), LabelModelOptions(epochs=12, start_scale=0.5)
    one = label_model.fit(table, lfs, 3, options=options)
    monkeypatch.setattr(label_model, "BLOCK_NUMBERS", 2 * len(one.mu))
    many = label_model.fit(table, lfs, 3, options=options)
    assert np.allclose(one.mu, many.mu, atol=1e-14)
    lone = label_model.fit(ballots_of(spark, [[0], [-1], [0]]), annotators(["x"]), 2, options=options)
    assert lone.mu.shape == (2, 2) and np.isfinite(lone.mu).all()
    with pytest.raises(ValueError):
        label_model.fit(table.limit(0), lfs, 3)


def test_six_thousand_functions(spark):
    """No cells x cells matrix on the driver or in a task: several blocks, and only pairs that meet."""
    m, n_classes = 6_000, 4
    lfs = LabelingSet(tuple(LabelingFunction(j, f"f{j}", None, j % n_classes) for j in range(m)))
    items = spark.range(3_000).select(
        F.col("id").alias("item_id"),
        F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(m // n_classes))))).alias("s"),
    )
    votes = F.transform("s", lambda x: F.struct((x * n_classes + F.pmod("item_id", F.lit(n_classes))).cast("int").alias("lf"), F.pmod("item_id", F.lit(n_classes)).cast("int").alias("c")))
    table = items.select("item_id", votes.alias("votes"))
    descent = LabelModelOptions(epochs=3, start_scale=0.5)
    model = label_model.fit(table, lfs, n_classes, options=descent)
    assert model.mu.shape == (m, n_classes) and label_model.rows_per_block(m) < m
    patterns = label_model.cell_patterns(table, label_model.CellMap(lfs, tuple(range(n_classes))))
    pairs = co_occurrence.co_occurrence(patterns)
    assert 150_000 < pairs.count() < 300_000
    exact = np.zeros((m, m))
    for r in table.collect():
        own = [v.lf for v in r.votes]
        exact[np.ix_(own, own)] += 1
    cells = [(j, j % n_classes) for j in range(m)]
    start = Descent.start(np.diag(exact) / 3_000, cells, model.balance, descent)
    np.fill_diagonal(exact, 0)
    for _ in range(3):
        start.move(exact / 3_000 @ start.weighted())
    floor = min(0.01, 1 / 10**4)
    assert np.allclose(model.mu, label_model.align_columns(np.clip(start.mu, floor, 1 - floor), cells, model.balance))
