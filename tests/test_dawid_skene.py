"""Dawid-Skene on compact matrices: blocks, tasks, thousands of classes."""

import numpy as np
import pytest
from brute import em_pass, posterior, vote_table
from pyspark.sql import functions as F

from labelloom.operators import dawid_skene
from labelloom.operators import posterior as post
from labelloom.operators.dawid_skene import Confusions, Options, default_confusions
from labelloom.operators.labeling import LabelingFunction, LabelingSet
from labelloom.operators.posterior import LogRows, Patterns, annotators

VOTED = "item_id long, votes array<struct<lf:int,c:int>>"


def ballots_of(spark, rows):
    return spark.createDataFrame([(i, [(j, c) for j, c in enumerate(r) if c >= 0]) for i, r in enumerate(rows)], VOTED)


def functions(own):
    return LabelingSet(tuple(LabelingFunction(j, f"lf{j}", None, c) for j, c in enumerate(own)))


def test_compact_matrices_equal_full_ones():
    rng = np.random.default_rng(3)
    voted = np.array([2, -1, 0, 3, -1])
    accuracy = rng.random(5)
    compact = Confusions.symmetric(voted, accuracy, 4)
    for j in range(5):
        m = compact.matrix(j)
        assert np.allclose(m, accuracy[j] * np.eye(4) + (1 - accuracy[j]) / 3 * (1 - np.eye(4)))
    moved = compact.each(lambda x: x + 0.1)
    moved = Confusions(voted, moved.column * 3, np.where(moved.at_voted, moved.column * 3, moved.diagonal), moved.rest, moved.full)
    for j in range(5):
        m = moved.matrix(j)
        assert np.allclose(moved.rows_to_one().matrix(j), m / m.sum(axis=1, keepdims=True))
    assert np.allclose(default_confusions(voted, 4).matrix(1)[0], [0.7, 0.1, 0.1, 0.1])


@pytest.mark.parametrize("unipolar", [True, False])
def test_one_task_or_a_job_a_pass(spark, monkeypatch, unipolar):
    rows, own = vote_table(120, 5, 3, seed=11, density=0.6, unipolar=unipolar)
    lfs = functions(own) if unipolar else annotators([f"lf{j}" for j in range(5)])
    table, options = ballots_of(spark, rows).repartition(3), Options(max_iter=4, confusion_smoothing=0.5)
    one = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=options)
    monkeypatch.setattr(dawid_skene, "ENTRIES_PER_TASK", 0)
    many = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=options)
    assert np.allclose(one.confusion, many.confusion, rtol=1e-10) and np.allclose(one.prior, many.prior, rtol=1e-10)
    assert one.n_iter == many.n_iter == 4 and one.log_likelihood == pytest.approx(many.log_likelihood)


def test_classes_without_mass(spark):
    """Sixty functions that agree leave exactly no mass on other classes: their rows count as empty."""
    rows = [[0] * 60 + [-1] * 2] * 9 + [[-1] * 60 + [1, -1]] * 5 + [[-1] * 61 + [2]] * 5
    lfs = functions([0] * 60 + [1, 2])
    options = Options(max_iter=0, confusion_smoothing=0.0, min_class_support=0.0)
    table = ballots_of(spark, rows)
    model = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=options)
    prior, confusion = model.prior.tolist(), model.confusion.tolist()
    for n in range(1, 8):
        _, prior, confusion, likelihood = em_pass(rows, prior, confusion, True, cs=0.0, mcs=0.0)
        now = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=dawid_skene.replace(options, max_iter=n))
        assert np.allclose(now.confusion, confusion, rtol=1e-8) and now.log_likelihood == pytest.approx(likelihood)


@pytest.mark.parametrize("planned", [True, False])
def test_posteriors_in_the_plan_or_in_batches(spark, monkeypatch, planned):
    if not planned:
        monkeypatch.setattr(post, "PLANNED_NUMBERS", 0)
        monkeypatch.setattr(post, "BLOCK_NUMBERS", 7)
    rng = np.random.default_rng(2)
    prior, dense = rng.random(3), rng.random((2, 3))
    short = np.array([1.0, 0.0, 1.0, 0.0])
    rows = LogRows(rng.random(4) * short, rng.random(4) * short, np.array([0, 2, 1, 1]), np.array([-1, 0, -1, 1]), dense)
    lists = [[], [0], [1, 3], [0, 1, 2, 3], [2]]
    frame = spark.createDataFrame(list(enumerate(lists)), "i int, cells array<int>").coalesce(1)
    found = frame.select("i", post.posterior(F.col("cells"), prior, rows).alias("p")).collect()
    for r in found:
        x = prior + sum((rows.table()[c] for c in lists[r.i]), np.zeros(3))
        assert r.p == pytest.approx((np.exp(x) / np.exp(x).sum()).tolist())


@pytest.mark.parametrize("orientation", ["reference", "standard"])
def test_five_thousand_classes(spark, orientation):
    """No functions x classes x classes matrix, and no table in the plan."""
    k, m = 5_000, 400
    rng = np.random.default_rng(4)
    own = (np.arange(m) * 7 % k).tolist()
    rows = [sorted(rng.choice(m, 4, replace=False).tolist()) for _ in range(300)]
    rows += [[j] for j in range(0, m, 2)] * 3
    table = spark.createDataFrame([(i, [(j, own[j]) for j in r]) for i, r in enumerate(rows)], VOTED)
    options = Options(max_iter=2, orientation=orientation, confusion_smoothing=0.0)
    model = dawid_skene.fit(table, functions(own), classes=list(range(k)), options=options)
    assert model.confusions.column.shape == (m, k) and model.n_iter == 2
    for j in (0, 399):
        assert np.allclose(model.confusions.matrix(j).sum(axis=1), 1)
    scored = dawid_skene.predict(table.limit(40), model).select("votes", "proba", "pred").collect()
    cm = model.confusions
    for r in scored:
        x = model.log_prior()
        for v in r.votes:
            by_vote = np.where(np.arange(k) == v.c, cm.column[v.lf, v.c], cm.rest[v.lf, v.c])
            x = x + np.log((by_vote if orientation == "reference" else cm.column[v.lf]) + 1e-15)
        p = np.exp(x - x.max())
        assert np.allclose(r.proba, p / p.sum(), atol=1e-12) and x[r.pred] == pytest.approx(x.max())
    # one function's matrix as rows, from three numbers per true class
    few = model.confusion_frame(spark).filter("criterion = 'lf17' AND true_idx IN (119, 5)").collect()
    assert len(few) == 2 * k
    matrix = model.confusions.matrix(17)
    assert all(r.p == matrix[r.true_idx, r.pred_idx] for r in few)
