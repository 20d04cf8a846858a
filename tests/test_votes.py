import math

import numpy as np
import pytest
from brute import em_pass, macro, majority, posterior, share, vote_table
from pyspark.sql import functions as F

from labelloom.operators import analysis, dawid_skene, label_model, metrics
from labelloom.operators import majority as mv
from labelloom.operators.labeling import LabelingFunction, LabelingSet
from labelloom.operators.posterior import annotators
from labelloom.sizing import local_frame


def one_class_functions(own):
    return LabelingSet(tuple(LabelingFunction(j, f"lf{j}", None, c) for j, c in enumerate(own)))


def ballots_of(spark, rows, label=None):
    data = [
        (i, [(j, v) for j, v in enumerate(row) if v != -1], None if label is None else label[i])
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, "item_id bigint, votes array<struct<lf:int,c:int>>, label_idx int")


def column(df, name):
    return [r[name] for r in df.orderBy("item_id").collect()]


@pytest.mark.parametrize("ties", ["prior", "first"])
@pytest.mark.parametrize("weights", [None, {"lf0": 2.0, "lf2": 0.5}])
def test_majority_against_brute_force(spark, ties, weights):
    rows, own = vote_table(80, 6, 4, seed=3, density=0.35)
    rows[0] = [-1] * 6
    lfs = one_class_functions(own)
    table = ballots_of(spark, rows)
    model = mv.fit_majority(table, lfs, weights)
    classes = sorted({v for r in rows for v in r} - {-1})
    assert list(model.classes) == classes
    assert model.prior == pytest.approx(share(rows, classes))
    w = [(weights or {}).get(f"lf{j}", 1.0) for j in range(6)]
    got = column(mv.predict_hard(table, lfs, model, ties), "pred")
    assert got == majority(rows, classes, model.prior, w, ties)


def test_majority_probabilities(spark):
    rows = [[0, 0, 1], [-1, -1, -1], [1, -1, 1], [0, 1, -1]]
    table, lfs = ballots_of(spark, rows), annotators(["x", "y", "z"])
    model = mv.fit_majority(table, lfs)
    proba = column(mv.predict_proba(table, lfs, model), "proba")
    assert proba[0] == pytest.approx([2 / 3, 1 / 3])
    assert proba[1] == pytest.approx(list(model.prior))
    assert all(sum(p) == pytest.approx(1) for p in proba)
    soft = column(mv.predict_soft(table, lfs, model), "pred")
    hard = column(mv.predict_hard(table, lfs, model, "first"), "pred")
    assert soft[0] == hard[0] == 0 and soft[2] == hard[2] == 1 and soft[3] == 0


def test_unknown_functions_are_ignored_and_unknown_classes_raise(spark):
    train, lfs = ballots_of(spark, [[0, 1], [0, -1]]), annotators(["x", "y"])
    model = mv.fit_majority(train, lfs)
    more = annotators(["x", "y", "stranger"])
    pred = mv.predict_hard(ballots_of(spark, [[-1, 1, 0]]), more, model, "prior")
    assert column(pred, "pred") == [1]
    with pytest.raises(Exception, match="unknown to the majority model"):
        mv.predict_hard(ballots_of(spark, [[5, -1]]), lfs, model, "prior").collect()
    with pytest.raises(ValueError):
        mv.fit_majority(ballots_of(spark, [[-1, -1]]), lfs)
    uniform = mv.fit_majority(ballots_of(spark, [[-1, -1]]), lfs, classes=[0, 1])
    assert uniform.prior == (0.5, 0.5)


def test_majority_does_not_depend_on_order_or_partitions(spark):
    rows, own = vote_table(60, 5, 3, seed=9)
    lfs = one_class_functions(own)
    table = ballots_of(spark, rows)
    model = mv.fit_majority(table, lfs)
    first = column(mv.predict_hard(table, lfs, model, "random", seed=4), "pred")
    again = column(mv.predict_hard(table.repartition(7), lfs, model, "random", seed=4), "pred")
    assert first == again
    back = table.withColumn("votes", F.reverse("votes"))
    assert column(mv.predict_hard(back, lfs, model, "prior"), "pred") == column(
        mv.predict_hard(table, lfs, model, "prior"), "pred"
    )


def test_diagnostics(spark):
    rows = [[0, 0, -1], [0, 1, -1], [-1, -1, -1], [1, 1, 0], [-1, 1, -1]]
    table, lfs = ballots_of(spark, rows), annotators(["x", "y", "z"])
    model = mv.fit_majority(table, lfs, {"x": 2.0})
    got = analysis.consensus_metrics(table, lfs, mv.fit_majority(table, lfs)).first()
    assert (got.total_objects, got.objects_with_consensus) == (5, 3)
    assert got.consensus_rate == pytest.approx(0.6) and got.total_agreement_rate == pytest.approx(3 / 8)
    stats = {(r.criterion, r.class_idx): r for r in analysis.annotator_stats(table, lfs, model).collect()}
    assert stats["x", 0].n_annotations == 5 and stats["x", 0].n_valid == 3 and stats["x", 0].weight == 2.0
    assert stats["x", 0].class_count == 2 and stats["x", 1].class_prop == pytest.approx(1 / 3)
    assert stats["z", 1].class_count == 0 and stats["z", 0].missing_rate == pytest.approx(0.8)
    empty = table.limit(0)
    assert analysis.consensus_metrics(empty, lfs, model).first().consensus_rate == 0
    assert analysis.annotator_stats(empty, lfs, model).first().missing_rate == 0


PAIRS = [(0, 0), (0, 0), (0, 1), (1, 1), (1, -1), (2, 0), (2, 3)]


def test_macro_scores_over_all_classes_seen(spark):
    table = spark.createDataFrame(PAIRS, "label_idx int, pred int")
    got = metrics.macro_metrics(table).first().asDict()
    # class 3 is predicted but never true, 2 is true but never predicted, -1 is an abstain
    assert got == pytest.approx(macro(PAIRS))
    # by hand: precision (2/3 + 1/2 + 0 + 0 + 0) / 5, recall (2/3 + 1/2) / 5
    assert got["precision"] == pytest.approx(7 / 30) and got["recall"] == pytest.approx(7 / 30)
    assert got["acc"] == pytest.approx(3 / 7)
    kept = [p for p in PAIRS if p[1] != -1]
    assert metrics.macro_metrics(table, ignore_abstain=True).first().asDict() == pytest.approx(macro(kept))


def test_run_summary_uses_population_deviation(spark):
    runs = spark.createDataFrame(
        [(0, 0.5, 0.4, 0.3, 0.2), (1, 0.7, 0.4, 0.5, 0.8)],
        "run int, f1 double, precision double, recall double, acc double",
    )
    got = {r.metric: r for r in metrics.run_summary(runs).collect()}
    assert got["f1"]["mean"] == pytest.approx(0.6) and got["f1"]["std"] == pytest.approx(0.1)
    assert [x.value for x in got["acc"].runs] == [0.2, 0.8]


def test_errors_and_confident_rows(spark):
    table = spark.createDataFrame([(0, 1, 1), (1, 1, -1), (2, 0, 1)], "item_id bigint, label_idx int, pred int")
    assert column(analysis.split_errors(table), "outcome") == ["correct", "wrong", "wrong"]
    proba = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.2, 0.8])], "item_id bigint, proba array<double>")
    got = analysis.confident(proba, 0.5).collect()
    assert [(r.item_id, r.weak_label) for r in got] == [(1, 1)]


@pytest.mark.parametrize("orientation", ["reference", "standard"])
@pytest.mark.parametrize("unipolar", [True, False])
def test_dawid_skene_against_brute_force(spark, orientation, unipolar):
    rows, own = vote_table(120, 5, 3, seed=11, density=0.6, unipolar=unipolar)
    rows = [r[:4] + [-1] for r in rows]  # the last one never votes
    rows[0] = [-1] * 5
    lfs = one_class_functions(own) if unipolar else annotators([f"lf{j}" for j in range(5)])
    table = ballots_of(spark, rows)
    # weak smoothing, so that confusion matrices become unsymmetric and orientation matters
    options = dawid_skene.Options(max_iter=0, orientation=orientation, confusion_smoothing=0.5)
    model = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=options)
    transposed = orientation == "reference"
    prior, confusion = model.prior.tolist(), model.confusion.tolist()
    for n in (1, 2, 3):
        post, prior, confusion, likelihood = em_pass(rows, prior, confusion, transposed, cs=0.5)
        now = dawid_skene.fit(table, lfs, classes=[0, 1, 2], options=dawid_skene.replace(options, max_iter=n))
        assert now.prior == pytest.approx(np.array(prior), rel=1e-9)
        assert now.confusion == pytest.approx(np.array(confusion), rel=1e-9)
        assert now.log_likelihood == pytest.approx(likelihood)
    scored = dawid_skene.predict(table, now)
    for row, p, best in zip(rows, column(scored, "proba"), column(scored, "pred")):
        want = posterior(row, prior, confusion, transposed)
        assert p == pytest.approx(want) and sum(p) == pytest.approx(1)
        assert best == int(np.argmax(want))
    assert column(scored, "pred")[0] == int(np.argmax(prior))


def test_dawid_skene_start_and_guards(spark):
    rows = [[0, -1]] * 3 + [[0, 1]] * 5
    table, lfs = ballots_of(spark, rows), annotators(["x", "y"])
    model = dawid_skene.fit(table, lfs, options=dawid_skene.Options(max_iter=0))
    assert model.prior == pytest.approx([(8 + 50) / (13 + 100), (5 + 50) / (13 + 100)])
    agreement = 1 - sum(abs(a - p * 8) for a, p in zip((8, 0), model.prior)) / 16
    diagonal = (min(max(agreement, 0.3), 0.9) + 2) / 5
    assert model.confusion[0] == pytest.approx(np.array([[diagonal, 1 - diagonal], [1 - diagonal, diagonal]]))
    few = dawid_skene.fit(ballots_of(spark, rows[:4]), lfs, options=dawid_skene.Options(max_iter=0))
    assert few.confusion[0][0][0] == pytest.approx((0.7 + 2) / 5)
    with pytest.raises(ValueError):
        dawid_skene.fit(ballots_of(spark, [[0, 0]]), lfs)
    none = dawid_skene.fit(ballots_of(spark, [[-1, -1]]), lfs, classes=[0, 1])
    assert none.prior.sum() == pytest.approx(1)
    full = dawid_skene.fit(table, lfs)
    assert 1 <= full.n_iter <= 30
    quality = dawid_skene.annotator_quality(full.confusion_frame(spark), 2).collect()
    diagonal = {r.criterion: r.accuracy for r in quality}
    assert diagonal["x"] == pytest.approx(np.diag(full.confusion[0]).mean())
    assert [r.accuracy for r in quality] == sorted((r.accuracy for r in quality), reverse=True)


def planted(n, accuracies, n_classes, seed):
    rng = np.random.default_rng(seed)
    truth = rng.integers(n_classes, size=n)
    rows, own = [], [j % n_classes for j in range(len(accuracies))]
    for y in truth:
        rows.append([c if rng.random() < (a if c == y else 0.08) else -1 for c, a in zip(own, accuracies)])
    return rows, own, truth.tolist()


def test_label_model_recovers_planted_truth(spark):
    rows, own, truth = planted(1500, [0.8, 0.7, 0.75, 0.6, 0.8, 0.7, 0.65, 0.8, 0.7], 3, seed=5)
    lfs, table = one_class_functions(own), ballots_of(spark, rows, truth)
    model = label_model.fit(table, lfs, 3)
    assert all(int(np.argmax(model.mu[j])) == c for j, c in enumerate(own))
    scored = label_model.predict(table, model)
    accuracy = np.mean([p == t for p, t in zip(column(scored, "pred"), truth)])
    coverage = np.mean([any(v != -1 for v in r) for r in rows])
    assert accuracy > 0.8 * coverage
    empty = [i for i, r in enumerate(rows) if all(v == -1 for v in r)]
    assert all(column(scored, "pred")[i] == -1 for i in empty)
    assert model.mu_frame(spark).count() == len(own) * 3


def test_label_model_probabilities_and_ties(spark):
    lfs = one_class_functions([0, 1])
    model = label_model.LabelModel(lfs, 2, np.array([[0.6, 0.1], [0.1, 0.6]]), np.array([0.5, 0.5]))
    table = ballots_of(spark, [[0, -1], [0, 1], [-1, -1], [-1, 1]])
    scored = label_model.predict(table, model)
    assert column(scored, "pred") == [0, -1, -1, 1]
    assert column(scored, "proba")[0] == pytest.approx([6 / 7, 1 / 7])


def test_moments_count_every_pair_once(spark):
    rows, own = vote_table(50, 4, 2, seed=2)
    lfs = one_class_functions(own)
    got = {(r.criterion_a, r.criterion_b): (r.n_both, r.rate) for r in label_model.moments(ballots_of(spark, rows), lfs).collect()}
    for a in range(4):
        for b in range(a, 4):
            n = sum(r[a] != -1 and r[b] != -1 for r in rows)
            assert got.get((f"lf{a}", f"lf{b}"), (0, 0.0)) == (n, pytest.approx(n / 50))


def test_best_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6):
        for _ in range(10):
            gain = rng.random((n, n)) if n > 2 else rng.integers(0, 3, (n, n)).astype(float)
            got = label_model.best_assignment(gain)
            assert sorted(got) == list(range(n))
            best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sum(gain[i, got[i]] for i in range(n)) == pytest.approx(best)


def test_gradient_matches_the_objective():
    rng = np.random.default_rng(3)
    cells, p = [(0, 0), (1, 1), (2, 0)], np.array([0.5, 0.5])
    rates = rng.random((3, 3)) / 3
    rates = (rates + rates.T) / 2
    anchor = np.zeros((3, 2))
    for i, (_, c) in enumerate(cells):
        anchor[i, c] = min(rates[i, i] * 0.7 / p[c], 1)

    def loss(mu, l2):
        gap = rates - mu @ np.diag(p) @ mu.T
        np.fill_diagonal(gap, 0)
        return (gap**2).sum() + ((mu @ p - np.diag(rates)) ** 2).sum() + l2**2 * ((mu - anchor) ** 2).sum()

    options = label_model.LabelModelOptions(epochs=4000, l2=0.1, start_scale=0.9)
    mu = label_model.descend(rates, cells, p, options)
    base = loss(mu, 0.1)
    assert math.isfinite(base) and base < loss(anchor * 0.9, 0.1)
    for i in range(3):
        for y in range(2):
            for step in (-1e-3, 1e-3):
                moved = mu.copy()
                moved[i, y] += step
                assert loss(moved, 0.1) >= base - 1e-8


def test_prior_frame(spark):
    frame = mv.MajorityModel((0, 2), (0.25, 0.75)).prior_frame(spark)
    assert frame.collect() == local_frame(spark, [(0, 0.25), (2, 0.75)], "class_idx int, prior double").collect()
