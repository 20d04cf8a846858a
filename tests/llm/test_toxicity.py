import zlib

import pytest

from labelloom.llm import toxicity


@pytest.fixture(scope="module")
def model(documents):
    return toxicity.CharModel({r.gram: r.n for r in toxicity.trigram_counts(documents).collect()})


@pytest.mark.parametrize(
    "spelled, plain",
    [("m0r0n", "moron"), ("st*pid", "stupid"), ("id1ot!!", "idiot"), ("looooser", "loser"), ("p@thetic", "pathetic"), ("s-c-u-m", "scum"), ("$tupid", "stupid")],
)
def test_disguises_are_undone(model, spelled, plain):
    assert plain in toxicity.readings(spelled, model)


def test_gaps_and_plain_words(model):
    assert "idiot" in toxicity.gapped("what an i d i o t he is", model)
    assert toxicity.gapped("a word or two", model) == []
    assert toxicity.readings("ordinary,", model) == ["ordinary"] and toxicity.readings("&&&", model) == []


@pytest.mark.parametrize(
    "text, plain",
    [
        ("an  i  d  i  o  t  he is", "idiot"), ("an i d-i o t he is", "idiot"), ("so\ns c u m\nhe is", "scum"), ('he said "s c u m"', "scum"),
        ("(s c u m)", "scum"), ("an i d 1 o t he is", "idiot"), ("an i.d. i.o.t he is", "idiot"), ("m 0 r 0 n", "moron"), ("s t * p i d", "stupid"),
    ],
)
def test_gaps_of_all_forms(model, text, plain):
    assert plain in toxicity.gapped(text, model)


def test_numbers_and_rules_are_no_words(model):
    assert toxicity.gapped("1 2 3 4 5 6 and " + "* " * 50_000 + "*" * 50_000 + "x", model) == []


def test_long_spellings_are_read_to_their_end(model):
    spelled = " ".join("you are without any doubt the most extraordinary idiot".replace(" ", ""))
    assert any(w.startswith("idiot") for w in toxicity.gapped(spelled, model))
    assert "loser" in toxicity.readings("l" + "o" * 60 + "ser", model)
    chain = "never_seen-such.a_big_and-really.very_annoying-m0r0n.or_st*pid"
    assert {"moron", "stupid"} <= {w[:k] for w in toxicity.readings(chain, model) for k in (5, 6)}
    assert len(model.restore("m0r0n" * 4000)) == 20_000


def test_held_out_labels_are_predicted(spark, small_tables):
    tables = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    known = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(p == t for p, t in known) / len(known) >= 0.9
    assert sum(p for p, t in known if not t) <= 0.03 * len(known)


def test_held_out_labels_are_not_used(spark):
    tables = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(tuple(r) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows_and_labels(spark, odd, empty):
    labels = spark.createDataFrame([(None, 1), (0, None), (3, 1), (3, 0), (999, 1), (4, 0), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score is not None for r in rows)
    assert toxicity.score_toxicity(empty, labels).collect() == []
    none = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_evidence_by_an_exact_test():
    """Tails are those of the hypergeometric distribution; the limit is that of the discrete false-discovery rule."""
    import math

    import numpy as np

    toxic, clean = 11, 72
    log_fact = np.append(0.0, np.cumsum(np.log(np.arange(1, toxic + clean + 1))))

    def tail(yes, n):
        ways = [math.comb(toxic, x) * math.comb(clean, n - x) for x in range(yes, min(n, toxic) + 1) if n - x <= clean]
        return sum(ways) / math.comb(toxic + clean, n), ways[-1] / math.comb(toxic + clean, n)

    for yes, no in ((5, 0), (3, 0), (4, 4), (1, 30), (11, 72), (2, 70)):
        assert np.allclose(toxicity.upper_tails(yes, yes + no, toxic, clean, log_fact), tail(yes, yes + no))
    pairs = [(5, 0, 11), (4, 0, 11), (3, 0, 12), (4, 4, 3), (2, 0, 400), (1, 0, 9000), (1, 5, 2000)]
    told = toxicity.telling_counts(pairs, toxic, clean, 0.05)
    kept = set()
    for limit in sorted(tail(y, y + n)[0] for y, n, _ in pairs):
        tested = sum(k for y, n, k in pairs if tail(y, y + n)[1] <= limit * (1 + 1e-9))
        found = [(y, n, k) for y, n, k in pairs if tail(y, y + n)[0] <= limit * (1 + 1e-9)]
        if limit * tested <= 0.05 * sum(k for _, _, k in found):
            kept = {(y, n) for y, n, _ in found}
    assert set(told) == kept and (5, 0) in kept and (1, 5) not in kept


def test_few_and_many_labels_teach(spark):
    """Ten toxic labels are enough, and no share of the toxic texts is asked for."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(7)) for _ in range(3000)]
    rows, labels = [], []
    for k in range(100):
        text = rng.choices(words, k=40)
        if k < 10:
            text[rng.randrange(40)] = ("zorkblat", "m0r0n", "moron")[k % 3] if k % 2 else "zorkblat"
        rows.append((k, " ".join(text)))
        labels.append((k, int(k < 10)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), folds=10**9, fold=1).collect()
    assert sum(r.predicted for r in found if r.doc_id < 10) >= 6 and sum(r.predicted for r in found if r.doc_id >= 10) == 0
    # one word in 14 of 2,000 toxic texts
    rare = [(k, "zorkblat" if k < 14 else f"quux{k % 2}" if k < 2000 else rng.choice(words)) for k in range(6000)]
    rare = [(k, f"{w} {rng.choice(words)} {rng.choice(words)}") for k, w in rare]
    frame = spark.createDataFrame(rare, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 2000)) for k in range(6000)], "doc_id long, toxic int")
    scorer = toxicity.fit(frame, marks)
    assert scorer.weights["zorkblat"] >= toxicity.LEAST_WEIGHT
