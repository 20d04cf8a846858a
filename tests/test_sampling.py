import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions.text import seeded_order
from labelloom.operators import sampling
from labelloom.operators.classes import (
    class_list,
    decode_labels,
    encode_labels,
    project_validation_labels,
    require_class_count,
    require_known_labels,
    split_class_counts,
)


def key(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def expected_sample(labels, size, seed):
    """Deal one row per class and cycle, in shuffled class order."""
    queues = {}
    for i in sorted(range(len(labels)), key=lambda i: key(seed, i)):
        queues.setdefault("NaN" if labels[i] is None else labels[i], []).append(i)
    chosen, cycle = set(), 0
    while len(chosen) < size and any(queues.values()):
        cycle += 1
        alive = [c for c in queues if queues[c]]
        for c in sorted(alive, key=lambda c: (hashlib.md5(f"{seed}|{cycle}|{c}".encode()).hexdigest(), c)):
            if len(chosen) < size:
                chosen.add(queues[c].pop(0))
    return chosen


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "item_id bigint, label string")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=40), st.integers(0, 45))
def test_balanced_split_deals_in_cycles(spark, labels, size):
    marked = sampling.balanced_split(labelled(spark, labels), "label", size, seed=3).collect()
    assert sorted(r.item_id for r in marked) == list(range(len(labels)))
    assert {r.item_id for r in marked if r.chosen} == expected_sample(labels, size, 3)


def test_a_hot_class_is_cut_exactly(spark, monkeypatch):
    # few rows are ranked together, as of a class of billions
    monkeypatch.setattr(sampling, "RANKED_ROWS", 1)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    labels = ["hot"] * 900 + ["b"] * 60 + ["c"] * 3
    marked = sampling.balanced_split(labelled(spark, labels), "label", 200, seed=1).filter("chosen").collect()
    assert {r.item_id for r in marked} == expected_sample(labels, 200, 1)


def test_repeated_ids_still_give_the_exact_size(spark):
    rows = [(i // 4, "a") for i in range(40)] + [(100 + i, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "item_id bigint, label string")
    for size in (10, 11, 12, 13):
        assert sampling.balanced_split(df, "label", size).filter("chosen").count() == size
    assert sampling.balanced_split(df, "label", 13).count() == 80


def test_rows_without_ids_and_equal_rows(spark, monkeypatch):
    """Missing ids are spread by content; of equal rows at the end of a sample the right number is taken."""
    rows = [(None, "a", str(k)) for k in range(60)] + [(7, "a", "same")] * 50 + [(k, "b", "x") for k in range(30)]
    df = spark.createDataFrame(rows, "item_id bigint, label string, text string").repartition(4)
    for ranked in (sampling.RANKED_ROWS, 1):
        monkeypatch.setattr(sampling, "RANKED_ROWS", ranked)
        for size in (57, 90, 140):
            marked = sampling.balanced_split(df, "label", size, seed=4)
            assert marked.columns == [*df.columns, "chosen"]
            assert marked.count() == 140 and marked.filter("chosen").count() == min(size, 140)
    assert sampling.balanced_split(df.limit(0), "label", 5).count() == 0


def test_marking_neither_sorts_nor_reads_what_it_does_not_need(spark, tmp_path):
    """Texts are read only where the rows are marked, and no class is brought together there."""
    rows = spark.range(3000).selectExpr("id AS item_id", "CAST(id % 3 AS STRING) AS label", "repeat('x', 50) AS text")
    rows.write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    counted = table.groupBy("label", sampling._bucket(seeded_order(1, F.col("item_id")), 0)).count()
    assert "text" not in counted._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    plan = sampling.balanced_split(table, "label", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_holdout_and_lowest(spark):
    df = labelled(spark, ["x"] * 101)
    held = sampling.holdout(df, 0.1, 42)
    assert held.filter("held_out").count() == 11 and held.count() == 101
    lowest = sampling.take_lowest(df, 7, seeded_order(5, F.col("item_id")), 101)
    want = set(sorted(range(101), key=lambda i: key(5, i))[:7])
    assert {r.item_id for r in lowest.collect()} == want
    assert sampling.take_lowest(df, 500, seeded_order(5, F.col("item_id")), 101).count() == 101


def test_split_preparation(spark):
    train, valid, test = (
        labelled(spark, ["a", "b"] * n).withColumn("item_id", F.col("item_id") + at)
        for n, at in ((10, 0), (5, 100), (4, 200))
    )
    splits = sampling.prepare_splits(train, valid, test, 6)
    counts = {r.split: (r.n_items, r.n_classes) for r in split_class_counts(splits).collect()}
    assert counts == {"dev": (6, 2), "train": (24, 2), "test": (8, 2)}
    assert splits.select("item_id").distinct().count() == 38
    require_class_count(splits, 2)
    with pytest.raises(ValueError):
        require_class_count(splits, 3)
    own = sampling.prepare_splits_from_valid(train, valid, test, 6)
    counts = {r.split: r.n_items for r in split_class_counts(own).collect()}
    assert counts == {"dev": 6, "train": 20, "test": 8}
    assert own.filter("split = 'dev' and item_id < 100").isEmpty()


def test_class_order_and_lookup(spark):
    assert class_list(labelled(spark, ["10", "2", None, "07", "x", "b", "2"])).names == ("2", "7", "10", "b", "x")
    classes = class_list(labelled(spark, ["1", "0"]))
    require_known_labels(labelled(spark, ["0", "01", None]), classes)
    with pytest.raises(KeyError):
        require_known_labels(labelled(spark, ["0", "5"]), classes)


def test_label_codes_round_trip(spark):
    df = labelled(spark, ["10", "9", "b", "9"])
    coded = encode_labels(df)
    assert {r.label: r.label_id for r in coded.collect()} == {"9": 0, "10": 1, "b": 2}
    back = decode_labels(coded.drop("label"), class_list(df))
    assert {(r.item_id, r.label) for r in back.collect()} == {(0, "10"), (1, "9"), (2, "b"), (3, "9")}


def test_validation_labels(spark):
    valid, train = labelled(spark, ["0", "1", "7"]), labelled(spark, ["0", "1"])
    got = {r.item_id: r.label for r in project_validation_labels(valid, train).collect()}
    assert got == {0: "0", 1: "1", 2: "1"}
    assert project_validation_labels(valid, train, mode="drop").count() == 2


def test_parts_numbered_alike_stay_apart(spark):
    def part(n):
        return spark.createDataFrame([(i, f"t{i}", str(i % 2)) for i in range(n)], "item_id long, text string, label string")

    splits = sampling.prepare_raw_splits(part(6), part(4), part(3), dev_size=4, n_classes=2)
    rows = splits.collect()
    assert len(rows) == 13 == len({r.item_id for r in rows})
    assert {(r.old_split, r.old_id) for r in rows} == {(s, i) for s, n in (("train", 6), ("valid", 4), ("test", 3)) for i in range(n)}
    sampling.require_unique_ids(splits)
    with pytest.raises(ValueError):
        sampling.require_unique_ids(part(3).unionByName(part(2)))
    with pytest.raises(ValueError):
        sampling.prepare_raw_splits(part(6), part(4), part(3), dev_size=4, n_classes=3)
