"""Keyword criteria looked up in an index of rare grams: the same verdicts as one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelloom.operators import labeling, rule_blocks, rule_index
from labelloom.operators.classes import ClassList
from labelloom.sizing import local_frame

CLASSES = ClassList(("0", "1", "2"))
ODD_RULES = [
    ("empty", "", "0"), ("only plus", "+", "1"), ("one letter", "a", "0"), ("blank", " ", "1"), ("two", "ab+", "2"),
    ("upper", "ABcde", "0"), ("five", "abcde", "1"), ("six", "abcdef", "2"), ("long", "abcdefghij abcdefghij", "0"),
    ("several", "abc+b+zzz", "1"), ("line", "a\nb", "2"), ("faces", "😀😃😄", "0"), ("more faces", "x😀😃😄😁😆😅y+é", "1"),
    ("dotted", "İstanbul", "2"), ("sigma", "ΟΔΟΣ+a", "0"), ("no description", None, "1"), ("unknown class", "a", "9"),
    ("quotes", "it's \"so\"", "0"), ("dollar", "a$1.*b(", "1"), ("repeated", "abc+abc+abc", "2"),
]
ODD_TEXTS = [
    None, "", " ", "a", "ab", "abcde", "ABCDEF", "xabcdefghij abcdefghijx", "zzz abc", "a\nb", "😀😃😄 here", "x😀😃😄😁😆😅y é",
    "İSTANBUL", "i̇stanbul", "ΟΔΟΣ", "οδος a", "it's \"so\" a$1.*b(", "abc " * 20_000,
]


def criteria_frame(spark, rows):
    return local_frame(spark, [(i, *r) for i, r in enumerate(rows)], "ord long, criterion string, description string, class string")


def both_ways(items, criteria):
    few, many = (labeling.keyword_votes_long(items, criteria, CLASSES, planned=p) for p in (10_000, 0))
    return [sorted(map(tuple, df.collect()), key=repr) for df in (few, many)]


def test_odd_rules_and_texts(spark):
    items = spark.createDataFrame([*enumerate(ODD_TEXTS), (3, "abcde"), (3, "abcde"), (None, "a"), (None, "zz")], "item_id long, text string")
    few, many = both_ways(items, criteria_frame(spark, ODD_RULES))
    assert few == many and len(few) > 60
    assert {c for i, c, _ in many if i == 1} == {"empty", "only plus"} and not any(i == 0 for i, _, _ in many)


def test_empty_tables(spark):
    items = spark.createDataFrame([(0, "a")], "item_id long, text string")
    rules = criteria_frame(spark, ODD_RULES)
    assert both_ways(items.limit(0), rules) == [[], []]
    assert labeling.keyword_votes_long(items, rules.limit(0), CLASSES, planned=-1).collect() == []


@pytest.mark.parametrize("bits", [rule_index.MAP_BITS, 17])
def test_random_rules(spark, monkeypatch, bits):
    """Rules of common and rare keywords; with a small map most grams seem wanted, and the join sorts them out."""
    monkeypatch.setattr(rule_index, "MAP_BITS", bits)
    monkeypatch.setattr(rule_index, "SLICE", 64)
    monkeypatch.setattr(rule_index, "KEPT", 50)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde ", k=rng.randint(1, 9))) for _ in range(300)]
    items = spark.createDataFrame([(k, " ".join(rng.choices(words, k=30))) for k in range(60)], "item_id long, text string")
    rules = [(f"r{k}", "+".join(rng.choices(words, k=rng.randint(1, 3))), str(k % 4)) for k in range(500)]
    few, many = both_ways(items, criteria_frame(spark, rules))
    assert few == many and len(few) > 500


def test_ballots_by_the_index(spark):
    criteria = criteria_frame(spark, ODD_RULES)
    lfs = labeling.labeling_set(criteria, CLASSES)
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)], "item_id long, text string, label string")
    few, many = (sorted(labeling.keyword_ballots(items, lfs, ("label",), planned=p).collect()) for p in (10_000, 0))
    assert few == many and few[0].fired == [] and few[3].votes


def test_literal_rules_and_a_table_of_them_agree(spark, monkeypatch):
    lfs = labeling.labeling_set(criteria_frame(spark, ODD_RULES), CLASSES)
    items = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "item_id long, text string")
    one = sorted(labeling.keyword_ballots(items, lfs).collect())
    monkeypatch.setattr(labeling, "LITERAL_CRITERIA", 0)
    assert sorted(labeling.keyword_ballots(items, lfs).collect()) == one


def test_a_hundred_thousand_rules(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(40)
    texts = {r.doc_id: r.text.lower() for r in docs.select("doc_id", "text").collect()}
    rng = random.Random(11)
    known = sorted({w for t in texts.values() for w in t.split()})
    made = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(50_000)]
    rules = [(f"r{k}", rng.choice(known) if k % 10 == 0 else "+".join(rng.choices(made, k=2)), str(k % 3)) for k in range(100_000)]
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    found = labeling.keyword_votes_long(items, criteria_frame(spark, rules), CLASSES)
    expected = {
        (i, name) for name, description, _ in rules for i, t in texts.items() if all(k in t for k in description.split("+"))
    }
    rows = found.collect()
    assert {(r.item_id, r.criterion) for r in rows} == expected and len(rows) == len(expected) > 10_000


def test_copies_for_salts_are_not_built_in_the_driver(spark, monkeypatch):
    """A table copied for its salts looks as small as its file; however small, it is merged."""
    plans = {}

    def seen(df, stem):
        plans[stem] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, stem)

    stored = rule_index.stored
    monkeypatch.setattr(rule_index, "stored", seen)
    items = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "item_id long, text string")
    assert labeling.keyword_votes_long(items, criteria_frame(spark, ODD_RULES), CLASSES, planned=0).count() > 0
    assert "Broadcast" not in plans["rule-index"] and plans["rule-index"].count("SortMergeJoin") == 2
    merged = [line for line in plans["rules-held"].splitlines() if "SortMergeJoin [gram" in line]
    assert len(merged) == 1


def test_grams_of_a_text(spark, small_tables):
    """All grams that are wanted leave a text, each once, without an exchange."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("t"))
    words = ["tion ", " the ", "nowhere"[:6], "é", ""]
    wanted = local_frame(spark, [(rule_index.numbered(w.encode()),) for w in words], "gram long")
    asked = rule_index.text_grams(docs, wanted)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan
    texts = {r.item_id: r.t for r in docs.collect()}
    exact = sorted((i, rule_index.numbered(w.encode())) for i, t in texts.items() for w in words if w in t)
    numbers = {rule_index.numbered(w.encode()) for w in words}
    assert sorted((r.item_id, r.gram) for r in asked.collect() if r.gram in numbers) == exact
    counts = {r.gram: r.n for r in rule_index.gram_frequency(docs, wanted).collect()}
    assert counts[0] == len(texts) and counts[rule_index.numbered(b" the ")] == sum(len(re.findall("(?= the )", t)) for t in texts.values())


@pytest.mark.parametrize("small", [False, True])
def test_rules_sent_to_the_texts(spark, monkeypatch, small):
    """Rules in blocks give the same verdicts as one by one, however texts, candidates and rules are cut."""
    monkeypatch.setattr(rule_index, "JOINED", -1, raising=False)
    if small:
        for name, value in (("BLOCK_RULES", 100), ("SLICE", 300), ("STEP", 64), ("PAIRS", 5), ("WINDOWS", 1)):
            monkeypatch.setattr(rule_blocks, name, value)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde é", k=rng.randint(1, 25))) for _ in range(300)]
    texts = [*ODD_TEXTS, *(" ".join(rng.choices(words, k=30)) for _ in range(60))]
    items = spark.createDataFrame([*enumerate(texts), (3, "abcde"), (3, "abcde"), (None, "a"), (None, "zz")], "item_id long, text string")
    rules = [(f"r{k}", "+".join(rng.choices(words, k=rng.randint(1, 4))), str(k % 4)) for k in range(500)]
    rules += [("very long", words[0] * 40, "0"), ("a line", " ".join(words[:9]), "1"), ("abc often", "abc " * 200, "2"), *ODD_RULES]
    few, many = both_ways(items, criteria_frame(spark, rules))
    assert few == many and len(few) > 500 and "abc often" in {c for _, c, _ in many}


def test_candidates_are_not_shuffled(spark, monkeypatch):
    """Pairs of texts and rules grow with both tables: they, and the texts, are neither moved nor stored."""
    written, plans = rule_index.stored, {}

    def seen(df, stem):
        plans[stem] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, stem)

    monkeypatch.setattr(rule_index, "stored", seen)
    items = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "item_id long, text string")
    rules = criteria_frame(spark, [(f"r{k}", f"abc+b{k:04}" if k % 2 else "abc", "0") for k in range(1000)])
    held = labeling.keyword_votes_long(items, rules, CLASSES)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString() and set(plans) == {"rules"}
    assert held.count() == 500 * sum("abc" in (t or "").lower() for t in ODD_TEXTS)
