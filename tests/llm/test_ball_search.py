import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import ball_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for doc, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return in_order(out)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(docs, items, **more):
    rows = ball_search.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()
    return in_order([tuple(r) for r in rows])


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_terms():
    for text in ("Ab-c9 Éé_x\x7fy日本 z\0q", "", None, "A" * 10_000 + "İ"):
        assert [w.decode() for w in ball_search.terms(text.encode() if text is not None else None)] == plain_terms(text)


def test_given_documents(spark, small_tables, documents):
    items = spark.read.parquet(f"{small_tables}/benchmark.parquet")
    assert found(documents, items) == brute(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"))


@pytest.fixture
def many_trees(monkeypatch):
    for name, value in (("TREE_DOCS", 50), ("LEAF_DOCS", 3), ("SUBSPACES", 16), ("TREE_ENTRIES", 400), ("DOCS_PER_TASK", 100), ("TERMS_PER_BLOCK", 60)):
        monkeypatch.setattr(ball_search, name, value)


def test_many_trees_tasks_and_blocks(spark, many_trees):
    """Copies, ties, long texts, null ids, repeated ids and items; subspaces that many terms share."""
    rng = random.Random(3)
    words = [f"w{int(40 * rng.random() ** 2)}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 30])))) for k in range(400)]
    docs += [(1000 + k, "W1 w2, w3 w3") for k in range(120)] + [(None, "w1 w2 w3 w3"), (None, None), (7, None), (8, ""), (9, "!?")]
    docs += [(5000, " ".join(rng.choices(words, k=20_000))), docs[3], docs[3], (3, "w1")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 6, 40])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "unseen"), (103, "w1 w1 W1"), (103, "w2"), (None, "w5 w6"), (104, "w1 w2 w3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"Score": F.lit("x"), "n": F.lit(1)}).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    assert found(frame, asked) == brute(docs, items)
    assert found(frame, asked, k=3) == brute(docs, items, 3)


def test_bounds_hold_for_all_documents_below_a_ball():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 300)
    cols = np.concatenate([np.sort(rng.choice(3000, n, replace=False)) for n in sizes])
    tree = ball_search.BallTree(np.arange(300), sizes, cols, rng.integers(1, 10**6, sizes.sum()))
    assert sorted(tree.ids.tolist()) == list(range(300))
    dense = np.zeros(len(tree.terms))
    for _ in range(50):
        ranks = np.unique(rng.choice(3000, 30))
        query = ball_search.Query(0, ranks, rng.integers(1, 20_000, len(ranks)))
        at = np.searchsorted(tree.terms, ranks)
        known = (at < len(tree.terms)) & (tree.terms[np.minimum(at, len(tree.terms) - 1)] == ranks)
        bounds = tree.upper_bounds(at[known], ranks[known], query.weights[known], query.norms)
        dense[:] = 0
        dense[at[known]] = query.weights[known]
        scores = np.add.reduceat(dense[tree.cols] * tree.xs, tree.ptr[:-1])
        for (a, b), bound in zip(tree.bounds, bounds):
            assert b == a or scores[a:b].max() <= bound


def test_pruning_skips_leaves(spark):
    """Documents of unlike words: a search scores few leaves, and finds what brute force finds."""
    rng = random.Random(9)
    docs = [(k, " ".join(f"t{k % 40}x{rng.randrange(30)}" for _ in range(12))) for k in range(1500)]
    items = [(k, " ".join(f"t{k}x{j}" for j in range(8))) for k in range(40)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = ball_search.search(frame, asked).collect()
    assert in_order([tuple(r)[:4] for r in rows]) == brute(docs, items)
    assert sum(r.n_scored for r in rows) < 0.2 * sum(r.n_leaves for r in rows)


def test_odd_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "w1 w2 w3 shared"), (2, "one three words")], "item_id long, text string")
    assert found(odd, items) == brute(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert found(empty, items) == [] and found(odd, items.limit(0)) == []
