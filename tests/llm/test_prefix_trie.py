import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes of the rebuilt conversations, from every prefix of each."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    original = {c: [k[3:] for k in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in original.items():
        base, h = c - (c % 5 if c >= 0 else -(-c % 5)), zlib.crc32(str(c).encode()) % 9
        built[c] = original.get(base, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=lambda r: r[:2])


@pytest.fixture
def small_shards(monkeypatch):
    for name, value in (("ROWS_PER_SHARD", 20), ("TURNS_PER_PART", 40), ("BLOCKS_PER_SPAN", 2)):
        monkeypatch.setattr(prefix_trie, name, value)


def test_given_conversations(spark, small_tables):
    df = spark.read.parquet(f"{small_tables}/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_shards_blocks_and_odd_rows(spark, small_shards):
    """Nodes over many shards, conversations over many blocks, nulls, ties, repeats, ids below zero, no turns left."""
    rng, rows = random.Random(1), []
    for k in range(-20, 60):
        for t in range(rng.choice([0, 1, 2, 3, 9, 40, 100])):
            role = rng.choice(["u", "a", None]) if t > 35 else "u"
            text = f"t{t}é" if rng.random() < 0.9 else rng.choice([None, "", "x", "long " * 5000])
            rows.append((k, t if rng.random() < 0.95 else None, role, text))
    # one group of equal conversations, and one conversation with a third of all turns
    rows += [(k, t, "u", f"same {t}") for k in range(100, 160) for t in range(35)]
    rows += [(200, t, "u", f"same {t}") for t in range(1500)]
    rows += rows[:7] + [(None, 1, "u", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).withColumn("Path", F.lit("other")).withColumn("n", F.lit(1)).repartition(5)
    assert found(df) == brute(rows)


def test_one_row_no_rows_and_turnless(spark):
    empty = spark.createDataFrame([], ROWS)
    assert found(empty) == [] and prefix_trie.prefix_trie(empty).columns[0] == "conv_id"
    assert found(spark.createDataFrame([(None, 0, "u", "x")], ROWS)) == []
    # bases are absent: these lose all their turns
    short = [(c, 0, "u", "x") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    assert found(spark.createDataFrame(short, ROWS)) == brute(short) and len(brute(short)) == 1
    assert found(spark.createDataFrame([(5, None, None, None)], ROWS)) == brute([(5, None, None, None)])
