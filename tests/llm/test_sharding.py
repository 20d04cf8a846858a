import zlib
from collections import Counter, defaultdict

import pytest

from labelloom.llm import sharding


def check(rows, docs, shards):
    """The contract: sizes, law, gapless slots; returns the shards of each text."""
    want = Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r.size].add(r.shard)
    return where


def test_equal_texts_share_a_shard(documents, texts):
    where = check(sharding.shard_documents(documents).collect(), list(texts.items()), 24)
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("shards", [1, 4, 100])
def test_odd_rows(odd, shards):
    check(sharding.shard_documents(odd, shards).collect(), [(r.doc_id, r.text) for r in odd.collect()], shards)


def test_a_group_of_two_shards_is_spread_over_few(spark):
    docs = [(k, "hot text" if k < 200 else f"pair {k // 2}" if k < 400 else f"single {k}") for k in range(600)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    where = check(rows, docs, 6)
    cut = [k for k, s in where.items() if len(s) > 1]
    assert len(cut) <= 3 and max(len(where[k]) for k in cut) <= 3


def test_everything_linked(spark):
    docs = [(k, f"text {k % 7}") for k in range(300)]
    check(sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect(), docs, 5)


def test_empty_table(empty):
    assert sharding.shard_documents(empty).collect() == []
