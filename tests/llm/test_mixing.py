from collections import defaultdict

import duckdb
import pytest

from labelloom.llm import mixing, queries


def words(text):
    return len((text or "").encode().split())


def test_whole_table_matches_sql(spark, small_tables):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small_tables}/documents.parquet')")
    want = db.sql(queries.mixing_sql())
    got = queries.op1_mixing(spark, small_tables).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_odd_rows_keep_the_limits(odd):
    out = mixing.mix(odd)
    assert len(out.columns) == len(set(c.lower() for c in out.columns)) and {"lang", "Row", "node"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.size == words(r.text) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6 and taken[s] <= target[s] + 1e-6


def test_sources_come_near_their_targets(spark):
    # fifty documents a source
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 30 for s in target)


def test_repeats_are_rows(odd):
    want = defaultdict(int)
    for r in mixing.mix(odd).collect():
        want[r.doc_id, r.text] += r.copies
    rows = mixing.repeated(odd)
    assert rows.columns == odd.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r.doc_id, r.text] += 1
    assert got == {k: n for k, n in want.items() if n}


def test_capped_shares(spark):
    sources = spark.createDataFrame([("=a", 10), ("=b", 1000), ("", 5), ("=c", 0)], "key string, total long")
    rows = {r.key: r for r in mixing.with_targets(mixing.cyclic_weights(sources), mixing.F.sum("total"), 3).collect()}
    assert [rows[k].weight for k in ("=a", "=b", "=c", "")] == [1, 2, 3, 1]
    assert [rows[k].target for k in ("=a", "=b", "=c", "")] == [30.0, 970.0, 0.0, 15.0]


def test_empty_table(empty):
    assert mixing.mix(empty).collect() == [] and mixing.repeated(empty).collect() == []
