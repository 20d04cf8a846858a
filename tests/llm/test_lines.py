import hashlib
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import lines

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_key):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    split = [(t or "").split("\n") for _, t in rows]
    seen = Counter(k for own in split for k in {key(x) for x in own})
    gone = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_key}
    out = []
    for (i, _), own in zip(rows, split):
        kept = [x for x in own if key(x) not in gone]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df, **kw):
    rows = lines.drop_shared_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("min_docs, min_key", [(10, 1), (2, 6)])
def test_odd_rows_match_brute_force(odd, min_docs, min_key):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd, min_docs=min_docs, min_key=min_key) == brute(rows, min_docs, min_key)


def test_other_columns_pass_and_own_names_replace(odd):
    out = lines.drop_shared_lines(odd)
    assert dict(out.dtypes)["n_lines"] == "bigint" and out.columns.count("n_lines") == 1
    assert {"Row", "size", "node"} <= set(out.columns)
    assert out.filter("text IS NULL").count() == 2


def test_empty_table(empty):
    assert result(empty) == []


def test_many_shards_and_hot_shards(odd, monkeypatch):
    before = result(odd, min_docs=2)
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 16)
    monkeypatch.setattr(lines, "PROBES_PER_TASK", 4)
    assert result(odd, min_docs=2) == before


def test_perfect_hash_is_minimal_and_knows_its_keys():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert sorted(lines.look_up(h, lines.perfect_hash(h))) == list(range(len(h)))


def test_equal_64_bit_hashes_stay_apart():
    h, f, n = np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint32), np.array([5, 6, 8])
    shard = lines.build_shard(h, f, n)
    assert lines.probe_shard(h, f, shard).tolist() == [5, 6, 8]
    assert lines.probe_shard(np.array([9], np.uint64), np.array([4], np.uint32), shard).tolist() == [0]
