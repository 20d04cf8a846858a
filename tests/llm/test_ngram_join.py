from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from labelloom.llm import groups, ngram_join


def brute(rows, n=5, threshold=0.8):
    """Links and components over rows (not ids), by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        width = min(n, len(w))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set())
    links, root = Counter(), list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
            links[a] += 1
            links[b] += 1
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    ids = [i for i, _ in rows]
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, links[k], least.get(root[k])) for k, i in enumerate(ids)), key=repr)


@pytest.mark.parametrize("block", [512, 2])
def test_odd_rows_match_brute_force(odd, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "SET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "BAND_BLOCK", 4 * block)
    rows = ngram_join.near_duplicates(odd).collect()
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in rows), key=repr) == want


def test_whole_table_matches_brute_force(documents, texts):
    got = [(r.doc_id, r.n_links, r.component_id) for r in ngram_join.near_duplicates(documents).collect()]
    assert sorted(got, key=repr) == brute(list(texts.items()))


def test_one_row_of_each_group_stays(odd):
    found = ngram_join.near_duplicates(odd).collect()
    left = ngram_join.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    stays = sorted(((r.doc_id) for r in found if r.kept), key=repr)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == stays
    # texts without words all stay
    assert sum(1 for r in left.collect() if not (r.text or "").strip()) == 4


def test_empty_table(empty):
    assert ngram_join.near_duplicates(empty).collect() == []
    assert ngram_join.drop_near_duplicates(empty).collect() == []


def test_band_layout_reaches_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.HASHES


def test_sketches_keep_similar_pairs():
    rng = np.random.default_rng(2)
    factors, masks = ngram_join.seeds()
    limit = ngram_join.most_unequal(0.8)
    far = 0
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        near, other = x.copy(), x.copy()
        near[:110] = rng.integers(0, 1 << 63, 110)  # similarity 0.8
        other[:700] = rng.integers(0, 1 << 63, 700)  # similarity 0.18
        marks = ngram_join.sketches([ngram_join.sketch_of(ngram_join.min_hashes(np.unique(s), factors, masks)) for s in (x, near, other)])
        assert ngram_join.unequal(marks[0], marks[1]) <= limit
        far += int(ngram_join.unequal(marks[0], marks[2]) <= limit)
    assert far == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (70, 60)]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)} | {60: 60, 70: 60}
