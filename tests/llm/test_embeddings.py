import math

import numpy as np
import pytest

from labelloom.llm import embeddings


def brute(rows, threshold=0.9):
    vectors = [embeddings.usable(v) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n
    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is None or y is None or len(x) != len(y):
                continue
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min(least.get(r, i), i)
    return sorted((i, links[k], least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows))


def clustered(seed=4, groups=12, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        center = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 12)):
            out.append([float(x) for x in center + 0.12 * rng.standard_normal(dims)])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(3)


@pytest.mark.parametrize("block", [2048, 3])
def test_matches_brute_force_with_odd_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    vectors = clustered()
    vectors += [vectors[0]] * 6 + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16]
    vectors += [[1.0, 2.0], [1.0, 2.1], [2.0, 4.0], [1e-38, 2e-38]]
    rows = [(k, v, None, "x") for k, v in enumerate(vectors)]
    rows.append(rows[3])
    df = frame(spark, rows)
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in embeddings.near_vectors(df).collect()) == brute(stored)


def test_small_window_still_counts_all_links(spark):
    rng = np.random.default_rng(8)
    center = rng.standard_normal(16)
    rows = [(k, [float(x) for x in center + 0.05 * rng.standard_normal(16)], 0, None) for k in range(150)]
    got = embeddings.near_vectors(frame(spark, rows), window=8).collect()
    assert sorted(tuple(r) for r in got) == brute([(r[0], np.float32(r[1]).tolist()) for r in rows])


def test_empty_table(spark):
    assert embeddings.near_vectors(frame(spark, [])).collect() == []


def test_passes_grow_with_the_table():
    few, many = (embeddings.passes_needed(n, 0.9, 0.999) for n in (10_000, 10_000_000))
    assert 1 == embeddings.passes_needed(100, 0.9, 0.999) < few < many


def crowd_with_pairs(cosine, n, pairs, dims=64, seed=6):
    """Unlinked vectors of about that cosine with each other, and ``pairs`` isolated pairs at 0.905."""
    rng = np.random.default_rng(seed)

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    mean = unit(rng.standard_normal((1, dims)))
    away = rng.standard_normal((n, dims))
    crowd = math.sqrt(cosine) * mean + math.sqrt(1 - cosine) * unit(away - (away @ mean.T) * mean)
    aside = rng.standard_normal((pairs, dims))
    u = crowd[:pairs]
    aside = unit(aside - (aside * u).sum(axis=1, keepdims=True) * u)
    # partners keep the crowd's share of the mean as far as a pair can
    return np.concatenate([crowd, 0.905 * u + math.sqrt(1 - 0.905**2) * aside])


@pytest.mark.parametrize("cosine", [0.5, 0.85])
def test_pairs_in_a_crowd_are_found(spark, cosine):
    n, pairs = 6000, 300
    x = crowd_with_pairs(cosine, n, pairs)
    rows = [(k, v, 0, None) for k, v in enumerate(x.tolist())]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame(spark, rows)).collect()}
    x = unit_rows(np.float32(x).astype(float))
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (links > 0).sum() >= 2 * pairs and [got[k] for k in range(len(x))] == links.tolist()


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_of_passes_does_not_depend_on_density(spark, monkeypatch):
    passes = embeddings.passes_needed(embeddings.WINDOW << 5, 0.9, 0.999)
    assert passes > 5
    monkeypatch.setattr(embeddings, "BLOCK", 500)
    monkeypatch.setattr(embeddings, "cheapest", lambda *_: (5, passes, 1e9))
    n, pairs = 3000, 300
    x = crowd_with_pairs(0.7, n, pairs)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame(spark, [(k, v, 0, None) for k, v in enumerate(x.tolist())])).collect()}
    assert sum(got[k] > 0 for k in range(pairs)) >= 0.99 * pairs


def test_meetings_are_counted_over_all_vectors(spark):
    x = crowd_with_pairs(0.7, 500, 10)
    classes = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "node long, vector binary").repartition(3)
    met = embeddings.meetings(classes)
    want = 0
    for p in range(embeddings.COUNTED_PASSES):
        signs = (x.astype(np.float32) @ embeddings.projections(p, 64)[:7].T > 0) @ (1 << np.arange(7))
        want += (np.bincount(signs) ** 2).sum() / embeddings.COUNTED_PASSES
    assert met[0] == len(x) ** 2 and met[7] == pytest.approx(want, rel=0.01) and met[64] >= len(x)
