"""Plain-Python answers for small fixtures, written row by row."""

import math
import random

ABSTAIN = -1


def vote_table(n_items, n_lfs, n_classes, seed, density=0.5, unipolar=True):
    rng = random.Random(seed)
    own = [rng.randrange(n_classes) for _ in range(n_lfs)]
    rows = []
    for _ in range(n_items):
        rows.append(
            [
                (own[j] if unipolar else rng.randrange(n_classes)) if rng.random() < density else ABSTAIN
                for j in range(n_lfs)
            ]
        )
    return rows, own


def majority(rows, classes, prior, weights, ties):
    out = []
    for row in rows:
        mass = [sum(w for v, w in zip(row, weights) if v == c) for c in classes]
        top = [i for i, m in enumerate(mass) if m == max(mass)]
        best = top[0] if ties == "first" else max(top, key=lambda i: (prior[i], -i))
        out.append(classes[best])
    return out


def share(rows, classes):
    votes = [v for row in rows for v in row if v != ABSTAIN]
    return [votes.count(c) / len(votes) for c in classes]


def macro(pairs):
    classes = {x for p in pairs for x in p}
    scores = []
    for c in classes:
        tp = sum(1 for a, b in pairs if a == b == c)
        pred = sum(1 for _, b in pairs if b == c)
        true = sum(1 for a, _ in pairs if a == c)
        p, r = (tp / pred if pred else 0.0), (tp / true if true else 0.0)
        scores.append((2 * p * r / (p + r) if p + r else 0.0, p, r))
    mean = [sum(s[i] for s in scores) / len(scores) for i in range(3)]
    return {"f1": mean[0], "precision": mean[1], "recall": mean[2], "acc": sum(a == b for a, b in pairs) / len(pairs)}


def posterior(row, prior, confusion, transposed):
    """Class probabilities of one item by multiplying plain likelihoods."""
    k = len(prior)
    weight = []
    for y in range(k):
        x = prior[y] + 1e-15
        for j, v in enumerate(row):
            if v != ABSTAIN:
                x *= (confusion[j][v][y] if transposed else confusion[j][y][v]) + 1e-15
        weight.append(x)
    return [w / sum(weight) for w in weight]


def em_pass(rows, prior, confusion, transposed, ps=50.0, cs=20.0, mcs=0.1):
    """One expectation and maximisation pass over dense rows."""
    n, m, k = len(rows), len(rows[0]), len(prior)
    post = [posterior(r, prior, confusion, transposed) for r in rows]
    new_prior = [(max(sum(p[y] for p in post), mcs * n) + ps) / (n + ps * k) for y in range(k)]
    new_confusion = []
    for j in range(m):
        voters = [i for i in range(n) if rows[i][j] != ABSTAIN]
        default = [[0.7 if a == b else 0.3 / (k - 1) for b in range(k)] for a in range(k)]
        if not voters:
            new_confusion.append(default)
            continue
        w = min(0.8, len(voters) / (100 * k))
        matrix = []
        for y in range(k):
            counts = [sum(post[i][y] for i in voters if rows[i][j] == v) for v in range(k)]
            total = sum(counts)
            line = []
            for v in range(k):
                fresh = counts[v] / total if total else 0.0
                mixed = w * fresh + (1 - w - 0.1) * confusion[j][y][v] + 0.1 * default[y][v]
                line.append((mixed + cs) / (1 + cs * k))
            line = [x / sum(line) for x in line]
            line = [min(max(x, 1e-6), 1 - 1e-6) for x in line]
            matrix.append([x / sum(line) for x in line])
        new_confusion.append(matrix)
    log_likelihood = sum(math.log(max(p) + 1e-10) for p in post)
    return post, new_prior, new_confusion, log_likelihood
