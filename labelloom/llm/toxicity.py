"""Toxicity: a noisy channel undoes disguised spelling, then restored words are scored.

1. A character trigram model (28 symbols, so at most 21,952 counts) is counted over all texts.
2. Tokens that look disguised (digits or signs among letters, a letter three times in a row, letters
   or signs with gaps of one or two separators between them) become a lattice of what each sign may stand for. Viterbi finds the reading
   with the best product of channel and character probabilities.
3. Evidence: words, and word beginnings of 4 to 6 letters, that toxic texts of a labelled sample hold
   significantly more often than the others (Fisher's exact test, false-discovery rate of 0.05, at any number of
   labels). Near copies count once there. A logistic curve over the
   strongest evidence and the number of such words gives the score.

The classifier is fitted on at most ``sample_rows`` labelled rows (those with the lowest hashes of
their id); the character model, and of course the scores, cover all texts. Labels come from training
rows only: those whose crc32 of the id, as text, modulo ``folds`` is not ``fold``.

Cases: a null or empty text has no evidence and gets the score of the curve without any. A null
doc_id is not held out. Rows repeated in the labels count as one (toxic if any row says so); repeated
documents are scored each on their own. Without toxic or without other training rows, all scores are the
share of toxic rows (0 without rows). Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored
from labelloom.sizing import local_frame

SYMBOLS = 28  # 0: not a letter, 1 to 26: a to z, 27: other letters
SAMPLE_ROWS = 20_000
CACHE_WORDS = 400_000
# A feature counts if toxic texts hold it about exp(2.5) times as often as others.
LEAST_WEIGHT = 2.5
# Longer tokens are read in pieces of about this length that overlap.
PIECE = 40
EDGE = " \t\n\x0b\x0c\r.,;:!?\"'`()[]{}<>%&#*|$-_~=/\\…«»“”‘’¿¡"
# What a sign may stand for between letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
GAPS = " .-_*~'"
WORD = re.compile(r"[^\W\d_]+")
THRICE = re.compile(r"(.)\1\1")
REPEATED = re.compile(r"([^\W\d_])\1{3,}")
CHAIN = re.compile(r"[^\w@$!|+€£*#%]+|_+")
DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+€£*#%.\-_~']+[^\W\d_]|[0-9@$!|+€£][^\W\d_]{2}|([^\W\d_])\1\1")
# Four or more lone letters, or signs for letters, one or two separators apart. Nothing is tried twice, as
# a character once taken isn't given back.
LONE = r"(?:[^\W\d_]|[0-9@$!|+€£#%*])(?![^\W_])"
SPACED = re.compile(rf"(?<![^\W_]){LONE}(?>[ .\-_*~]{{1,2}}{LONE}){{3,}}+")
# Cheap to look for: the two characters within each such run, which have separators on both sides.
WITHIN = re.compile(r"[ .\-_*~]\S[ .\-_*~]{1,2}\S[ .\-_*~]")



def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def byte_symbols() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for k in range(26):
        out[97 + k] = out[65 + k] = k + 1
    out[128:] = 27
    return out


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[bytes]:
    """About a megabyte of texts at a time, kept apart by two blanks."""
    parts, size = [], 0
    for t in texts:
        parts.append(t or b"")
        size += len(parts[-1])
        if size >= most:
            yield b"  ".join(parts) + b"  "
            parts, size = [], 0
    if parts:
        yield b"  ".join(parts) + b"  "


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts, summed per task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_symbol, total = byte_symbols(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for joined in chunks(batch.column(0).cast(pa.large_binary()).to_pylist()):
                s = to_symbol[np.frombuffer(joined, np.uint8)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], ["gram", "n"])

    return docs.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """log P(c | a, b) with add-one smoothing, as rows of a table."""

    def __init__(self, grams: dict[int, int]) -> None:
        n = np.ones(SYMBOLS**3)
        for g, k in grams.items():
            n[g] += k
        n = n.reshape(SYMBOLS * SYMBOLS, SYMBOLS)
        self.log = np.log(n / n.sum(axis=1, keepdims=True)).tolist()

    def restore(self, token: str, masks_drop: bool = True) -> str:
        """The likeliest plain spelling of a disguised token (Viterbi over the last two symbols).

        Letters point back at what stands before them, so the work grows with the length. A mask may stand between letters or for one: with ``masks_drop`` false, it must stand for a letter.
        """
        beams: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for k, c in enumerate(token):
            options = []
            if c.isalpha():
                options.append((c, 0.0))
                if k and token[k - 1] == c:
                    run = k > 1 and token[k - 2] == c or k + 1 < len(token) and token[k + 1] == c
                    options.append(("", -0.2 if run else -3.0))
                    if run:
                        options[0] = (c, -3.0)
            else:
                stands = LOOKS.get(c, "")
                options += [(x, -1.0 - math.log(len(stands))) for x in stands]
                if c in GAPS and (masks_drop or not stands) or not stands:
                    options.append(("", -1.0))
            following: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, text) in beams.items():
                for letter, cost in options:
                    if letter:
                        s = symbol(letter)
                        key, value = (b, s), (score + cost + self.log[a * SYMBOLS + b][s], (text, letter))
                    else:
                        key, value = (a, b), (score + cost, text)
                    if key not in following or value[0] > following[key][0]:
                        following[key] = value
            beams = following
        best = max(beams, key=lambda k: beams[k][0] + self.log[k[0] * SYMBOLS + k[1]][0])
        text, letters = beams[best][1], []
        while text:
            text, letter = text
            letters.append(letter)
        return "".join(reversed(letters))


def pieces(token: str) -> list[str]:
    """The token; of a long one, from the start of each link of its chain as many links as a piece holds.

    A link that is longer stays whole, with its repeated letters shrunk.
    """
    if len(token) <= PIECE:
        return [token]
    token = REPEATED.sub(r"\1\1\1", token)
    gaps = [m.span() for m in CHAIN.finditer(token)]
    starts, ends = [0] + [e for _, e in gaps], [s for s, _ in gaps] + [len(token)]
    return [token[s : ends[max(k, bisect_right(ends, s + PIECE) - 1)]] for k, s in enumerate(starts)]


def readings(token: str, model: CharModel) -> list[str]:
    """The plain words that a lower-cased token may hold."""
    core = token.strip(EDGE)
    if core.isalpha() and token[0] not in "$@!|+" and not THRICE.search(core):
        return [core]
    if not core:
        return []
    whole = token.strip(" \t\n\x0b\x0c\r.,;:?\"'`()[]{}<>…«»“”‘’¿¡")
    if not DISGUISED.search(core) and not re.fullmatch(r"[$!@|+][^\W\d_]{2,}", whole):
        return WORD.findall(core)
    found = WORD.findall(core)
    for piece in pieces(core):
        found += [model.restore(piece), model.restore(piece, masks_drop=False)]
    if whole[0] in "$@!|+":
        found.append(model.restore(pieces(whole)[0]))
    return [*dict.fromkeys(found)]


def gapped(text: str, model: CharModel) -> list[str]:
    """Words spelled with gaps: each run of lone letters and signs, read from each of its letters on."""
    out = []
    if not WITHIN.search(text):
        return out
    for run in SPACED.findall(text):
        lone = re.sub(r"[ .\-_~]", "", run)
        if sum(map(str.isalpha, lone)) < 2:
            continue
        found = [model.restore(lone)] + ([model.restore(lone, masks_drop=False)] if "*" in lone else [])
        for joined in dict.fromkeys(found):
            out += [joined[k : k + PIECE] for k in range(max(1, len(joined) - 3))]
    return out


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with a dash."""
    return [word] + [word[:k] + "-" for k in (4, 5, 6) if len(word) >= k]


class Readings(dict):
    """The plain words of each token, remembered."""

    def __init__(self, model: CharModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> list[str]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[token] = readings(token, self.model)
        return out


def in_fold(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def copy_mark(text: str) -> int:
    """One min-hash over five-word shingles: near copies mostly share it."""
    words = text.split()
    grams = (" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(g) for g in grams) - (1 << 63)


def upper_tails(yes: int, n: int, toxic: int, clean: int, log_fact: np.ndarray) -> tuple[float, float]:
    """The chance that ``yes`` or more of n draws are toxic, and the least such chance that n draws can reach."""
    x = np.arange(yes, min(n, toxic) + 1)
    x = x[n - x <= clean]
    choose = lambda a, b: log_fact[a] - log_fact[b] - log_fact[a - b]
    p = np.exp(choose(toxic, x) + choose(clean, n - x) - choose(toxic + clean, n))
    return float(min(p.sum(), 1.0)), float(p[-1])


def telling_counts(pairs: list[tuple[int, int, int]], toxic: int, clean: int, rate: float) -> list[tuple[int, int]]:
    """The (yes, no) of features that toxic texts hold too often for chance, by Fisher's exact test.

    ``pairs`` are (yes, no, number of features). The false-discovery rate is held over those features only
    whose counts could reach the limit at all (Tarone's bound), so words of one or two texts don't raise it.
    """
    log_fact = np.append(0.0, np.cumsum(np.log(np.arange(1, toxic + clean + 1))))
    p, least = (np.array(x) for x in zip(*(upper_tails(y, y + n, toxic, clean, log_fact) for y, n, _ in pairs)))
    count = np.array([k for _, _, k in pairs], float)
    order = np.argsort(p)
    found = np.cumsum(count[order])
    by_least = np.argsort(least)
    # ties of rounding count as reached
    tested = np.append(0.0, np.cumsum(count[by_least]))[np.searchsorted(least[by_least], p[order] * (1 + 1e-9), "right")]
    held = np.flatnonzero(p[order] * tested <= rate * found)
    limit = p[order][held[-1]] if len(held) else -1.0
    return [(y, n) for (y, n, _), x in zip(pairs, p) if x <= limit]


def evidence(sample: DataFrame, model: CharModel, rate: float = 0.05) -> dict[str, float]:
    """Weights of the features that toxic texts hold significantly more often; near copies count once."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Readings(model)
        for batch in batches:
            out: Counter = Counter()
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns]):
                low = (text or "").lower()
                words = {w for t in set(low.split()) for w in known[t]}.union(gapped(low, model))
                mark = copy_mark(low)
                out.update({(f, mark, toxic): 1 for w in words for f in features(w)}.keys())
                out[("", mark, toxic)] = 1
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int32()))],
                ["feature", "mark", "toxic"],
            )

    marks = sample.select("text", "toxic").mapInArrow(seen, "feature string, mark long, toxic int").distinct()
    counts = stored(
        marks.groupBy("feature").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")), "toxic-evidence"
    )
    total = counts.filter("feature = ''").first()
    if total is None or not total.yes or not total.no:
        release(counts)
        return {}
    # features of equal counts are equally telling, so only the different counts come here
    words = counts.filter("feature <> '' AND yes > 0")
    pairs = [tuple(r) for r in words.groupBy("yes", "no").count().collect()]
    table = {}
    for yes, no in telling_counts(pairs, total.yes, total.no, rate):
        w = math.log((yes + 0.5) / (total.yes + 1)) - math.log((no + 0.5) / (total.no + 1))
        if w >= LEAST_WEIGHT:
            table[yes, no] = w
    chosen = local_frame(sample.sparkSession, list(table), "yes long, no long")
    rows = words.join(chosen, ["yes", "no"]).select("feature", "yes", "no").collect() if table else []
    release(counts)
    weights = {r.feature: table[r.yes, r.no] for r in rows}
    return weights


class Weights(dict):
    """The strongest evidence in each token, remembered."""

    def __init__(self, weights: dict[str, float], model: CharModel) -> None:
        super().__init__()
        self.weights, self.model = weights, model

    def of_words(self, words: list[str]) -> float:
        return max((self.weights.get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[token] = self.of_words(readings(token, self.model))
        return out

    def summary(self, text: str | None) -> tuple[float, float]:
        """(strongest evidence, log of one plus the number of different tokens with any)."""
        low = (text or "").lower()
        found = [w for w in map(self.__getitem__, set(low.split())) if w]
        loose = [w for w in (self.of_words([x]) for x in gapped(low, self.model)) if w]
        return max(found + loose, default=0.0), math.log1p(len(found) + bool(loose))


def fit_curve(rows: list[tuple[float, float, int]]) -> list[float]:
    """Logistic regression with two inputs by Newton steps, lightly regularised."""
    x = np.array([(1.0, a, b) for a, b, _ in rows])
    y = np.array([t for _, _, t in rows], float)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        move = np.linalg.solve(hess, grad)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta.tolist()


@dataclass
class Scorer:
    """Everything that scoring a text needs: the character model, the evidence, and the curve."""

    model: CharModel
    weights: dict[str, float]
    beta: list[float]

    def scores(self, table: Weights, texts: list) -> list[float]:
        sums = (self.beta[0] + self.beta[1] * a + self.beta[2] * b for a, b in map(table.summary, texts))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in sums]


def fit(source: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer for ``source(doc_id, text)`` from all its texts and the rows of ``labels(doc_id, toxic)``."""
    model = CharModel({r.gram: r.n for r in trigram_counts(source).collect()})
    # the sample: bounded by its parameter, so it may be sent to all tasks
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    one_each = known.agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = stored(one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "toxic-labels")
    sample = stored(source.join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    weights = evidence(sample, model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Weights(weights, model)
        for batch in batches:
            out = [table.summary(t) for t in batch.column(0).to_pylist()]
            a, b = ([x[k] for x in out] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column(1).cast(pa.int32())], ["a", "b", "toxic"]
            )

    # three numbers for each row of the sample
    points = [tuple(r) for r in sample.select("text", "toxic").mapInArrow(summed, "a double, b double, toxic int").collect()]
    release(sample, chosen)
    if weights:
        return Scorer(model, weights, fit_curve(points))
    share = sum(p[2] for p in points) / max(len(points), 1)
    level = math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0
    return Scorer(model, weights, [level, 0.0, 0.0])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    fold: int = 0,
    sample_rows: int = SAMPLE_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of the held-out fold teach nothing."""
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    scorer = fit(source, labels.filter(remainder != fold), sample_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Weights(scorer.weights, scorer.model)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            scores = scorer.scores(table, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([in_fold(i, folds, fold) for i in ids], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return source.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    limit: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose score lies below ``limit``."""
    scorer = fit(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), labels, sample_rows)
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Weights(scorer.weights, scorer.model)
        for batch in batches:
            scores = scorer.scores(table, batch.column(at).to_pylist())
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
