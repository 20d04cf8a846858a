"""Language identification with bit-sliced Bloom filters of letter n-grams.

1. Texts become words of lower-cased letters between blanks; n-grams of ``SIZES`` symbols lie within one word and
   its blanks. They are hashed and counted by language over all training rows, per task first.
2. A language keeps an n-gram that makes up at least ``min_rate`` of its n-grams, and at least ``1 / contrast``
   of what the n-gram makes up in any other language. So a language keeps at most 1 / ``min_rate`` n-grams, however
   large the corpus is; which ones follows from counts over all rows.
3. One Bloom filter per language, all of the same size, are laid side by side: row i holds bit i of every filter,
   so the AND of ``PROBES`` rows is the bitmask of all languages that hold an n-gram. Parts of the rows are set by
   separate tasks, and the filter (``ROWS_A_GRAM`` / ``min_rate`` rows of one bit per language at most) is broadcast.
4. A text looks up all its n-grams. Those that every language holds say nothing. Of the others, the popcount
   per language, less what the filter's known share of set bits gives by chance, decides.

Cases: a null text, or one without a letter, is ``und`` with score 0. A null doc_id belongs to the training rows. Without
training rows all rows are ``und``. A text without any known n-gram gets the language with the most training rows, as do
ties (then the first by code point). Rows are judged one by one, repeated ones too. Texts are read whole; long ones are
cut at white space, which no n-gram crosses. Of more than ``most_languages`` labels, those with the most rows are
learned. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored

SIZES = (3, 4, 5)
PROBES = 3
ROWS_A_GRAM = 10
PART_BITS = 12
CHUNK = 1 << 19
KEPT = 1 << 20
UNKNOWN = "und"
BLANK = re.compile(r"\s")
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(number, piece) of texts, long ones cut at white space."""
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > CHUNK:
            cut = BLANK.search(text, at + CHUNK)
            if not cut:
                break
            yield k, text[at : cut.start()]
            at = cut.end()
        yield k, text[at:] if at else text


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, hashes) of all n-grams, some pieces at a time."""
    waiting: list[tuple[int, str]] = []
    size = 0
    for k, piece in pieces(texts):
        waiting.append((k, piece))
        size += len(piece)
        if size >= CHUNK:
            yield hashed(waiting)
            waiting, size = [], 0
    if waiting:
        yield hashed(waiting)


def hashed(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    raw = [("\0" + p.lower() + "\0").encode("utf-32-le", "surrogatepass") for _, p in parts]
    code = np.frombuffer(b"".join(raw), "<u4")
    lengths = np.array([len(r) // 4 for r in raw])
    doc = np.repeat(np.array([k for k, _ in parts], np.int64), lengths)
    letter = letters()[code]
    # letters, one blank (0) after each word, and one before each piece
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[np.cumsum(lengths) - lengths] = True
    symbol, doc = np.where(letter, code, 0)[kept].astype(np.uint64), doc[kept]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    blank = symbol == 0
    for n in SIZES:
        m = len(symbol) - n + 1
        if m <= 0:
            continue
        ok = doc[: m] == doc[n - 1 :]
        for j in range(1, n - 1):
            ok &= ~blank[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ symbol[at + j]) * FACTORS[j]
            h ^= h >> np.uint64(29)
        found.append((doc[at], mix(h)))
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])


def in_fold(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, h, n) over all rows of ``docs(text, lang)``, added up in a task before they are sent."""
    number = {name: k for k, name in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def joined(lang: int) -> tuple[np.ndarray, np.ndarray]:
            h, where = np.unique(np.concatenate([x for x, _ in sums[lang]]), return_inverse=True)
            n = np.bincount(where, np.concatenate([y for _, y in sums[lang]]), len(h)).astype(np.int64)
            sums[lang], held[lang] = [(h, n)], len(h)
            return h, n

        def told(lang: int) -> pa.RecordBatch:
            h, n = joined(lang)
            sums[lang], held[lang] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), lang, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "h", "n"]
            )

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted({number[x] for x in langs}):
                own = [t for t, x in zip(texts, langs) if number[x] == lang]
                for _, h in grams(own):
                    h, n = np.unique(h, return_counts=True)
                    sums.setdefault(lang, []).append((h, n))
                    held[lang] = held.get(lang, 0) + len(h)
                    if len(sums[lang]) > 16:
                        joined(lang)
                while sum(held.values()) > KEPT:
                    fullest = max(held, key=held.get)
                    joined(fullest)
                    if sum(held.values()) > KEPT // 2:
                        yield told(fullest)
        for lang in list(sums):
            if sums[lang]:
                yield told(lang)

    return docs.mapInArrow(counted, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def chosen_grams(counts: DataFrame, totals: dict[int, int], min_rate: float, contrast: float) -> DataFrame:
    """(lang, h) of the n-grams that a language keeps. An n-gram has one row per language at most."""
    rate = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])
    rated = counts.select("lang", "h", (F.col("n") / F.element_at(rate, F.col("lang"))).alias("rate"))
    highest = rated.groupBy("h").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    kept = highest.filter(F.col("highest") >= min_rate).select("h", "highest", F.inline("all"))
    return kept.filter((F.col("rate") >= min_rate) & (F.col("rate") * contrast >= F.col("highest"))).select("lang", "h")


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the filter, one line per probe: all in the part that the first bits of the hash name."""
    low = min(bits, PART_BITS)
    part = (h >> np.uint64(64 - (bits - low))) << np.uint64(low) if bits > low else np.zeros_like(h)
    m = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return part + np.stack([(m >> np.uint64(20 * k)) & np.uint64((1 << low) - 1) for k in range(PROBES)])


@dataclass
class Slices:
    """The filters side by side: row i holds bit i of every language, 64 languages to a word."""

    rows: np.ndarray
    bits: int
    languages: int

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that hold it, as words of 64 bits."""
        out = None
        for at in places(h, self.bits):
            found = self.rows[at.astype(np.int64)]
            out = found if out is None else out & found
        return out

    def columns(self, masks: np.ndarray) -> np.ndarray:
        """Masks as a matrix of zeros and ones, one column per language."""
        return np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little", count=self.languages)

    def chance(self) -> np.ndarray:
        """Per language the share of n-grams it does not hold that the filter returns anyhow."""
        low = 1 << min(self.bits, PART_BITS)
        share = np.zeros(self.languages)
        for at in range(0, len(self.rows), low):
            share += self.columns(self.rows[at : at + low]).mean(axis=0) ** PROBES
        return share / max(1, len(self.rows) // low)


def sliced_filter(kept: DataFrame, languages: int) -> Slices:
    """The filter of (lang, h): parts of its rows are built by tasks and put together here."""
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = max(6, (most * ROWS_A_GRAM - 1).bit_length())
    words, low = -(-languages // 64), min(bits, PART_BITS)

    def built(table: pa.Table) -> pa.Table:
        h, lang = table.column("h").to_numpy().view(np.uint64), table.column("lang").to_numpy()
        part = table.column("part")[0].as_py()
        out = np.zeros((1 << low, words), np.uint64)
        for at in places(h, bits):
            row = (at - np.uint64(part << low)).astype(np.int64)
            np.bitwise_or.at(out, (row, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        return pa.table({"part": pa.array([part], pa.int64()), "bytes": pa.array([out.tobytes()], pa.binary())})

    part = F.shiftrightunsigned("h", 64 - (bits - low)) if bits > low else F.lit(0).cast("long")
    # a bounded number of parts of bounded size
    parts = kept.withColumn("part", part).groupBy("part").applyInArrow(built, "part long, bytes binary").toArrow()
    rows = np.zeros((1 << bits, words), np.uint64)
    for p, raw in zip(parts.column("part").to_pylist(), parts.column("bytes").to_pylist()):
        rows[p << low : (p + 1) << low] = np.frombuffer(raw, np.uint64).reshape(-1, words)
    return Slices(rows, bits, languages)


@dataclass
class Detector:
    """What judging a text needs: names by rank (most training rows first), the filter, and its chance hits."""

    names: list[str]
    slices: Slices | None
    by_chance: np.ndarray

    def popcounts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of n-grams that not all languages hold, and those of them that each language holds."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.names)))
        for doc, h in grams(texts):
            for at in range(0, len(h), 1 << 18):
                d = doc[at : at + (1 << 18)]
                bits = self.slices.columns(self.slices.masks(h[at : at + (1 << 18)]))
                if len(self.names) > 1:
                    telling = ~bits.all(axis=1)
                    bits, d = bits[telling], d[telling]
                if not len(d):
                    continue
                # sizes alternate, so a text comes in up to three runs: sort them together
                order = np.argsort(d, kind="stable")
                bits, d = bits[order], d[order]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                hits[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                total[d[first]] += np.diff(np.append(first, len(d)))
        return total, hits

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and the smoothed share of its telling n-grams against the runner-up."""
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, hits = self.popcounts(texts)
        found = np.maximum(hits - total[:, None] * self.by_chance, 0) / (1 - self.by_chance)
        best = found.argmax(axis=1)
        ordered = np.sort(found, axis=1)
        top, second = ordered[:, -1], ordered[:, -2] if len(self.names) > 1 else np.zeros(len(texts))
        score = (top + 1) / (top + second + 2)
        readable = [t is not None and any(map(str.isalpha, t)) for t in texts]
        return (
            [self.names[b] if r else UNKNOWN for b, r in zip(best, readable)],
            [float(s) if r else 0.0 for s, r in zip(score, readable)],
        )


def fit(docs: DataFrame, min_rate: float = 2e-5, contrast: float = 4.0, most_languages: int = 1024) -> Detector:
    """A detector from all rows of ``docs(text, lang)``; rows without a language teach nothing."""
    known = docs.filter("lang IS NOT NULL").select("text", "lang")
    ranked = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    names = [r.lang for r in ranked]
    if not names:
        return Detector([], None, np.zeros(0))
    # names of languages: at most ``most_languages``
    counts = stored(gram_counts(known.filter(F.col("lang").isin(names)), names), "language-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kept = stored(chosen_grams(counts, totals, min_rate, contrast), "language-grams") if totals else None
    slices = sliced_filter(kept, len(names)) if kept is not None else Slices(np.zeros((64, -(-len(names) // 64)), np.uint64), 6, len(names))
    release(counts, *([kept] if kept is not None else []))
    return Detector(names, slices, np.minimum(slices.chance(), 0.5))


def detect(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                names, scores = shared.value.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return source.mapInArrow(judged, "doc_id long, lang_pred string, score double")


def predict_languages(
    docs: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **settings
) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows of the held-out fold teach nothing."""
    remainder = F.crc32(quoted(doc_id).cast("string").cast("binary")) % folds
    teaching = docs.filter(remainder.isNull() | (remainder != fold))
    detector = fit(teaching.select(quoted(text).alias("text"), quoted(lang).alias("lang")), **settings)
    found = detect(docs, detector, doc_id, text)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
