import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm import language


def plain_grams(text):
    """n-grams of a text as strings, by the definition."""
    out = []
    word = ""
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            padded = f" {word} "
            out += [padded[k : k + n] for n in language.SIZES for k in range(len(padded) - n + 1)]
            word = ""
    return out


@pytest.fixture(scope="module")
def detector(documents):
    return language.fit(documents)


def test_grams_are_those_of_the_definition():
    texts = ["Ab, cd", "", None, "ünïcode 日本語x1y", "a", "  İstanbul\n\nno " + "z" * 50, "..."]
    found = defaultdict(Counter)
    for doc, h in language.grams(texts):
        for d, x in zip(doc.tolist(), h.tolist()):
            found[d][x] += 1
    for k, text in enumerate(texts):
        wanted = Counter(plain_grams(text))
        # equal multisets: as many different n-grams, each as often
        assert sorted(wanted.values()) == sorted(found[k].values())
    a, b = (set(h.tolist()) for _, h in (language.hashed([(0, x)]) for x in ("one two", "TWO-one")))
    assert a == b


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = " ".join(f"word{'abc'[k % 3] * (k % 5)} é" for k in range(3000))
    whole = Counter(np.concatenate([h for _, h in language.grams([text])]).tolist())
    monkeypatch.setattr(language, "CHUNK", 100)
    cut = Counter(np.concatenate([h for _, h in language.grams([text, "x" * 300])]).tolist())
    assert sum(whole.values()) == len(plain_grams(text)) and not whole - cut


def test_filter_returns_all_languages_of_a_gram(spark, documents):
    names = ["de", "en", "es", "fr"]
    known = documents.filter(documents.lang.isin(names)).select("text", "lang")
    counts = language.gram_counts(known, names)
    rows = counts.collect()
    # counts are those of brute force
    wanted = defaultdict(Counter)
    for r in known.collect():
        wanted[names.index(r.lang)].update(plain_grams(r.text))
    for k in range(4):
        assert sorted(r.n for r in rows if r.lang == k) == sorted(wanted[k].values())
    totals = {k: sum(wanted[k].values()) for k in range(4)}
    kept = language.chosen_grams(counts, totals, 2e-5, 4.0)
    rate = {(r.lang, r.h): r.n / totals[r.lang] for r in rows}
    highest = defaultdict(float)
    for (_, h), x in rate.items():
        highest[h] = max(highest[h], x)
    exact = {k for k, x in rate.items() if x >= 2e-5 and x * 4 >= highest[k[1]]}
    assert {(r.lang, r.h) for r in kept.collect()} == exact
    slices = language.sliced_filter(kept, 4)
    hashes = np.array(sorted(highest), np.int64)
    bits = slices.columns(slices.masks(hashes.view(np.uint64)))
    held = np.array([[(k, h) in exact for k in range(4)] for h in hashes.tolist()])
    assert (bits[held] == 1).all()
    wrong = bits[~held].mean()
    assert wrong < 0.05 and abs(wrong - slices.chance().mean()) < 0.01


def test_popcounts_are_sums_over_all_grams(detector, documents):
    texts = [r.text for r in documents.limit(20).collect()] + [None, "12 3"]
    total, hits = detector.popcounts(texts)
    for k, text in enumerate(texts):
        bits = np.zeros((0, len(detector.names)), np.uint8)
        for _, h in language.grams([text]):
            bits = np.concatenate([bits, detector.slices.columns(detector.slices.masks(h))])
        bits = bits[~bits.all(axis=1)]
        assert total[k] == len(bits) and (hits[k] == bits.sum(axis=0)).all()


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    known = [(r.lang, rows[r.doc_id]) for r in docs.collect() if r.lang and rows[r.doc_id].held_out]
    assert len(rows) == docs.count() and len(known) > 100
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert sum(lang == r.lang_pred for lang, r in known) >= 0.97 * len(known)
    # languages of the held-out fold are not used
    turned = docs.withColumn("lang", docs.source).where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0")
    rest = docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    again = language.predict_languages(rest.unionByName(turned)).collect()
    assert {r.doc_id: r for r in again} == rows


def test_many_languages(spark):
    """More labels than bits in a word."""
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(100)]
    rows = [(k * 1000 + j, f"{w} {w}q {w}", f"l{k:03d}") for k, w in enumerate(words) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict_languages(docs, folds=10**9, fold=1).collect()
    assert all(r.lang_pred == f"l{r.doc_id // 1000:03d}" for r in found)
    few = language.predict_languages(docs, folds=10**9, fold=1, most_languages=2).collect()
    assert {r.lang_pred for r in few} == {"l000", "l001"}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    rows = language.predict_languages(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.lang_pred == "und"} == {("und", 0.0)}
    assert {r.lang_pred for r in rows} <= {"und", "en"}
    assert language.predict_languages(empty).collect() == []
    from pyspark.sql import functions as F

    none = language.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    blank = spark.createDataFrame([(1, None, "en"), (2, "", "de"), (3, "12", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict_languages(blank).collect()} == {"und"}
