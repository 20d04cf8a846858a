import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelloom.llm import bloom_lm


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def brute(rows, folds=7, fold=2):
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)))
        for (i, x), h in zip(rows, held)
    ]


def ordered(rows):
    return sorted(rows, key=lambda r: repr(r[:4]))


@pytest.mark.parametrize("head_words", [1 << 20, 20])
def test_base_scores_match_brute_force(odd, head_words):
    got = ordered(tuple(r) for r in bloom_lm.score_texts(odd, head_words=head_words).collect())
    want = ordered(brute([(r.doc_id, r.text) for r in odd.collect()]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r[6] < 0 for r in got)


def test_model_beats_base_on_held_out_text(documents):
    rows = [r for r in bloom_lm.score_texts(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table(empty):
    assert bloom_lm.score_texts(empty).collect() == []


def test_filter_returns_levels(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 62), 1 << 62, 50_000)
    n = rng.integers(2, 1000, 50_000)
    counts = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(h, n)], "kind byte, h long, n long")
    level = np.floor(np.log2(n)).astype(int)
    per_level = {int(k): int((level == k).sum()) for k in set(level)}
    for most in (1024, 1):
        whole, shift, step = bloom_lm.log_filter(counts, per_level, max_parts=most)
        assert len(whole) <= most * bloom_lm.PART_BYTES
        read = bloom_lm.read_levels(h.view(np.uint64), whole, shift)
        assert (read >= level // step).all() and (read != level // step).mean() < 0.03
        unknown = rng.integers(-(1 << 62), 1 << 62, 50_000).view(np.uint64)
        assert (bloom_lm.read_levels(unknown, whole, shift) > 0).mean() < 0.03
    assert step > 1


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_tokens_of_slices(monkeypatch, size):
    """Words as bytes methods cut them, whatever the slices; only A-Z are lower-cased."""
    monkeypatch.setattr(bloom_lm, "SLICE_BYTES", size)
    rng = random.Random(3)
    texts = [None, "", " ", "  a b  ", "\x1cA", "one " * 500]
    texts += ["".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x85\xa0 abABZÀéİ\x00日", k=rng.randint(0, 40))) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    got = list(bloom_lm.chunks(iter([batch.slice(0, 700), batch.slice(700)]), bloom_lm.WordHashes(), 300, lambda i: i % 5 != 0))
    want = [[bloom_lm.xxhash.xxh64_intdigest(w) for w in tokens(t)[:-1]] + [bloom_lm.END] for k, t in enumerate(texts) if k % 5]
    assert sum((c[0] for c in got), []) == [k for k in range(len(texts)) if k % 5] and len(got) > 3
    assert np.concatenate([c[1] for c in got]).tolist() == [len(w) for w in want]
    assert np.concatenate([c[2] for c in got]).tolist() == sum(want, [])


def test_a_gram_is_looked_up_once(spark, monkeypatch):
    """Words and bigrams that a piece of text repeats are asked for once, in the order of the filter."""
    asked = []

    def read(h, *rest):
        asked.append(h)
        return levels(h, *rest)

    levels = bloom_lm.read_levels
    run = type(spark.range(1)).mapInArrow
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the cat and the cat " * 50, "the cat"]})

    def here(df, function, schema):
        if schema == bloom_lm.SCORED:
            list(function(iter([batch])))
        return run(df, function, schema)

    monkeypatch.setattr(bloom_lm, "read_levels", read)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", here)
    docs = spark.createDataFrame(batch.to_pandas())
    assert bloom_lm.score_texts(docs).count() == 2
    assert len(asked) == 2 and all((np.diff(h.view(np.uint64)) > 0).all() for h in asked) and len(asked[0]) == 4


def test_scores_do_not_depend_on_what_is_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(bloom_lm, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(bloom_lm, "LINES", 16)
    extra = spark.createDataFrame([(1000 + k, " ".join(f"w{k * j % 701}" for j in range(60))) for k in range(200)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).repartition(3)
    one, cut = (ordered(tuple(r) for r in bloom_lm.score_texts(docs, max_parts=most).collect()) for most in (1024, 1))
    assert len(one) == docs.count() and [r[:5] for r in one] == [r[:5] for r in cut]
    assert [r[5:] for r in one] == [pytest.approx(r[5:], rel=1e-9) for r in cut]


def test_a_word_seen_once_is_not_an_unknown_word(spark):
    texts = [(k, "common words here") for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2]
    texts[0] = (texts[0][0], "common words here seldom")
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    docs = spark.createDataFrame(texts + [(held[0], "seldom"), (held[1], "unheard")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in bloom_lm.score_texts(docs).collect()}
    assert score[held[0]] > score[held[1]] + 0.3


@pytest.mark.parametrize("size", [40, 1 << 22])
def test_counts_are_summed_by_ranges_of_the_hash(spark, odd, monkeypatch, size):
    """Exact counts of words and bigrams; a chunk sends a row per range, not one per gram."""
    monkeypatch.setattr(bloom_lm, "RANGE_BYTES", size, raising=False)
    run, sent = type(spark.range(1)).mapInArrow, []

    def seen(df, function, schema):
        out = run(df, function, schema)
        sent.append(out)
        return out

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", seen)
    docs = odd.select("doc_id", "text")
    got = {(r.kind, r.h): r.n for r in bloom_lm.gram_counts(docs, 7, 2).collect()}
    want = Counter()
    for i, text in ((r.doc_id, r.text) for r in docs.collect()):
        if not bloom_lm.is_held_out(i, 7, 2):
            h = np.array([bloom_lm.xxhash.xxh64_intdigest(w) for w in tokens(text)[:-1]] + [bloom_lm.END], np.uint64)
            want.update((0, int(x)) for x in h.view(np.int64))
            want.update((1, int(x)) for x in bloom_lm.pair_hash(bloom_lm.before(h), h).view(np.int64))
    assert got == want
    if size > 40:
        assert sent[0].count() <= 2 * docs.rdd.getNumPartitions() < len(got)


def test_filter_parts_of_counts_cut_anywhere(spark, monkeypatch):
    """Parts hold the same bits however many rows of counts a task cuts at a time; few rows are sent."""
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(-(1 << 63), (1 << 63) - 1, 3000), rng.integers(1, 300, 3000))]
    counts = spark.createDataFrame(rows, "h long, n long").repartition(2)
    parts = []
    for most in (400_000, 7):
        monkeypatch.setattr(bloom_lm, "PART_ROWS", most, raising=False)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if most > 7 else 5)
        try:
            parts.append({r.part: bytes(r.bytes) for r in bloom_lm.filter_parts(counts, 3, 1, 0).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts[0] == parts[1] and set(parts[0]) == set(range(8))
    whole = np.frombuffer(b"".join(parts[0][k] for k in range(8)), np.uint8)
    h, n = (np.array(x) for x in zip(*rows))
    assert (bloom_lm.read_levels(h.view(np.uint64), whole, 61, 0) >= bloom_lm.levels_of(n, 1)).all()


def test_long_texts_come_in_small_batches(spark, monkeypatch):
    """Counting and scoring are handed some texts at a time, and the session's own limit stays as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(bloom_lm, "BATCH_BYTES", 1 << 12, raising=False)
    before, limits = spark.conf.get(key), []
    written = bloom_lm.stored

    def seen(df, stem):
        limits.append((stem, spark.conf.get(key)))
        return written(df, stem)

    monkeypatch.setattr(bloom_lm, "stored", seen)
    docs = spark.createDataFrame([(k, f"w{k} " * 500) for k in range(40)], "doc_id long, text string")
    assert bloom_lm.score_texts(docs).count() == 40
    assert ("gram-counts", "4096") in limits and ("lm-rows", "4096") in limits and spark.conf.get(key) == before


def test_rows_of_numbers_come_back():
    rng = np.random.default_rng(5)
    size = np.array([3, 1, 400, 2])
    h = np.concatenate([np.sort(rng.integers(0, 1 << 64, k, np.uint64)) for k in size])
    for values in (h, h.astype(np.uint32)):
        raw = bloom_lm.planes(bloom_lm.steps(values, size), size)
        assert (bloom_lm.from_steps(bloom_lm.from_planes(raw, size, values.dtype), size) == values).all()
    none = np.array([0, 2, 0])
    assert bloom_lm.from_planes(bloom_lm.planes(h[:2], none), none, np.uint64).tolist() == h[:2].tolist()


@pytest.mark.parametrize("ranges, tokens_a_chunk", [(40, 200), (1 << 14, 1 << 20), (1 << 22, 200)])
def test_a_filter_that_is_not_sent(spark, odd, monkeypatch, ranges, tokens_a_chunk):
    """The same scores, exact base scores, if ranges hold parts or parts ranges; texts are neither kept nor moved."""
    monkeypatch.setattr(bloom_lm, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(bloom_lm, "LINES", 16)
    monkeypatch.setattr(bloom_lm, "CHUNK_TOKENS", tokens_a_chunk, raising=False)
    extra = spark.createDataFrame([(1000 + k, " ".join(f"w{k * j % 701}" for j in range(60))) for k in range(200)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).repartition(3)
    want = ordered(tuple(r) for r in bloom_lm.score_texts(docs).collect())
    monkeypatch.setattr(bloom_lm, "RANGE_BYTES", ranges)
    written, seen = bloom_lm.stored, []

    def noted(df, stem):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, stem)

    monkeypatch.setattr(bloom_lm, "stored", noted)
    got = ordered(tuple(r) for r in bloom_lm.score_texts(docs, max_parts=1).collect())
    exact = ordered(brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert [r[:5] for r in got] == [r[:5] for r in want] == [r[:5] for r in exact]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in exact], rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-9)
    assert not any("text" in columns for columns, _ in seen)
    # one exchange of grams by range; later only answers, the chunks' numbers, and parts that hold several ranges
    turns = min(bloom_lm.TURNS, 1 << bloom_lm.range_bits(bloom_lm.text_size(docs)[0]))
    assert [plan.count("hashpartitioning(at") for _, plan in seen[: turns + 1]] == [0] + [1] * turns
    assert all("hashpartitioning(text" not in plan and "hashpartitioning(h" not in plan for _, plan in seen)


def test_no_text_has_more_entries():
    for text in ("", "a", "a b c", " aa  bb", "a " * 50):
        own = tokens(text)
        words, pairs = Counter(own), Counter(zip([b""] + own, own))
        entries = sum(int(math.log2(n)) + 1 for n in [*words.values(), *pairs.values()])
        assert entries <= bloom_lm.most_entries(len(text), 1)


def test_stored_tables_leave_no_shuffle_files(spark):
    """Files of a shuffle go when the table is written, not when the driver happens to collect its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum("shuffle_" in str(name) for name in disk.getAllFiles().mkString("\n").split("\n"))

    before = shuffled()
    table = bloom_lm.stored(spark.range(1000).repartition(7, "id"), "test")
    for _ in range(100):
        if (after := shuffled()) <= before:
            break
        time.sleep(0.1)
    assert after <= before and table.count() == 1000
    bloom_lm.release(table)
