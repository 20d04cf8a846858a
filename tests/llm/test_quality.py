import re
from collections import Counter

from labelloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def matches_brute(rows, docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in docs)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_learned_list_on_whole_table(spark):
    tables = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    judged, rules = quality.judge(docs, labels)
    rows = judged.collect()
    matches_brute(rows, [(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    known = [(kept[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in kept]
    assert rules and sum(k == bool(q) for k, q in known) / len(known) >= 0.95


def test_odd_rows_and_missing_labels(spark, odd, empty):
    none = spark.createDataFrame([(None, 0), (3, None)], "doc_id long, quality int")
    judged, rules = quality.judge(odd, none)
    assert rules == []
    matches_brute(judged.collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert quality.judge(empty, none)[0].collect() == []


def test_a_conjunction_is_grown_and_pruned(spark):
    rows = [(int(a > 5 and b > 5), k % 3 != 0, a, b) for k, (a, b) in enumerate((a, b) for a in range(12) for b in range(12)) for _ in range(3)]
    frame = spark.createDataFrame(rows, "bad int, grow boolean, n_words long, n_symbols long")
    for name in ("word_chars", "n_marks", "n_upper", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct"):
        frame = frame.withColumn(name, quality.F.lit(1).cast("long"))
    cuts = {name: [] for name in quality.features()} | {"words": [x + 0.5 for x in range(11)], "symbols per character": [x + 0.5 for x in range(11)]}
    rules = quality.learn(frame, cuts)
    assert [sorted(map(str, r)) for r in rules] == [["symbols per character > 5.5", "words > 5.5"]]


def test_gain_and_rule_text():
    assert quality.gain(10, 0, 10, 10) == 10 and quality.gain(0, 5, 5, 5) == 0
    assert str(quality.Condition("words", False, 3.0)) == "words <= 3"
