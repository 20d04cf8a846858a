import pytest
from pyspark.sql import functions as F

from labelloom.operators import labeling
from labelloom.operators.analysis import good_lfs, lf_summary, restrict_criteria
from labelloom.operators.classes import ClassList
from labelloom.sizing import local_frame
from labelloom.sources.readers import flatten_verdicts

CLASSES = ClassList(("0", "1", "2"))


def criteria_frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "ord bigint, criterion string, description string, class string"
    )


def items_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


RULES = [
    ("plain", "cat", "0"),
    ("both", "cat+dog", "1"),
    ("trailing", "cat+", "1"),
    ("empty", "", "2"),
    ("upper", "CAT", "0"),
    ("blank matters", " cat ", "0"),
    ("unknown class", "dog", "9"),
    ("no description", None, "0"),
]
TEXTS = ["a CAT sat", "cat and dog", "Dog only", "", None, "bobcat"]


def test_keyword_rules(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    fired = items_frame(spark, TEXTS).select(
        "item_id", labeling.fired_by_keywords(F.col("text"), lfs).alias("fired")
    )
    got = {r.item_id: [lfs.names[i] for i in r.fired] for r in fired.collect()}
    expected = {}
    for i, text in enumerate(TEXTS):
        held = [
            n for n, d, _ in RULES
            if text is not None and d is not None and all(k.lower() in text.lower() for k in d.split("+"))
        ]
        expected[i] = held
    assert got == expected


def test_one_meaning_for_every_code_point(spark):
    """A rule made of a character holds for a text with that character, alone or among 400 rules."""
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000 and chr(c) != "+"]
    items = items_frame(spark, [f"a {chr(c)}" for c in points])
    cased = [c for c in points if chr(c).lower() != chr(c) or chr(c).upper() != chr(c)]
    picked = [0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, 0x10D50, *cased[:: len(cased) // 390]]
    for some in (picked[:15], picked[:16], picked):
        lfs = labeling.labeling_set(criteria_frame(spark, [(f"c{c}", chr(c), "0") for c in some]), CLASSES)
        table = items.select("item_id", labeling.fired_by_keywords(F.col("text"), lfs).alias("fired")).filter(F.size("fired") > 0)
        fired = {points[r.item_id]: {lfs.names[i] for i in r.fired} for r in table.collect()}
        assert all(f"c{c}" in fired[c] for c in some)


def test_keyword_votes_stay_in_the_scan(spark, tmp_path):
    items_frame(spark, TEXTS).write.parquet(f"{tmp_path}/items")
    lfs = labeling.labeling_set(criteria_frame(spark, [(f"c{i}", f"k{i}", "0") for i in range(40)]), CLASSES)
    votes = labeling.votes_long(labeling.keyword_ballots(spark.read.parquet(f"{tmp_path}/items"), lfs), lfs)
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Exchange" not in plan


def test_votes_need_a_known_class_and_abstains_are_absent(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    table = labeling.keyword_ballots(items_frame(spark, TEXTS), lfs)
    long = {(r.item_id, r.criterion, r.class_idx) for r in labeling.votes_long(table, lfs).collect()}
    assert (1, "both", 1) in long
    assert not any(c == "unknown class" for _, c, _ in long)
    wide = {r.item_id: r.asDict() for r in labeling.vote_matrix(table, lfs).collect()}
    assert wide[2]["plain"] == -1 and wide[4]["empty"] == -1 and wide[1]["both"] == 1


def test_last_criterion_wins_and_keeps_first_place(spark):
    lfs = labeling.labeling_set(
        criteria_frame(spark, [("a", "x", "0"), ("b", "y", "1"), ("a", "z", "02")]), CLASSES
    )
    assert lfs.names == ["a", "b"]
    assert lfs.functions[0].description == "z" and lfs.class_of == [2, 1]


def test_blocks_give_the_same_votes(spark):
    rules = [(f"r{i}", w, str(i % 3)) for i, w in enumerate(["a", "b+c", "", "ca", "zz", "b", "c+a+b"])]
    texts = ["abc", "cab", "", None, "zzz b", "CA"]
    criteria, items = criteria_frame(spark, rules), items_frame(spark, texts)
    whole = labeling.keyword_votes_long(items, criteria, CLASSES)
    blocks = labeling.keyword_votes_long(items, criteria, CLASSES, planned=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))


def test_user_expressions_as_functions(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, [("long", "", "0"), ("question", "", "1")]), CLASSES)
    conditions = {"long": F.length("text") > 5, "question": F.col("text").endswith("?")}
    table = labeling.expression_ballots(items_frame(spark, ["why?", "a long text", None]), lfs, conditions)
    assert {r.item_id: r.fired for r in table.collect()} == {0: [1], 1: [0], 2: []}


ANSWERS = [
    # item, chunk, content, failed
    (0, 0, 'Sure! {"thoughts": "a\nb", "found_criteria": ["plain"]} Bye', False),
    (0, 1, '{"thoughts": "", "found_criteria": ["both", "plain"]}', False),
    (1, 0, '{"thoughts": "", "found_criteria": []}', False),
    (2, 0, '{"thoughts": "", "found_criteria": ["plain"]}', False),
    (2, 1, None, True),
    (3, 0, "no object", False),
    (3, 1, '{"found_criteria": ["both"]}', False),
    (4, 0, '{"found_criteria": ["nobody knows"]}', False),
]


def test_model_answers(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    answers = spark.createDataFrame(ANSWERS, "item_id bigint, chunk int, content string, failed boolean")
    fired = {r.item_id: r.fired for r in labeling.fired_by_answers(answers, lfs).collect()}
    assert fired == {0: [0, 1], 1: None, 2: None, 3: None, 4: []}
    lenient = {r.item_id: r.fired for r in labeling.fired_by_answers(answers, lfs, on_unreadable="skip").collect()}
    assert lenient == {0: [0, 1], 1: None, 2: None, 3: [1], 4: []}
    broken = {(r.item_id, r.chunk) for r in labeling.answer_problems(answers, lfs).collect()}
    assert broken == {(2, 1), (3, 0), (4, 0)}


def test_not_judged_is_null_everywhere(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    answers = spark.createDataFrame(ANSWERS, "item_id bigint, chunk int, content string, failed boolean")
    maps = {r.item_id: r.labels for r in labeling.verdicts(labeling.fired_by_answers(answers, lfs), lfs).collect()}
    assert set(maps[1].values()) == {None}
    assert maps[4] == dict.fromkeys(lfs.names, False)
    flat = flatten_verdicts(labeling.verdicts(labeling.fired_by_answers(answers, lfs), lfs))
    assert flat.count() == 5 * len(lfs)


def test_dispatch_and_model_plug(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    chunks = labeling.request_chunks(criteria_frame(spark, RULES), "pets", per_request=3)
    assert len(chunks) == 3 and all("pets" in c for c in chunks)

    def fake(requests):
        found = F.when(F.col("text").contains("dog"), '{"found_criteria": ["both"]}').otherwise("?")
        return requests.filter("text is not null").select("item_id", "chunk", found.alias("content"), F.lit(False).alias("failed"))

    items = items_frame(spark, TEXTS)
    table = labeling.ballots(items, lfs, "llm", chunks, fake)
    votes = {r.item_id: [tuple(v) for v in r.votes] for r in table.collect()}
    assert votes == {0: [], 1: [(1, 1)], 2: [], 3: [], 4: [], 5: []}
    other = labeling.ballots(items, lfs, "anything else", chunks, fake)
    assert other.count() == len(TEXTS)
    with pytest.raises(ValueError):
        labeling.ballots(items, lfs, "llm")
    assert labeling.ballots(items, lfs, "keywords").filter("size(votes) > 0").count() > 0


def test_long_votes_back_to_ballots(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, RULES), CLASSES)
    items = items_frame(spark, TEXTS)
    table = labeling.keyword_ballots(items, lfs)
    again = labeling.ballots_from_votes(items, labeling.votes_long(table, lfs), lfs.names)
    assert {r.item_id: r.votes for r in again.collect()} == {r.item_id: r.votes for r in table.collect()}
    stored = labeling.ballots_from_verdicts(labeling.verdicts(table, lfs), lfs)
    assert {r.item_id: r.votes for r in stored.collect()} == {r.item_id: r.votes for r in table.collect()}


def test_summary_and_filter(spark):
    lfs = labeling.labeling_set(criteria_frame(spark, [("a", "a", "0"), ("b", "b", "1"), ("z", "zz", "2")]), CLASSES)
    items = spark.createDataFrame(
        [(0, "a", 0), (1, "ab", 0), (2, "ab", 1), (3, "b", 0), (4, "", 2)], "item_id bigint, text string, label_idx int"
    )
    table = labeling.keyword_ballots(items, lfs, keep=("label_idx",))
    got = {r.criterion: r for r in lf_summary(table, lfs).collect()}
    a, b, z = got["a"], got["b"], got["z"]
    assert (a.coverage, a.overlaps, a.conflicts, a.correct, a.incorrect) == (0.6, 0.4, 0.4, 2, 1)
    assert a.emp_acc == pytest.approx(2 / 3) and b.emp_acc == pytest.approx(1 / 3)
    assert (z.coverage, z.emp_acc, z.polarity, z.correct) == (0.0, 0.0, [], 0)
    summary = lf_summary(table, lfs)
    assert [r.criterion for r in good_lfs(summary, 0.5).collect()] == ["a"]
    # the threshold is strict, and a function without votes fails even 0
    assert {r.criterion for r in good_lfs(summary, 0.0).collect()} == {"a", "b"}
    sizes = [good_lfs(summary, t).count() for t in (0.0, 0.3, 0.4, 0.7)]
    assert sizes == sorted(sizes, reverse=True)
    left = restrict_criteria(criteria_frame(spark, [("a", "a", "0"), ("b", "b", "1")]), good_lfs(summary, 0.5))
    assert [r.criterion for r in left.collect()] == ["a"]


def test_local_frames_have_a_known_size(spark):
    frame = local_frame(spark, [(1, "a"), (2, None)], "i int, s string")
    assert frame.collect() == [(1, "a"), (2, None)]
    assert "LocalTableScan" in frame._jdf.queryExecution().executedPlan().toString()
