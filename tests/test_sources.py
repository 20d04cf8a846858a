import json

import pytest
from pyspark.sql import functions as F

from labelloom.functions.text import int_or_text
from labelloom.operators import criteria
from labelloom.operators.labeling import keyword_ballots, labeling_set, verdicts
from labelloom.operators.classes import ClassList
from labelloom.sources import readers, writers


def test_keyed_json_file(spark, tmp_path):
    objects = {
        "3": {"data": {"text": "a, \"b\""}, "label": 4, "weak_labels": [1, -1]},
        "0": {"label": "x"},
        "10": {"data": {}, "label": None},
        "7": {"data": {"text": "ü"}, "label": "07"},
    }
    want = {3: ('a, "b"', "4", [1, -1]), 0: (None, "x", None), 10: (None, None, None), 7: ("ü", "7", None)}
    for indent in (None, 2):
        path = tmp_path / f"split{indent}.json"
        path.write_text(json.dumps(objects, indent=indent), encoding="utf-8")
        rows = readers.read_keyed_json(spark, str(path), pretty_printed=indent is not None).collect()
        assert {r.item_id: (r.text, r.label, r.weak_labels) for r in rows} == want
    with pytest.raises(Exception, match="not a keyed JSON object"):
        readers.read_keyed_json(spark, str(tmp_path / "split2.json")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_keyed_json(spark, str(tmp_path / "missing.json")).collect()


def test_keyed_json_round_trip(spark, tmp_path):
    items = spark.createDataFrame(
        [(i, f"text {i}\nline", str(i % 3)) for i in range(25)], "item_id bigint, text string, label string"
    )
    writers.write_keyed_json(items, str(tmp_path / "out"), entries_per_line=10)
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    back = readers.read_keyed_json(spark, str(tmp_path / "out")).select("item_id", "text", "label")
    assert sorted(back.collect()) == sorted(items.collect())


def test_tolerant_lines(spark, tmp_path):
    lines = [
        '{"t": "missing flag"}', '{"t": "null flag", "f": null}', '{"t": "one", "f": 1}', '{"t": "text one", "f": " 1 "}',
        '{"t": "text 1.5", "f": "1.5"}', '{"t": "cut", "f": 1.7}', '{"t": "yes", "f": true}', '{"t": "no", "f": false}',
        '{"t": "word", "f": "often"}', "", "   ", "{broken", "[1]", "5", '{"f": 3}', '{"t": "list", "f": [1]}',
        '{"t": "negative", "f": -2.9}',
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    got = {r.text: r.label for r in readers.read_tolerant_jsonl(spark, str(path), "t", "f").collect()}
    expected = {}
    for line in lines:
        try:
            item = json.loads(line)
            expected[item.get("t")] = int(item.get("f", 0))
        except (ValueError, TypeError, AttributeError):
            continue
    assert got == expected


def test_criteria_file_order(spark, tmp_path):
    rows = [{"criterion": f"c{i}", "description": "d", "class": str(i % 3)} for i in range(30)]
    path = tmp_path / "criteria.jsonl"
    path.write_text("\n".join(json.dumps(r) + ("\n" if i % 5 == 0 else "") for i, r in enumerate(rows)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        table = readers.read_criteria(spark, str(path))
        assert table.rdd.getNumPartitions() > 2
        assert [r.criterion for r in table.orderBy("ord").collect()] == [r["criterion"] for r in rows]
        assert table.select("ord").distinct().count() == 30
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_criteria_last_row_wins(spark):
    table = spark.createDataFrame(
        [(0, "a", "x", "1"), (1, "b", "y", "cls"), (2, "a", "z", "08"), (3, "c", None, None)],
        "ord bigint, criterion string, description string, class string",
    )
    got = [tuple(r) for r in criteria.last_wins(table).orderBy("ord").collect()]
    assert got == [(0, "a", "z", "8"), (1, "b", "y", "cls"), (3, "c", None, None)]


def test_accumulate_cap_and_dedup(spark):
    schema = "ord bigint, criterion string, description string, class string"
    old = spark.createDataFrame([(0, "a", "", "0"), (9, "b", "", "0")], schema)
    new = spark.createDataFrame([(i, f"n{i}", "", "1") for i in range(8)], schema)
    both = [r.criterion for r in criteria.accumulate(old, new).orderBy("ord").collect()]
    assert both == ["a", "b"] + [f"n{i}" for i in range(8)]
    assert criteria.accumulate(old.limit(0), new).count() == 8
    assert criteria.cap_new(old, new, 10).count() == 8
    assert criteria.cap_new(old, new, 5).count() == 3
    assert sorted(criteria.cap_new(old, new, 5, 1).collect()) == sorted(criteria.cap_new(old, new.repartition(3), 5, 1).collect())
    assert criteria.cap_new(old, new, 2).count() == 0
    with pytest.raises(ValueError):
        criteria.cap_new(old, new, 1)
    answer = spark.createDataFrame([('ok {"unique_criteria": ["n3", "a", "zz"]}',)], "content string")
    assert sorted(r.criterion for r in criteria.keep_unique(criteria.accumulate(old, new), answer).collect()) == ["a", "n3"]
    raw_break = spark.createDataFrame([('{"unique_criteria": ["n3"], "why": "a\tb\nc"}',)], "content string")
    assert [r.criterion for r in criteria.keep_unique(new, raw_break).collect()] == ["n3"]
    for broken in ('{"unique_criteria": ["n3"', "nothing", None):
        unread = spark.createDataFrame([(broken,)], "content string")
        assert criteria.keep_unique(new, unread).count() == new.count()


def test_malformed_criteria_line_raises(spark):
    lines = spark.createDataFrame([(0, '{"criterion": "a", "description": "b", "class": 1}'), (1, " "), (2, "{broken")], "ord long, value string")
    assert readers.parse_criteria(lines.filter("ord < 2"), F.col("ord")).count() == 1
    with pytest.raises(Exception, match="broken"):
        readers.parse_criteria(lines, F.col("ord")).collect()


def test_generated_criteria(spark):
    good = '{"criteria": [{"criterion": "p", "description": "x+y", "class": "1"}, {"criterion": "q", "description": "z", "class": "1"}]}'
    answers = spark.createDataFrame(
        [(1, f"```{good}```", False), (0, '{"criteria": [{"criterion": "o", "description": "w", "class": "0"}]}', False), (2, good, True), (3, "?", False)],
        "request_no int, content string, failed boolean",
    )
    assert [r.criterion for r in criteria.ingest_generated(answers).orderBy("ord").collect()] == ["o", "p", "q"]


def test_verdict_file(spark, tmp_path):
    items = spark.createDataFrame([(5, "a cat"), (1, "dog"), (2, None)], "item_id bigint, text string")
    rules = spark.createDataFrame(
        [(0, "text", "cat", "0"), (1, "index", "dog", "1")], "ord bigint, criterion string, description string, class string"
    )
    lfs = labeling_set(rules, ClassList(("0", "1")))
    table = verdicts(keyword_ballots(items, lfs, keep=("text",)), lfs, keep=("text",))
    path = str(tmp_path / "v")
    writers.append_verdicts(table.filter("item_id = 5"), path)
    writers.append_verdicts(table.filter("item_id <> 5"), path)
    back = readers.read_verdicts(spark, path)
    assert {(r.item_id, r.text) for r in back.collect()} == {(5, "a cat"), (1, "dog"), (2, None)}
    flat = {(r.item_id, r.criterion): r.hit for r in readers.flatten_verdicts(back).collect()}
    assert flat[5, "text"] is True and flat[1, "index"] is True and flat[2, "text"] is False
    lines = spark.createDataFrame([('{"index": 3, "text": "x", "labels": {"a": null, "b": true}}',)], "value string")
    flat = {r.criterion: r.hit for r in readers.flatten_verdicts(readers.parse_verdicts(lines)).collect()}
    assert flat == {"a": None, "b": True}


def test_samples_and_domain(spark, tmp_path):
    table = spark.createDataFrame([(2, "q", "b", 1), (1, "p", "a", 0)], "id bigint, utterance string, extra string, intent int")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "class_idx int, class_name string")
    got = readers.load_samples(table, "id", 1, names).collect()
    assert [tuple(r) for r in got] == [(1, "p", "zero")]
    assert readers.load_samples(table, "id", create_empty=True).count() == 0
    assert readers.resolve_columns(table.select("extra", "id")) == ("extra", "id")
    for info, want in (("", None), ("banks", "banks")):
        path = tmp_path / f"{info or 'none'}.json"
        path.write_text(json.dumps({"domain_info": info}))
        assert readers.read_domain_info(spark, str(path)) == want


def test_csv_and_vote_matrix_files(spark, tmp_path):
    preds = spark.createDataFrame([(0, 'a, "quoted"\nline', 1, -1)], "idx bigint, text string, label int, pred int")
    writers.write_csv(preds, str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), header=True, escape='"', multiLine=True, schema=preds.schema)
    assert back.collect() == preds.collect()
    votes = spark.createDataFrame([(0, [(1, 2)]), (1, [])], "item_id bigint, votes array<struct<lf:int,c:int>>")
    writers.write_vote_matrix(votes, ["a b", "c"], str(tmp_path / "m"))
    assert sorted(json.loads(r.value)["c"] for r in spark.read.text(str(tmp_path / "m")).collect()) == [-1, 2]
    splits = spark.createDataFrame([(0, "t", "1", "dev")], "item_id bigint, text string, label string, split string")
    writers.write_splits(splits, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'dev'").count() == 1


def test_int_or_text(spark):
    rows = spark.createDataFrame([("07",), ("x1",), ("7.5",), ("-3",), (None,)], "s string")
    assert [r[0] for r in rows.select(int_or_text(F.col("s"))).collect()] == ["7", "x1", "7.5", "-3", None]
