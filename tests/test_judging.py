"""Model verdicts of tables and streams: retries, restarts, missing answers."""

import os

import pytest
from pyspark.sql import functions as F

from labelloom.operators.labeling import LabelingFunction, LabelingSet, request_chunks
from labelloom.sizing import local_frame
from labelloom.streaming.judging import JudgedStream, judge

LFS = LabelingSet(tuple(LabelingFunction(i, c, c, i % 2) for i, c in enumerate("abcd")))
ITEMS = "item_id bigint, text string, tag string"
# item, text (the letters it names), tag
ROWS = [(i, t, f"t{i}") for i, t in enumerate(["ab", "cd", "abcd", "", None, "x", "once a", "never a", "silent b", "once silent d", "broken c", "ab"])]


def chunks(spark):
    listed = local_frame(spark, [(f.lf, f.criterion, f.description, None) for f in LFS.functions], "ord bigint, criterion string, description string, class string")
    return request_chunks(listed, None, 2)


def model_of(calls=None, path=None):
    """Names the letters a-d of its chunk; words in a text say how it fails. Requests are noted in ``path``."""

    def answer(requests):
        if calls is not None:
            calls.append(1)
        if path is not None:
            requests.select("item_id", "chunk", "attempt").write.mode("append").parquet(path)
        text = F.coalesce("text", F.lit(""))
        first = F.col("attempt") == 0
        names = [F.when(F.contains(F.substring_index(text, " ", -1), F.lit(f.criterion)) & (F.col("chunk") == f.lf // 2), F.lit(f.criterion)) for f in LFS.functions]
        unknown = F.when(text == "x", F.lit("unheard of"))
        found = F.to_json(F.struct(F.array_compact(F.array(*names, unknown)).alias("found_criteria")))
        once = text.startswith("once a") & first
        never = text.startswith("never") & (F.col("chunk") == 1)
        silent = text.contains("silent") & (first | ~text.startswith("once"))
        content = F.when(text.startswith("broken"), F.lit("no object")).otherwise(F.concat(F.lit("Sure: "), found))
        return requests.filter(~silent).select("item_id", "chunk", content.alias("content"), (once | never).alias("failed"))

    return answer


WANT = {0: [0, 1], 1: [2, 3], 2: [0, 1, 2, 3], 3: None, 4: None, 5: [], 6: [0], 7: None, 8: None, 9: [3], 10: None, 11: [0, 1]}


def got(ballots):
    rows = ballots.collect()
    assert len({r.item_id for r in rows}) == len(rows) and all(r.tag == f"t{r.item_id}" for r in rows)
    return {r.item_id: r.fired for r in rows}


def test_table_is_asked_twice_at_most(spark):
    calls = []
    items = local_frame(spark, ROWS, ITEMS)
    assert got(judge(items, LFS, chunks(spark), model_of(calls), ("tag",))) == WANT
    assert len(calls) == 2


def test_unreadable_answers_may_add_nothing(spark):
    items = local_frame(spark, [(0, "broken a", "t0"), (1, "b", "t1")], ITEMS)
    assert got(judge(items, LFS, chunks(spark), model_of(), ("tag",), "skip")) == {0: None, 1: [1]}
    with pytest.raises(ValueError):
        judge(items, LFS, chunks(spark), model_of(), ("tag",), "perhaps")


def test_edges(spark):
    items = local_frame(spark, ROWS, ITEMS)
    assert judge(items.limit(0), LFS, chunks(spark), model_of(), ("tag",)).isEmpty()
    assert set(got(judge(items, LabelingSet(()), [], model_of(), ("tag",))).values()) == {None}
    twice = judge(items.union(items), LFS, chunks(spark), model_of())
    assert sorted((r.item_id, str(r.fired)) for r in twice.collect()) == sorted((i, str(f)) for i, f in WANT.items() for _ in (0, 1))
    with pytest.raises(Exception, match="item_id is null"):
        judge(local_frame(spark, [(None, "a", "t")], ITEMS), LFS, chunks(spark), model_of()).collect()
    with pytest.raises(ValueError):
        judge(items.withColumnRenamed("tag", "open"), LFS, chunks(spark), model_of(), ("open",))


def stream(spark, folder):
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_restarted_between_batches_equals_table(spark, tmp_path):
    source, out, asked = (str(tmp_path / n) for n in ("in", "out", "asked"))
    items = local_frame(spark, ROWS, ITEMS)
    model = model_of(path=asked)
    for part in range(3):
        # one file a batch, two batches a run
        items.filter(F.col("item_id") % 3 == part).repartition(2, "item_id").write.mode("append").parquet(source)
        ballots = JudgedStream(out, LFS, chunks(spark), model, ("tag",)).run(stream(spark, source))
    assert got(ballots) == WANT
    # nothing new: nothing is asked, nothing is stored
    n = spark.read.parquet(asked).count()
    assert got(JudgedStream(out, LFS, chunks(spark), model, ("tag",)).run(stream(spark, source))) == WANT
    requests = spark.read.parquet(asked)
    assert requests.count() == n and requests.distinct().count() == n and requests.agg(F.max("attempt")).first()[0] == 1
    assert os.listdir(f"{out}/asked") == []
    other = LabelingSet(LFS.functions[:2])
    with pytest.raises(ValueError, match="other criteria"):
        JudgedStream(out, other, chunks(spark), model, ("tag",)).run(stream(spark, source))


@pytest.mark.parametrize("step", ["waiting", "ended"])
def test_batch_that_broke_off_is_run_again(spark, tmp_path, monkeypatch, step):
    """A driver lost after asking: the batch is run again, its requests are not sent again."""
    from labelloom.streaming import judging

    source, out, asked = (str(tmp_path / n) for n in ("in", "out", "asked"))
    local_frame(spark, ROWS, ITEMS).repartition(2, "item_id").write.parquet(source)
    model = model_of(path=asked)
    kept, state = getattr(judging, step), {"left": 2}

    def breaks(*args):
        state["left"] -= 1
        if state["left"] == 0:
            raise RuntimeError("lost")
        return kept(*args)

    monkeypatch.setattr(judging, step, breaks)
    with pytest.raises(Exception, match="lost"):
        JudgedStream(out, LFS, chunks(spark), model, ("tag",)).run(stream(spark, source))
    ballots = JudgedStream(out, LFS, chunks(spark), model, ("tag",)).run(stream(spark, source))
    assert got(ballots) == WANT
    requests = spark.read.parquet(asked)
    assert requests.distinct().count() == requests.count()


def test_last_round_that_broke_off_is_taken_over(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    items = local_frame(spark, ROWS, ITEMS)
    items.filter("item_id < 8").repartition(1).write.parquet(source)
    monkeypatch.setattr(JudgedStream, "_run_dry", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        JudgedStream(out, LFS, chunks(spark), model_of(), ("tag",)).run(stream(spark, source))
    monkeypatch.undo()
    items.filter("item_id >= 8").repartition(1).write.mode("append").parquet(source)
    assert got(JudgedStream(out, LFS, chunks(spark), model_of(), ("tag",)).run(stream(spark, source))) == WANT


def test_texts_move_only_for_a_second_try(spark):
    from labelloom.streaming.judging import ask, fresh_items

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fresh = fresh_items(docs.select(F.col("doc_id").alias("item_id"), "text"), 2)
    asked = ask(fresh, LFS, chunks(spark), model_of(), (), "fail")
    plan = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = {n.split("\n")[0]: n for n in plan.split("\n\n") if n.startswith("(")}
    moved = [n for head, n in nodes.items() if " Exchange" in head]
    assert moved and not any("text#" in n for n in moved)
