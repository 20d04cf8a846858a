import json

import pytest
from pyspark.sql import functions as F

import verify
from labelloom.operators import endmodel, generation
from labelloom.operators.classes import ClassList, class_list
from labelloom.operators.labeling import answer_schema, keyword_ballots, labeling_set, verdicts
from labelloom.plans.documents import documents, language_criteria, table
from labelloom.plans.experiments import Experiment, next_experiment_number
from labelloom.plans.iterate import RunConfig, run_experiment
from labelloom.session import checkpoint_root, scratch_table
from labelloom.plans.standalone import label_table, write_criteria
from labelloom.sources.readers import flatten_verdicts, read_criteria, read_verdicts
from labelloom.streaming.labelling import append_stream, label_stream, remaining, text_stream


def test_every_query_equals_its_sql(spark, small_tables):
    results = verify.compare(spark, small_tables)
    assert not {n: r for n, r in results.items() if not r.startswith(("ok", "rows only"))}


def test_experiment_numbers_and_stages(spark, tmp_path):
    names = spark.createDataFrame([("exp_9",), ("exp_10",), ("exp_x",), ("other",)], "name string")
    assert next_experiment_number(names).first()[0] == 11
    assert next_experiment_number(names.limit(0)).first()[0] == 1
    first = Experiment.begin(spark, str(tmp_path), "d", {"a": 1})
    second = Experiment.begin(spark, str(tmp_path), "d", RunConfig("d"))
    assert first.path.endswith("/d/exp_1") and second.path.endswith("/d/exp_2")
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    assert first.stage(0, "s", make).count() == first.stage(0, "s", make).count() == 3
    assert len(calls) == 1
    assert Experiment.resume(spark, str(tmp_path), "d", 1).stage(0, "s", make).count() == 3 and len(calls) == 1


def test_scratch_tables_go_away(spark):
    import os

    with scratch_table(spark.range(5), "t") as t:
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    assert checkpoint_root(spark) == checkpoint_root(spark)


def judged_fixture(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], "wrong" if i < 6 else "correct") for i in range(10)]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string, label string, outcome string")


def test_generation_context(spark):
    rows, judged = judged_fixture(spark)
    fragments = generation.context_fragments(judged, ids_per_fragment=4)
    for label in "ab":
        for outcome in ("wrong", "correct"):
            parts = fragments.filter((F.col("label") == label) & (F.col("outcome") == outcome)).orderBy("fragment").collect()
            joined = "\n\n".join(p.body for p in parts)
            assert joined == "\n\n".join(t for _, t, lab, out in rows if lab == label and out == outcome)
            assert all(p.n_texts <= 4 for p in parts)
    sizes = {r.label: r for r in generation.context_sizes(judged).collect()}
    assert (sizes["a"].n_positive, sizes["a"].n_correct, sizes["a"].n_negative) == (3, 2, 5)


def test_generation_requests(spark):
    rows, judged = judged_fixture(spark)
    existing = spark.createDataFrame([(0, "old", "x+y")], "ord bigint, criterion string, description string")
    requests = generation.generation_requests(judged, "demo", 2, existing, "about tests").orderBy("request_no").collect()
    assert [r.label for r in requests] == ["a", "b"]
    prompt = requests[0].prompt
    cover, covered, avoid = (prompt.index(f"## Texts {t}") for t in ("to cover", "already covered", "to avoid"))
    assert cover < covered < avoid < prompt.index("## Existing criteria")
    assert "\n\n".join(["text 0", "text 2", "text 4"]) in prompt[cover:covered]
    assert "\n\n".join(["text 1", "text 3", "text 5", "text 7", "text 9"]) in prompt[avoid:]
    assert json.dumps({"old": "x+y"}, indent=2) in prompt and "about tests" in prompt
    bare = generation.generation_requests(judged.filter("outcome = 'wrong'"), "demo").first().prompt
    assert "already covered" not in bare and "Existing" not in bare and "Domain" not in bare
    with pytest.raises(ValueError):
        generation.generation_requests(judged, "demo", max_chars=10)
    twice = existing.union(existing.selectExpr("1", "criterion", "'z'"))
    listed = [{"criterion": "old", "description": "x+y"}, {"criterion": "old", "description": "z"}]
    assert json.dumps(listed, indent=2) in generation.dedup_request(twice).first().prompt


def test_stream_equals_batch_and_resumes(spark, small_tables, tmp_path):
    docs = table(spark, small_tables, "documents")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lfs = labeling_set(language_criteria(spark), class_list(documents(spark, small_tables)))

    def run():
        items = text_stream(spark, source, docs.schema, files_per_batch=1).select(F.col("doc_id").alias("item_id"), "text")
        append_stream(label_stream(items, lfs), out, state).awaitTermination()
        return flatten_verdicts(spark.read.parquet(out))

    docs.filter("doc_id % 2 = 0").repartition(2).write.parquet(source)
    first = run().count()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(source)
    second = run()
    assert run().count() == second.count() == 2 * first
    batch = flatten_verdicts(verdicts(keyword_ballots(documents(spark, small_tables), lfs), lfs))
    assert second.exceptAll(batch).isEmpty() and batch.exceptAll(second).isEmpty()
    done = spark.read.parquet(out)
    assert remaining(documents(spark, small_tables), done).isEmpty()
    assert remaining(documents(spark, small_tables), done.filter("item_id < 10")).count() == docs.count() - 10


def test_whole_loop(spark, small_tables, tmp_path):
    docs = documents(spark, small_tables)
    splits = docs.withColumn(
        "split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("item_id") % 3 + 1).cast("int"))
    )
    seen = []

    def generate(requests):
        seen.append([r.prompt for r in requests.collect()])
        known = language_criteria(spark).select("criterion", "description", "class")
        if len(seen) > 1:
            # one new criterion for each class asked for
            known = requests.select(
                F.concat(F.lit("again "), "label").alias("criterion"), F.lit("qqq").alias("description"), F.col("label").alias("class")
            )
        packed = known.groupBy("class").agg(F.collect_list(F.struct("criterion", "description", "class")).alias("criteria"))
        return requests.join(packed, F.col("label") == F.col("class")).select(
            "request_no", F.to_json(F.struct("criteria")).alias("content"), F.lit(False).alias("failed")
        )

    config = RunConfig("documents", max_iter=2, dawid_skene=True)
    experiment = Experiment.begin(spark, str(tmp_path), "documents", config)
    results = run_experiment(experiment, splits, config, generate)
    assert len(results) == 2 and len(seen) == 2
    scores = {(r.model, r.split): r.f1 for r in results[0].metrics.collect()}
    assert set(scores) == {
        ("majority_vote", "test"), ("majority_vote", "dev"), ("label_model", "test"), ("label_model", "dev"),
        ("dawid_skene", "test"), ("dawid_skene", "dev"), ("end_model", "test"),
    }
    assert scores["majority_vote", "test"] > 0.8
    names = {r.criterion for r in results[0].summary.filter("emp_acc > 0.5").collect()}
    assert "en_nothing" not in names and "en_the" in names
    assert results[0].judged.count() == splits.filter("split = 'dev'").count()
    # the second round is shown the errors of the first and keeps its criteria
    wrong = results[0].judged.filter("outcome = 'wrong'").count()
    assert wrong > 0 and all("Texts already covered" in p or "Texts to avoid" in p for p in seen[1])
    names = [r.criterion for r in results[1].criteria.orderBy("ord").collect()]
    assert len(names) > 16 and names[:16] == [r.criterion for r in results[0].criteria.orderBy("ord").collect()]
    assert all(n.startswith("again ") for n in names[16:])
    # a second run over the same folder computes nothing anew
    again = run_experiment(experiment, splits, config, generate)
    assert len(seen) == 2 and again[1].metrics.count() == results[1].metrics.count()
    stored = read_criteria(spark, experiment.stage_path(1, "export/criteria"))
    assert [r.criterion for r in stored.orderBy("ord").collect()] == names
    exported = spark.read.csv(experiment.stage_path(0, "export/predictions"), header=True, escape='"', multiLine=True)
    assert exported.count() == results[0].predictions.count()


def test_end_models(spark, small_tables):
    items = documents(spark, small_tables)
    runs = endmodel.supervised_baseline(items, class_list(items), 80, runs=2)
    assert [r.run for r in runs.orderBy("run").collect()] == [0, 1] and runs.agg(F.min("acc")).first()[0] > 0.7
    indexed = items.withColumn("label_idx", (F.col("label") == "en").cast("int"))
    own = endmodel.validation_scores(indexed, "label_idx", options=endmodel.EndModelOptions(algorithm="logistic_regression", max_iter=5))
    assert own.first().acc > 0.7
    with pytest.raises(ValueError):
        endmodel.text_pipeline(endmodel.EndModelOptions(algorithm="other"), "x")
    assert len(ClassList(("a",))) == 1


def test_label_table_resumes_by_id(spark, small_tables, tmp_path):
    docs, out = documents(spark, small_tables), str(tmp_path / "verdicts")
    criteria = language_criteria(spark)
    assert label_table(spark, docs.filter("item_id >= 150"), criteria, out) == 50
    assert label_table(spark, docs, criteria, out) == 150
    assert label_table(spark, docs, criteria, out) == 0
    stored = read_verdicts(spark, out)
    assert stored.count() == 200 and stored.select("item_id").distinct().count() == 200


def test_write_criteria(spark):
    samples = spark.createDataFrame([(0, "p", "a"), (1, "q", "b")], "item_id bigint, text string, label string")
    schema = "ord bigint, criterion string, description string, class string"
    existing = spark.createDataFrame([(0, "old", "x", "a")], schema)

    def generate(requests):
        one = F.struct(F.concat(F.lit("new "), "label").alias("criterion"), F.lit("d").alias("description"), F.col("label").alias("class"))
        return requests.select("request_no", F.to_json(F.struct(F.array(one).alias("criteria"))).alias("content"), F.lit(False).alias("failed"))

    def dedup(request):
        return request.select(F.lit('{"unique_criteria": ["old", "new b"]}').alias("content"))

    got = write_criteria(samples, "demo", generate, dedup, existing)
    assert [r.criterion for r in got.orderBy("ord").collect()] == ["old", "new b"]
    assert write_criteria(samples, "demo", generate).count() == 2
    assert generation.CRITERIA_SCHEMA["required"] == ["criteria"]
    lfs = labeling_set(existing, ClassList(("a",)))
    assert answer_schema(lfs)["properties"]["found_criteria"]["items"]["enum"] == ["old"]


def test_colliding_ids_are_numbered_by_ranges(spark, small_tables):
    from labelloom.plans import catalog

    df = catalog.prepare_colliding_ids(spark, small_tables)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(item_id" not in plan
    parts = {}
    for r in df.collect():
        parts.setdefault(r.old_split, []).append((r.real_id, r.old_id))
    for rows in parts.values():
        assert [n for _, n in sorted(rows)] == sorted(n for _, n in rows)
