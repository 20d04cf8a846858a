from collections import Counter

import corpus_pipeline
from labelloom.llm import lines, mixing, ngram_join, toxicity
from labelloom.llm.common import stored


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_follow_each_other(spark, small_tables, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, small_tables), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = rows_of(docs), rows_of(out)
        if name == "toxicity":
            labels = spark.read.parquet(f"{small_tables}/labels.parquet")
            assert after == rows_of(toxicity.drop_toxic(docs, labels)) and not after - before
            assert 0 < sum(before.values()) - sum(after.values()) < 0.25 * sum(before.values())
        elif name == "line dedup":
            assert after == rows_of(lines.drop_shared_lines(docs))
            assert sorted(i for i, _ in before.elements()) == sorted(i for i, _ in after.elements())
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "n-gram Jaccard join":
            kept = {r.doc_id for r in ngram_join.near_duplicates(docs).collect() if r.kept}
            assert {i for i, _ in after} == kept and not after - before
        else:
            taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert {i: n for (i, _), n in after.items()} == {i: n for i, n in taken.items() if n}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small_tables).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows_of(docs)}


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(0, 0), (4, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), "test")
