"""The pipeline against its stages done one by one."""

import corpus_pipeline
from tidemill.llm import minhash, mixing, toxicity
from tidemill.session import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = {r.doc_id for r in toxicity.classify(before, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["near_dedup"]
    groups = minhash.near_duplicates(before).filter("kept").collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in groups} and after.count() == len(groups)
    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    before, after = kept["packing"]
    assert after.filter("piece = 0").count() == before.count()
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.count() == after.count() and again.columns == after.columns


def test_empty_documents(spark, sf_dir, tmp_path):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_odd_documents(spark, sf_dir):
    """Null texts, repeated ids, rows without id and clashing columns go through every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    wanted = docs.schema.add("_row", "string").add("gone", "string").add("_toxicity", "double").add("_id", "long")
    rows = [tuple(r) + ("a", "b", 1.0, 2) for r in docs.collect()]
    first = rows[0]
    rows += [first, (first[0], None, *first[2:]), (None, *first[1:]), (10**9, "", *first[2:]), (10**9 + 1, None, *first[2:])]
    docs = spark.createDataFrame(rows, wanted)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        assert name == "packing" or docs.columns == before.columns
    assert docs.count() > 0


def test_names_with_dots(spark, sf_dir):
    """Columns whose names hold dots, back-ticks and spaces go through every stage as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    names = ["a.b", "doc_id.x", "b`c", "d e", "*", "_row.text"]
    docs = docs.toDF(*docs.columns)
    for k, name in enumerate(names):
        docs = docs.withColumns({name: docs.doc_id + k})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns
    rows = docs.collect()
    assert rows and all(tuple(r)[-len(names) :] == tuple(r.doc_id + k for k in range(len(names))) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)
