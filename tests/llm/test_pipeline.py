"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
import pytest
from llm_brute import contained, linked, ordered, removed_bytes
from punctua.llm import ORACLES, QUERIES, quality

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "suffix-array dedup",
        "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, outputs = docs.columns, [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outputs.append(docs)
        assert k == 4 or docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.scored(inputs[0], labels).where("predicted = 1")
    assert ordered(r[:1] for r in outputs[0].collect()) == ordered(r[:1] for r in scored.collect())
    rows = pairs(inputs[1])
    want = [(i, t) for (i, t), r in zip(rows, linked(rows, 5, 80)) if r[2] == i]
    assert ordered(pairs(outputs[1])) == ordered(want)
    rows = pairs(inputs[2])
    lost = {r[0]: (r[1], r[2]) for r in removed_bytes(rows)}
    kept = dict(pairs(outputs[2]))
    assert set(kept) == {i for i, (n, gone) in lost.items() if not n or gone < n} and all(
        (kept[i] == t) == (lost[i][1] == 0) for i, t in rows if i in kept)
    assert outputs[2].where("n_chars <> length(text)").count() == 0
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = pairs(inputs[3])
    hit = {i for i, *_ in contained(rows, items)}
    assert ordered(pairs(outputs[3])) == ordered(r for r in rows if r[0] not in hit)
    packed = outputs[4].toPandas()
    assert set(packed.doc_id) == {i for i, _ in pairs(inputs[4])}
    assert packed.n_words.sum() == sum(len((t or "").encode().split()) for _, t in pairs(inputs[4]))
    assert packed.groupby("bin_id").n_words.sum().max() <= 2048


def test_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, message
