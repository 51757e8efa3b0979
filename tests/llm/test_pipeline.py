"""The pipeline, stage by stage on its own input."""

import pytest

import corpus_pipeline
from millrace.llm import line_crf, mixing, partenum

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SMALL).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns_and_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "mixing", "tokens"]
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_each_stage_does_its_part(spark, stages):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    (raw, ruled), (_, good), (_, single), (_, mixed), (_, tokens) = stages
    weights, transitions = line_crf.train(raw, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(ruled) == ids(line_crf.judge_lines(raw, weights, transitions).where("kept"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = set(ids(ruled)) - set(ids(good))
    assert set(ids(good)) <= set(ids(ruled)) and sum(labels.get(i, 0) for i in gone) <= 0.02 * ruled.count()
    found = partenum.near_duplicates(good).collect()
    assert ids(single) == sorted({r["component_id"] for r in found})
    assert mixed.count() == sum(r["copies"] for r in mixing.systematic_mix(single).collect()) and set(ids(mixed)) <= set(ids(single))
    assert ids(tokens) == ids(mixed) and all(len(r["ids"]) == r["n_tokens"] for r in tokens.collect())


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).drop("ids").collect())) == sorted(map(tuple, stages[-1][1].drop("ids").collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SMALL).count() == 0
