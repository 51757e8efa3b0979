"""The registered queries over the given tables: against SQL, held-out labels and brute force."""

import numpy as np
import pytest

from millrace.llm import line_crf, queries, site_quality
from tests.compare import of_duck, of_spark

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert of_spark(queries.queries()[name](spark, SMALL)) == of_duck(duck, queries.oracle_sql()[name])


def test_classifiers_on_held_out_labels(spark):
    """Fitted on sf0.01, measured on documents of sf0.1 that aren't in it."""
    folder = "/root/testdata/{}"
    docs, labels = (spark.read.parquet(f"{folder.format('sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    other, truth = (spark.read.parquet(f"{folder.format('sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = other.join(truth, "doc_id").where("doc_id >= 1000").select("text", "quality").limit(1500).collect()
    y = np.array([r["quality"] for r in rows])
    w, mean, dev = site_quality.train(docs, labels)
    p = (np.array([site_quality.features(r["text"].encode()) for r in rows]) - mean) / dev @ w > 0
    assert (p[y == 1]).mean() > 0.97 and (~p[y == 0]).mean() > 0.9
    weights, transitions = line_crf.train(docs, labels)
    keeps = []
    for r in rows:
        lines, features, _ = line_crf.lines_of(r["text"].encode())
        path = line_crf.viterbi(features @ weights, transitions)
        keeps.append(sum(len(x) for x, s in zip(lines, path) if not s) * 2 >= sum(map(len, lines)))
    keeps = np.array(keeps)
    assert keeps[y == 1].mean() > 0.97 and (~keeps[y == 0]).mean() > 0.9


def test_site_evidence_matters(spark):
    """A doubtful document of a good site ranks above the same document of a bad one."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = site_quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good, bad = "A good line of plain words stands here and goes on for a while. " * 5, "BUY!! NOW!! CHEAP!! PILLS!! " * 12
    rows = [(i, good, "g") for i in range(40)] + [(100 + i, bad, "b") for i in range(40)] + [(200, "Half a text", "g"), (201, "Half a text", "b")]
    out = {r["doc_id"]: r for r in site_quality.classify(spark.createDataFrame(rows, "doc_id long, text string, source string"), model, F.col("source"), F.lit("x")).collect()}
    assert out[200]["doc_prob"] == out[201]["doc_prob"] and out[200]["path_prior"] > out[201]["path_prior"] and out[200]["quality"] > out[201]["quality"]
