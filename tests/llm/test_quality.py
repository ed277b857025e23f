"""Held-out accuracy, odd rows, and a model without labels."""

import os

import pytest
from pyspark.sql import functions as F

from auditloom.llm import quality
from auditloom.llm.common import folds

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.scored(docs.where(folds()), quality.fit(docs, labels.where(~folds())))
    right = found.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("double")).alias("right"))
    assert all(r.right > 0.9 for r in right.collect())


def test_odd_rows(spark):
    texts = [None, "", " \n", "good plain words here", "BAD!! BAD!! BAD!!", "BAD!! BAD!! BAD!!", "x " * 60_000]
    docs = spark.createDataFrame([(i, t, 9.0, 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, score double, quality int")
    train = spark.createDataFrame(
        [(100 + i, "some good plain words" if i % 2 else "BAD!! VERY!! BAD!!") for i in range(40)] + [(None, "x")],
        "doc_id long, text string")
    rows = [(100 + i, i % 2) for i in range(40)] + [(101, 1), (101, None), (5000, 1), (None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    out = quality.scored(docs, quality.fit(train, labels)).orderBy("doc_id").collect()
    score = [r.score for r in out]
    assert score[0] == score[1] == score[2] and 0 <= min(score) and max(score) <= 1
    assert score[3] > 0.9 and score[4] == score[5] < 0.1
    assert quality.scored(docs.limit(0), quality.fit(train, labels)).collect() == []
    unlabelled = quality.fit(train, labels.limit(0))
    assert {r.score for r in quality.scored(docs, unlabelled).collect()} == {0.5}
