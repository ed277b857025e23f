"""Components against union-find, and the key filter against a semi join."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.llm import common
from auditloom.llm.common import components, with_keys


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    edges = [(i, i + 1) for i in range(0, 40)] + [(500 - i, 3 if i % 2 else 400) for i in range(60)]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([40, 150]))] + [(9, 9), (7, 8), (8, 7)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for x in top:
        least[find(x)] = min(x, least.get(find(x), x))
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert out == {x: least[find(x)] for x in used}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_with_keys(spark):
    df = spark.range(-500, 500).select(F.xxhash64("id").alias("k"), "id")
    keys = df.where("id % 7 = 0").select("k").union(df.where("id = 0").select("k"))
    assert sorted(r.id for r in with_keys(df, "k", keys).collect()) == [i for i in range(-500, 500) if i % 7 == 0]
    assert with_keys(df, "k", keys.limit(0)).collect() == []


def test_staged_rows_leave_no_shuffle_files(spark):
    """What is staged is whole, so the shuffles behind it are dropped at once, not by garbage collection."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = held()
    out = common.staged(spark.range(10_000).repartition(4, "id").groupBy("id").count(), "rows")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert out.count() == 10_000 and spark.conf.get(common.SHUFFLE_CLEANUP) == "false"


def test_staged_steps_get_batches_of_bounded_bytes(spark):
    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "b"])

    before = spark.conf.get(common.ARROW_BYTES)
    texts = spark.range(0, 5_000, 1, 1).selectExpr("repeat('x', 2000) as text")
    rows = common.staged(texts.mapInArrow(told, "n long, b long"), "told").collect()
    assert sum(r.n for r in rows) == 5_000
    assert max(r.b for r in rows) <= common.BATCH_BYTES + 4_096
    assert spark.conf.get(common.ARROW_BYTES) == before
