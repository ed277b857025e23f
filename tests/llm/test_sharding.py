"""Shards against the same draws in plain Python, and the law of growth."""

import math
import random
import struct

import xxhash

from auditloom.llm import sharding


def draw(key, path, weight):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    bits = xxhash.xxh64_intdigest(path.encode(), seed=h) >> 11
    return -math.log((bits + 0.5) / 2.0**53) / weight


def brute(key, tree):
    key = -(1 << 63) if key is None else key
    total = lambda shards: sum(shards.values())
    region = min(tree, key=lambda r: draw(key, f"region/{r}", sum(map(total, tree[r].values()))))
    rack = min(tree[region], key=lambda k: draw(key, f"rack/{region}/{k}", total(tree[region][k])))
    shards = tree[region][rack]
    return min(shards, key=lambda s: draw(key, f"shard/{region}/{rack}/{s}", shards[s]))


def test_same_as_plain_python_and_confined_growth(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 40), 1 << 40) for _ in range(3000)] + [None, 0, 0]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, shard string")
    rows = sharding.place(df, 40).collect()
    assert [r.shard for r in rows] == [brute(k, sharding.layout(40)) for k in keys]
    assert [r.grown_shard for r in rows] == [brute(k, sharding.layout(41)) for k in keys]
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 40 for r in moved)
    # later additions too, and every shard gets about its part
    after = sharding.place(df, 41).collect()
    assert all(r.grown_shard in (r.shard, 41) for r in after)
    assert all(40 < sum(r.shard == s for r in rows) < 120 for s in range(40))


def test_weights_confine_movement(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = {"a": {"r": {0: 1.0, 1: 2.0}}, "b": {"s": {2: 1.0}, "t": {3: 1.0}}}
    more = {"a": tree["a"], "b": {"s": {2: 1.0}, "t": {3: 3.0}}}
    rows = df.select(sharding.shard_of(df.doc_id, tree).alias("x"), sharding.shard_of(df.doc_id, more).alias("y")).collect()
    assert all(r.x == r.y or r.x in (0, 1, 2) and r.y in (2, 3) for r in rows)
    assert 1.7 < sum(r.x == 1 for r in rows) / sum(r.x == 0 for r in rows) < 2.3


def test_slots_have_no_gaps(spark):
    rows = [(i % 50 if i % 7 else None, i % 3, i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text_crc32 long, shard int")
    held = {}
    for r in sharding.numbered(df, "shard", "doc_id", "text_crc32").collect():
        held.setdefault(r.shard, []).append(r.slot)
    assert {s: sorted(v) for s, v in held.items()} == {s: list(range(225)) for s in range(4)}
    empty = sharding.numbered(sharding.place(df.limit(0), 40), "shard", "doc_id", "text_crc32")
    assert empty.collect() == []
