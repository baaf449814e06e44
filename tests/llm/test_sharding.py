"""Sharding against a brute-force version, and its laws."""

import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tillbook.llm import sharding
from tillbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def hash64(doc_id, shard):
    seed = 42
    for value, size in ((doc_id, 8), (shard, 4)):
        if value is not None:
            seed = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed)
    return seed


def brute_shard(doc_id, weights):
    score = {s: -w / math.log(((hash64(doc_id, s) >> 11) + 0.5) * 2.0**-53) for s, w in weights.items()}
    return min(score, key=lambda s: (-score[s], s))


def check(rows, docs, n):
    weights, grown = sharding.equal_weights(n), sharding.equal_weights(n + 1)
    want = Counter()
    for r in docs:
        b = (r["text"] or "").encode()
        want[(r["doc_id"], len(b) + 16, zlib.crc32(b), "key", brute_shard(r["doc_id"], weights), brute_shard(r["doc_id"], grown))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append((r.slot, r.doc_id is None, r.doc_id or 0, r.text_crc32, r.size))
        assert r.grown_shard in (r.shard, n)
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s)))
        assert [x[1:] for x in s] == sorted(x[1:] for x in s)


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    df = QUERIES["op2_sharding"](spark, SF)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(df.collect(), docs, 40)


def test_nulls_repeats_clashes_and_empty(make_docs):
    docs = make_docs([(None, "a"), (None, None), (1, ""), (1, ""), (2, "é" * 3), (3, None), (4, "x" * 100_000)] + [(7, "hot")] * 50)
    check(sharding.shard(docs, 3).collect(), docs.collect(), 3)
    assert sharding.shard(docs.limit(0), 3).collect() == []


def test_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign(ids, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert abs(n[1] / n[0] - 3) < 0.2
