import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from dartline.llm import sharding
from tests.llm.fixtures import awkward, empty


def brute(key, weights):
    bids = []
    for shard, w in enumerate(weights):
        raw = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)
        if w:
            bids.append((-math.log((raw + 1) / 2**52) / w, shard))
    return min(bids)[1]


def test_awkward_rows_equal_brute_force(spark):
    docs = awkward(spark)
    rows = sharding.shard_rows(docs, [1.0] * 8).collect()
    want = Counter()
    for r in docs.collect():
        key, text = "" if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()
        want[r["doc_id"], len(text) + 1, zlib.crc32(text), "key", brute(key, [1.0] * 8), brute(key, [1.0] * 9)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want


def test_slots_have_no_gaps_and_new_shards_only_take(spark, sf):
    rows = sharding.shard_rows(spark.read.parquet(f"{sf}/documents.parquet"), [1.0] * 8, buckets=5).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_key_in_most_rows(spark):
    docs = spark.range(70_000).select(F.when(F.col("id") < 69_000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_rows(docs, [1.0, 1.0]).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in rows) == 70_000 and all(r.n == r.d == r.m + 1 for r in rows)


def test_weights(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    count = {r["shard"]: r["n"] for r in sharding.assign(rows, [1.0, 0.0, 3.0]).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert set(count) == {0, 2} and abs(count[2] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(rows, [0.0])


def test_empty_table(spark):
    assert sharding.shard_rows(empty(spark), [1.0] * 8).collect() == []


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_equals_sql(spark, sf, which):
    docs = awkward(spark).where("doc_id <> 1 or doc_id is null") if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    with duckdb.connect() as c:
        c.register("documents", docs.select("doc_id", "text").toArrow())
        want = c.sql(sharding.OP4_SQL)
        columns, want = want.columns, want.fetchall()
    assert sorted(map(repr, map(tuple, sharding.shard_rows(docs, [1.0] * 8).select(*columns).collect()))) == sorted(map(repr, want))
