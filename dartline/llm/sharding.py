"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard bids for a record with -ln(u) / weight, u drawn from a hash of the record's key and the
shard's number; the lowest bid wins. A shard's bids don't depend on the other shards, so a new
shard takes records only into itself, and in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import exponential, exponential_sql, raw52, raw52_sql
from dartline.llm.common import table

SHARDS = 8


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 that a key falls to; a weight of 0 takes none."""
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("weights must be at least 0, and one must be above 0")
    bids = []
    for shard, weight in enumerate(weights):
        if weight:
            bids.append(F.struct((exponential(key, shard) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard")))
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs with the shard of each row in column `out` (replaced where it exists). No shuffle.

    A null key is the empty text: all such rows share a shard. Equal keys share a shard.
    """
    return docs.withColumn(out, winner(F.coalesce(F.col(key).cast("string"), F.lit("")), weights))


def slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Columns of `rows` (doc_id, shard and others that can be grouped) with slot: 0, 1, ... in each shard.

    Slots go in the order of a hash of the row. No shard is ever sorted in one task: rows fall into `buckets`
    ranges of the hash, each range gets the number of rows before it, and only a range is numbered at a time. Equal rows are counted
    first and spread again at the end, so one key with a third of all rows costs one row.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    place = raw52(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    counted = counted.withColumn("_place", place).withColumn("_bucket", F.expr(f"int(_place div {2**52 // int(buckets) + 1})"))
    # shards x buckets rows: a size that the caller sets
    sums = counted.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_place", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = placed.join(sums, ["shard", "_bucket"])
    # runs of equal rows go through two explodes, so that no array is longer than 2^16
    wide = joined.select(*columns, "_n", (F.col("_before") + F.col("_inside")).alias("_first"), F.explode(F.expr("sequence(0L, _n - 1, 65536L)")).alias("_run"))
    return wide.select(*columns, F.explode(F.expr("sequence(_first + _run, _first + least(_run + 65536L, _n) - 1)")).alias("slot"))


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    size: UTF-8 bytes of the text plus 1 (null text: 1). text_crc32: 0 for a null or empty text.
    grown_shard: the shard under the weights `grown`, by default one more shard of the mean weight.
    Empty docs: no rows. Extra columns are ignored; rows that repeat get slots of their own.
    """
    grown = list(grown if grown is not None else [*weights, sum(weights) / len(weights)])
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        winner(key, weights).alias("shard"),
        winner(key, grown).alias("grown_shard"),
    )
    return slots(rows, buckets).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def _sql() -> str:
    """The same in DuckDB's SQL, except text_crc32, which is worked out byte by byte."""
    key = "coalesce(doc_id::VARCHAR, '')"
    best = lambda n: f"list_min([{', '.join(f'{{bid: {exponential_sql(key, str(s))}, shard: {s}}}' for s in range(n))}]).shard"
    bits = "list_reduce(list_prepend({0}, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    columns = ("doc_id", "size", "text_crc32", "shard", "grown_shard")
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(x ORDER BY i) AS x FROM (SELECT i, {bits.format("i::BIGINT")} AS x FROM range(256) r(i))),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
d AS MATERIALIZED (
  SELECT doc_id, octet_length(b)::BIGINT + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(t.x[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32,
         {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard
  FROM b, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {raw52_sql(*[f"coalesce({c}::VARCHAR, '')" for c in columns])}, doc_id, size, text_crc32, grown_shard) - 1 AS slot, grown_shard FROM d
"""


OP4_SQL = _sql()
