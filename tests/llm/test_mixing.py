from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from dartline.llm import mixing
from tests.llm.fixtures import awkward, empty


def oracle(docs):
    with duckdb.connect() as c:
        c.register("documents", docs.select("doc_id", "text", "source").toPandas())
        return sorted(c.sql(mixing.OP6_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_equals_sql(spark, sf, which):
    docs = awkward(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).drop("source").collect()
    assert [tuple(r) for r in sorted(map(tuple, got), key=repr)] == oracle(docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_taken_words_come_near_targets(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert all(r["size"] == r["source_size"] and abs(r["taken"] - r["target"]) <= mixing.BLOCK for r in rows)
    assert abs(sum(r["target"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) < 1


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 90}
    rows = {r["source"]: r for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * sizes[n]]
        if not over:
            break
        for n in over:
            target[n] = 2 * sizes[n]
            left -= target[n]
            free.remove(n)
    target |= {n: level * weight[n] for n in free}
    assert {n: rows[n]["target"] for n in names} == pytest.approx(target, abs=1e-5)


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).select(F.expr(mixing.shuffled("id", f"{n}L", "17L"))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in mixing.mix(docs).collect():
        share = r["taken"] / max(r["size"], 1)
        assert share - 1 < copies.get(r["doc_id"], 0) < share + 1
    assert mixing.mixed(awkward(spark)).count() > 0


def test_counts_of_shards_are_multinomial(spark):
    """Variance over mean of equal cells near 1, sums exact, and runs end to end; the slots of a run take its blocks."""
    sources = spark.createDataFrame([(1, 30_000, 40_000), (2, 5, 9), (3, 7, 0)], "_rank int, blocks long, slots long")
    counts = mixing.shard_counts(sources, 64).orderBy("_rank", "out_shard").collect()
    one = [c.last - c.first for c in counts if c._rank == 1]
    mean = 40_000 / 64
    assert sum(one) == 40_000 and len(one) == 64 and 0.6 < sum((x - mean) ** 2 for x in one) / 64 / mean < 1.5
    assert sum(c.last - c.first for c in counts if c._rank == 2) == 9 and not any(c._rank == 3 for c in counts)
    for a, b in zip(counts, counts[1:]):
        assert b.first == (a.last if a._rank == b._rank else 0)
    rows = mixing.draws(mixing.shard_counts(sources, 64)).collect()
    took = Counter((r._rank, r.block) for r in rows)
    assert len(took) == 30_005 and set(took.values()) <= {1, 2} and len(rows) == 40_009
    per = Counter((r._rank, r.out_shard) for r in rows)
    assert per == Counter({(c._rank, c.out_shard): c.last - c.first for c in counts})


def test_shards_hold_the_words_taken(spark, sf):
    """out_shards against the slots' blocks, document by document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spans = mixing.spans(docs, 5).collect()
    sources = mixing.targets(spark.createDataFrame(spans).groupBy("source").agg(F.sum("size").alias("source_size")))
    rank = {r.source: r._rank for r in sources.collect()}
    to = {}
    for r in mixing.draws(mixing.shard_counts(sources)).collect():
        to.setdefault((r._rank, r.block), []).append(r.out_shard)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for r in spans:
        own, taken = set(), 0
        for word in range(r.start, r.start + r["size"]):
            found = to.get((rank[r.source], word // mixing.BLOCK), [])
            own.update(found)
            taken += len(found)
        assert got[r.doc_id].taken == taken and got[r.doc_id].out_shards == ",".join(map(str, sorted(own)))


def test_mixed_with_clashing_names(spark):
    """Columns named like anything the operator adds stay as they were."""
    docs = awkward(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_d", "_s", "_share", "_copies", "_copy", "id", "copies", "_size", "taken"))])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    kept = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= kept and out.count() > 0


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).collect() == []
    assert mixing.mixed(empty(spark)).collect() == []
