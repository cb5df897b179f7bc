"""Mixing sources to target weights, in DataFrame functions only.

1. The words of each source, its documents one after another in the order of a hash, are packed into
   blocks of BLOCK words. A source's target is a number of slots, one for each block to be taken.
2. How many slots of a source an output shard gets is a multinomial draw: each of the source's slots
   throws for a shard, by a hash, and the throws are counted. Given the targets, these are the counts that
   shards have when each draws its sources by the weights; the sums by source are exact, so no source
   strays from its target and none is taken more often than it may be.
3. The counts are laid end to end: the slots of a source in a shard are a run of index numbers. Index j
   maps to the block at place p_e(j mod N) of the source's N blocks, where p_e is a pseudorandom
   permutation for each pass e over the source: every block is taken once before any is taken again.
4. Blocks are joined by index: `taken` are a document's words in the blocks taken, `out_shards` the
   shards that they go to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import raw52, raw52_sql
from dartline.llm.common import WORD, Work, fresh, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
OUT_SHARDS = 64
ROUNDS = 12
PRIME = 2147483647


def place(doc_id: Column) -> Column:
    """A document's place in its source: 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def shuffled(i: str, n: str, key: str) -> str:
    """SQL: where index i of 0..n-1 goes under the permutation numbered key (a swap-or-not shuffle).

    Each round pairs i with (k - i) mod n and swaps both or neither, by a bit of a hash of the
    larger one: a bijection whatever the hash. The hash is a few multiplications modulo a prime.
    """
    turn = f"({key} * 7919 + r * 104729) % {PRIME}"
    pair = f"((({turn}) * 48271 % {PRIME}) % {n} + {n} - a) % {n}"
    h = f"((greatest(a, {pair}) % {PRIME}) * 69621 + ({turn})) % {PRIME}"
    h = f"(({h}) * ({h}) + 16807) % {PRIME}"
    return f"aggregate(sequence(1L, {ROUNDS}L), {i}, (a, r) -> if((({h}) div 1024) % 2 = 0, a, {pair}))"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with weight, target, blocks and slots; one row a source.

    The targets are least(most * source_size, level * weight), with the one level at which they sum to
    share of all sizes: the result of resharing every excess by weight until none is above its limit.
    """
    last = F.col("source").isNull().cast("int")
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(last, "source")))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cycle).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    w = Window.orderBy(F.col("_limit") / F.col("weight"), "_rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level that leaves out the limits before this row holds from the first row that it doesn't exceed
    found = ranked.withColumn("_level", level).withColumn("_holds", F.col("_level") * F.col("weight") <= F.col("_limit"))
    found = found.withColumn("_level", F.min(F.when(F.col("_holds"), F.struct(F.col("_limit") / F.col("weight"), F.col("_rank"), F.col("_level").alias("level")))).over(every)["level"])
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_level") * F.col("weight")))
    out = found.withColumn("target", F.round(target, 6)).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)))
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + F.lit(0.5))).otherwise(F.lit(0))
    return out.withColumn("slots", F.least(quota.cast("long"), F.col("blocks") * most)).select("source", "_rank", "source_size", "weight", "target", "blocks", "slots")


def exploded(rows: DataFrame, first: str, last: str, *columns: str) -> DataFrame:
    """The columns with each slot of first..last-1, in two steps: no array is longer than 2^14."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the few rows that go in become many
    runs = rows.where(f"{last} > {first}").select(*columns, F.col(last).alias("_last"), F.explode(F.expr(f"sequence({first}, {last} - 1, 16384L)")).alias("_run"))
    return runs.repartition(n, *columns, "_run").select(*columns, F.explode(F.expr("sequence(_run, least(_run + 16384L, _last) - 1)")).alias("slot"))


def shard_counts(sources: DataFrame, out_shards: int = OUT_SHARDS) -> DataFrame:
    """_rank, blocks, out_shard, first, last: the run of a source's slots that an output shard gets.

    Every slot of a source throws for a shard by 52 bits of a hash: multinomial counts. At most out_shards rows
    a source; slots are counted before they are shuffled.
    """
    each = exploded(sources.withColumn("_zero", F.lit(0).cast("long")), "_zero", "slots", "_rank", "blocks")
    shard = raw52("shard", F.col("_rank"), F.col("slot")) % out_shards
    counts = each.groupBy("_rank", "blocks", shard.cast("int").alias("out_shard")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_rank").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("_n").over(w)
    return counts.select("_rank", "blocks", "out_shard", (last - F.col("_n")).alias("first"), last.alias("last"))


def draws(counts: DataFrame) -> DataFrame:
    """One row for each slot of the mix: _rank of its source, out_shard, slot and the block that it takes."""
    each = exploded(counts, "first", "last", "_rank", "blocks", "out_shard")
    moved = F.expr(shuffled("slot % blocks", "blocks", "(_rank * 31 + slot div blocks)"))
    return each.select("_rank", "out_shard", "slot", moved.alias("block"))


def spans(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, source, size and start: the document's first word among the words of its source.

    Running sums over a source are taken in `buckets` ranges of the place, so that a source with a
    third of all rows is never one task.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("size"), place(F.col("doc_id")).alias("_place"))
    rows = Work(docs.sparkSession).keep(rows)  # the texts are read once; a few numbers a row are kept
    rows = rows.withColumn("_bucket", F.expr(f"_place div {2**52 // buckets + 1}"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("doc_id", "source", "size", (F.col("_before") + F.col("_inside")).alias("start"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int | None = None, out_shards: int = OUT_SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and out_shards of every row of docs.

    out_shards: the output shards that take words of the row, ascending and joined by commas.
    size: words of the text, 0 for null. A null source is a source of its own, the last. Documents
    without words are taken 0 times. taken never exceeds most * size, as no block is taken more than
    `most` times. Rows that repeat are documents of their own. Empty docs: no rows.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spans(docs, buckets)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    counts = Work(docs.sparkSession).keep(shard_counts(sources, out_shards))  # a few rows a source, read twice at least
    taken = draws(counts).groupBy("_rank", "block").agg(F.count("*").alias("_times"), F.collect_set("out_shard").alias("_to"))  # `most` at most
    ids = sources.select(F.col("source").alias("_s"), "_rank", "source_size", "target")
    rows = rows.join(ids, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_row", F.struct("doc_id", "source", "size", "source_size", "target", "start"))
    # a run of blocks that a document fills is exploded in two steps: no array is longer than 2^14
    runs = rows.where("size > 0").select("_row", "_rank", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK}, 16384L)")).alias("_run"))
    parts = runs.select("_row", "_rank", F.explode(F.expr(f"sequence(_run, least(_run + 16383L, (_row.start + _row.size - 1) div {BLOCK}))")).alias("block"))
    held = F.least(F.col("_row.start") + F.col("_row.size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("_row.start"), F.col("block") * BLOCK)
    full = parts.join(taken.hint("merge"), ["_rank", "block"], "left").groupBy("_row").agg(F.sum(held * F.coalesce("_times", F.lit(0))).alias("taken"), F.collect_set("_to").alias("_to"))
    to = F.array_join(F.array_sort(F.array_distinct(F.flatten("_to"))).cast("array<string>"), ",").alias("out_shards")
    full = full.select("_row", "taken", to)
    empty = rows.where("size = 0").select("_row", F.lit(0).cast("long").alias("taken"), F.lit("").alias("out_shards"))
    return full.unionByName(empty).select("_row.doc_id", "_row.source", "_row.size", "_row.source_size", "_row.target", "taken", "out_shards")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as whole documents: each row of docs 0 to MOST times, all columns as they were.

    A document of which the mix takes t words of n comes floor(t / n) times or once more, as a hash of its
    doc_id decides with the odds of the rest: a source's words stay near its target. Texts without words
    don't come. Rows that share doc_id and source share their t and n.
    """
    spark = docs.sparkSession
    d, s, copies, copy = (fresh(docs.columns, c) for c in ("id", "source", "copies", "copy"))
    taken = mix(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.sum("size").alias("n")).where("t > 0")
    taken = taken.select(F.col("doc_id").alias(d), F.col("source").alias(s), (F.col("t") / F.col("n")).alias(copies))
    draw = place(F.concat(F.lit("mixed:"), F.coalesce(F.col(d).cast("string"), F.lit("")))) / F.lit(2.0**52)
    times = Work(spark).keep(taken.withColumn(copies, F.floor(F.col(copies) + draw).cast("int")).where(F.col(copies) > 0))
    # the copies grow with the documents: never broadcast
    rows = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(times[d]) & docs["source"].eqNullSafe(times[s]))
    rows = rows.where(F.regexp_count("text", F.lit(WORD)) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.drop(d, s, copies, copy)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def _sql(block: int = BLOCK) -> str:
    """The same in DuckDB's SQL, with plain windows."""
    turn = f"((s._rank * 31 + slot // blocks) * 7919 + r * 104729) % {PRIME}"
    pair = f"((({turn}) * 48271 % {PRIME}) % blocks + blocks - a) % blocks"
    h = f"((greatest(a, {pair}) % {PRIME}) * 69621 + ({turn})) % {PRIME}"
    h = f"(({h}) * ({h}) + 16807) % {PRIME}"
    moved = f"list_reduce(list_prepend(slot % blocks, range(1, {ROUNDS + 1})), lambda a, r: CASE WHEN (({h}) // 1024) % 2 = 0 THEN a ELSE {pair} END)"
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)
    shard = f"({raw52_sql(repr('shard'), '_rank', 'slot')} % {OUT_SHARDS})::INT"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place
  FROM documents),
p AS MATERIALIZED (
  SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM d),
r AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS _rank FROM d GROUP BY source),
w AS (SELECT *, [{weights}][(_rank - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {float(MOST)}::DOUBLE AS lim FROM r),
v AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY lim / weight, _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, (lim / weight, _rank)) AS level FROM v WHERE level * weight <= lim),
t AS (
  SELECT w.source, w._rank, w.source_size, round(CASE WHEN l.level IS NULL THEN lim ELSE least(lim, l.level * weight) END, 6) AS target,
         ((w.source_size + {block - 1}) // {block})::BIGINT AS blocks FROM w, l),
s AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, blocks * {MOST}) ELSE 0 END AS slots FROM t),
g AS (SELECT s.*, unnest(range(slots)) AS slot FROM s),
c AS (SELECT _rank, {shard} AS out_shard, count(*)::BIGINT AS n FROM g GROUP BY ALL),
f AS (SELECT *, (sum(n) OVER (PARTITION BY _rank ORDER BY out_shard))::BIGINT AS last FROM c),
j AS (SELECT g.*, f.out_shard FROM f JOIN (SELECT s.*, unnest(range(slots)) AS slot FROM s) AS g ON g._rank = f._rank AND g.slot >= f.last - f.n AND g.slot < f.last),
k AS MATERIALIZED (SELECT _rank, block, count(*) AS times, list(out_shard) AS shards FROM (SELECT _rank, out_shard, {moved} AS block FROM j AS s) GROUP BY ALL),
e AS (
  SELECT p.doc_id, p.size, p.start, p.place, s.source_size, s.target, s._rank, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE size > 0)
SELECT e.doc_id, size, source_size, target, sum((least(start + size, (e.block + 1) * {block}) - greatest(start, e.block * {block})) * coalesce(times, 0))::BIGINT AS taken,
 array_to_string(list_sort(list_distinct(flatten(list(coalesce(shards, []))))), ',') AS out_shards
FROM e LEFT JOIN k ON k._rank = e._rank AND k.block = e.block GROUP BY e.doc_id, size, start, source_size, target, e._rank
UNION ALL
SELECT p.doc_id, p.size, s.source_size, s.target, 0, '' FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE size = 0
"""


OP6_SQL = _sql()
