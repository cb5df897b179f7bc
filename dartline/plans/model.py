"""Next-token models by counts, and walks generated from them under the walk grammars.

No neural network is included: the model counts what follows the last 1..order tokens, and the longest context
that was seen decides. Generated graphs should not be expected to match those of a trained transformer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import exponential, rand01, randint
from dartline.operators.scores import check_walk_type, transition_counts
from dartline.plans.work import Work


class NextTokenModel(Protocol):
    """What the decoders need: weights of the next vertex after a context of tokens."""

    order: int
    smoothing: float

    def followers(self) -> DataFrame: ...


@dataclass
class CountModel:
    """rows: context (array of 1..order tokens), next, n. Each vertex of the vocabulary weighs `smoothing` more."""

    rows: DataFrame
    vertices: int
    order: int = 2
    smoothing: float = 0.1

    def followers(self) -> DataFrame:
        return self.rows

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> CountModel:
        return cls(spark.read.parquet(path), **options)


def context_counts(sequences: DataFrame, order: int) -> DataFrame:
    """context, next, n over sequences of tokens: contexts of 1..order tokens, counted where they fit."""
    places = F.posexplode("tokens").alias("i", "next")
    rows = sequences.select("tokens", places).where("i > 0")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.col("i"), F.lit(order)))).alias("k")
    rows = rows.select("tokens", "i", "next", lengths)
    return rows.select(F.expr("slice(tokens, i - k + 1, k)").alias("context"), "next").groupBy("context", "next").agg(F.count("*").alias("n"))


def train(sequences: DataFrame, vertices: int, *, order: int = 2, smoothing: float = 0.1) -> CountModel:
    """A model of token arrays; sequences of several epochs are given as one table."""
    return CountModel(Work(sequences.sparkSession).keep(context_counts(sequences, order)), vertices, order, smoothing)


def negative_log_likelihood(model: CountModel, sequences: DataFrame) -> DataFrame:
    """One row: nll, the mean over target tokens, tokens, and perplexity = exp(nll), infinite from nll 20 on."""
    rows = sequences.select("tokens", F.monotonically_increasing_id().alias("s"))
    rows = Work(sequences.sparkSession).keep(rows.select("s", "tokens", F.posexplode("tokens").alias("i", "next")).where("i > 0"))
    options = rows.select("s", "i", "next", F.explode(F.sequence(F.lit(1), F.least(F.col("i"), F.lit(model.order)))).alias("k"), "tokens")
    options = options.select("s", "i", "next", "k", F.expr("slice(tokens, i - k + 1, k)").alias("context"))
    totals = model.followers().groupBy("context").agg(F.sum("n").alias("total"))
    best = options.join(totals, "context").groupBy("s", "i").agg(F.max(F.struct("k", "context", "total")).alias("b"))
    joined = rows.select("s", "i", "next").join(best, ["s", "i"], "left").select("next", F.col("b.context").alias("context"), F.coalesce("b.total", F.lit(0)).alias("total"))
    joined = joined.join(model.followers(), ["context", "next"], "left")
    # the vocabulary of targets: vertices, begin, end
    p = (F.coalesce("n", F.lit(0)) + model.smoothing) / (F.col("total") + model.smoothing * (model.vertices + 2))
    mean = joined.agg(F.avg(-F.log(p)).alias("nll"), F.count("*").alias("tokens"))
    return mean.withColumn("perplexity", F.when(F.col("nll") < 20, F.exp("nll")).otherwise(F.lit(float("inf"))))


def choose(model: NextTokenModel, states: DataFrame, vertices: int, banned: Column, key: tuple, *, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """walk, next: a vertex for each state (walk, tokens), never the banned one (null: none).

    A vertex w weighs n(w) + smoothing, n from the longest context seen. The draw is first between the smoothing of
    all vertices together and the counts, then inside: the vocabulary is never expanded. With a temperature or
    top_k, the draw is among the followers seen, by n^(1 / temperature) and of the top_k most frequent.
    """
    spark = states.sparkSession
    states = Work(spark).keep(states.withColumn("banned", banned))
    size = F.size("tokens")
    options = states.select("walk", "banned", "tokens", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(model.order)))).alias("k"))
    options = options.select("walk", "banned", "k", F.expr("slice(tokens, size(tokens) - k + 1, k)").alias("context"))
    seen = options.join(model.followers(), "context")
    allowed = (F.col("next") >= 0) & (F.col("next") < vertices) & ~F.col("next").eqNullSafe(F.col("banned"))
    seen = seen.where(allowed).withColumn("longest", F.max("k").over(Window.partitionBy("walk"))).where("k = longest")
    weight = F.col("n").cast("double")
    if top_k is not None:
        place = F.row_number().over(Window.partitionBy("walk").orderBy(F.desc("n"), "next"))
        seen = seen.withColumn("place", place).where(F.col("place") <= top_k)
    if temperature != 1.0:
        weight = F.pow(weight, 1 / temperature)
    draw = exponential(*key, "seen", F.col("walk"), F.col("next")) / F.col("weight")
    picked = seen.withColumn("weight", weight).groupBy("walk").agg(F.sum("weight").alias("mass"), F.min_by("next", F.struct(draw, "next")).alias("seen"))
    rows = states.join(picked, "walk", "left")
    # uniform over the vertices but the banned one
    free = F.lit(vertices) - F.col("banned").isNotNull().cast("int")
    other = randint(free, *key, "free", F.col("walk"))
    other = F.when(other >= F.col("banned"), other + 1).otherwise(other)
    smooth = model.smoothing * free if temperature == 1.0 and top_k is None else F.lit(0.0)
    uniform = F.col("seen").isNull() | (rand01(*key, "mix", F.col("walk")) * (F.col("mass") + smooth) < smooth)
    return rows.select("walk", F.when(uniform, other).otherwise(F.col("seen")).alias("next"))


def generate_walks(model: CountModel, count: int, *, length: int, walk_type: str, block: int | None = None, seed: int = 0, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """walk, tokens: `length` tokens each, the first the begin mark; only vertices after it.

    random: a vertex differs from the one before. facial: free choices a0 a1 a2 ...; a1 and a2 differ from a0, a later
    one from the choice before; after a2 comes a copy of a0, after a later a(k) a copy of a(k-1): a0 a1 a2 a0 a3 a2 a4
    a3 ... A walk longer than `block` tokens shows the model its last ones: facial the begin mark and an even
    number after it, random just the last.
    """
    check_walk_type(walk_type)
    spark, n = model.rows.sparkSession, model.vertices
    work, old = Work(spark), None
    nothing = F.lit(None).cast("long")
    now = spark.range(count).select(F.col("id").alias("walk"), F.array(F.lit(n).cast("long")).alias("tokens"), F.expr("cast(array() as array<bigint>)").alias("free"))
    now = work.keep(now.where(F.lit(length > 0)))
    size, free = 1, 0
    while size < length:
        shown = F.col("tokens")
        if block is not None and size > block:
            if walk_type == "facial":
                tail = max(block - 1, 0) // 2 * 2
                shown = F.concat(F.array(F.lit(n).cast("long")), F.slice("tokens", size - tail + 1, tail))
            else:
                shown = F.slice("tokens", size - block + 1, block)
        if free == 0:
            banned = nothing
        elif walk_type == "facial" and free <= 2:
            banned = F.get("free", F.lit(0))
        else:
            banned = F.get("free", F.lit(free - 1))
        states = now.select("walk", shown.alias("tokens"), "free")
        chosen = choose(model, states, n, banned, (seed, free), temperature=temperature, top_k=top_k)
        rows = now.join(chosen, "walk").select("walk", F.concat("tokens", F.array("next")).alias("tokens"), F.concat("free", F.array("next")).alias("free"))
        size, free = size + 1, free + 1
        if walk_type == "facial" and free >= 3 and size < length:
            copy = F.get("free", F.lit(0 if free == 3 else free - 2))
            rows = rows.withColumn("tokens", F.concat("tokens", F.array(copy)))
            size += 1
        old, now = now, work.keep(rows)
        work.drop(old)
    return now.select("walk", "tokens")


def generate(model: CountModel, prompts: DataFrame, *, new_tokens: int, seed: int = 0, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """walk, tokens: prompts continued without a grammar."""
    work = Work(prompts.sparkSession)
    now = work.keep(prompts.select("walk", "tokens"))
    for step in range(new_tokens):
        chosen = choose(model, now, model.vertices, F.lit(None).cast("long"), (seed, "free", step), temperature=temperature, top_k=top_k)
        now = work.keep(now.join(chosen, "walk").select("walk", F.concat("tokens", F.array("next")).alias("tokens")))
    return now


def model_transition_counts(model: CountModel, count: int, *, length: int, walk_type: str, **options) -> DataFrame:
    """u, v, w of generated walks, counted as they come."""
    return transition_counts(generate_walks(model, count, length=length, walk_type=walk_type, **options), model.vertices, walk_type)


def perplexity(nll: float) -> float:
    return math.exp(nll) if nll < 20 else math.inf
