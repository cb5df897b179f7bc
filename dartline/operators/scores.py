"""Transition scores of walks, and graphs drawn from scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dartline.functions.rng import column, exponential
from dartline.operators.graph import darts, first_rows, valid_vertices
from dartline.plans.work import Work

WALKS = ("facial", "random")
#: Scores up to which rows choose their edges one after another, in one task.
ONE_TASK = 2_000_000


def check_walk_type(walk_type: str) -> None:
    if walk_type not in WALKS:
        raise ValueError(f"unknown walk type {walk_type!r}")


def default_mode(walk_type: str) -> str:
    check_walk_type(walk_type)
    return "sum" if walk_type == "random" else "none"


def token_pairs(tokens: Column, walk_type: str) -> Column:
    """(u, v) of an array: tokens two by two in facial walks (an odd last is left out), neighbours in random ones."""
    step = 2 if walk_type == "facial" else 1
    size = F.size(tokens)
    last = (size - 2) if walk_type == "random" else (2 * F.floor(size / 2) - 2).cast("int")
    places = F.when(size >= 2, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.struct(F.get(tokens, i).alias("u"), F.get(tokens, i + 1).alias("v")))


def transition_counts(walks: DataFrame, n: int | Column, walk_type: str, pairing: str = "valid") -> DataFrame:
    """u, v, w: how often each dart is walked (tokens arrays; vertices are 0..n-1; loops don't count).

    pairing valid: other tokens are dropped before pairing. positional: the first token of each walk is dropped,
    pairs go by place, and a pair with another token doesn't count.
    """
    check_walk_type(walk_type)
    if pairing == "valid":
        tokens = valid_vertices(F.col("tokens"), column(n))
    elif pairing == "positional":
        tokens = F.when(F.size("tokens") > 1, F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(F.slice("tokens", 1, 0))
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    pairs = walks.select(F.explode(token_pairs(tokens, walk_type)).alias("d")).select("d.u", "d.v")
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < column(n))
    return pairs.where(inside("u") & inside("v") & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.count("*").cast("double").alias("w"))


def aggregate_scores(scores: DataFrame, mode: str) -> DataFrame:
    """Scores of both directions joined by sum or max, or left as they are (none). Loops are dropped by sum and max."""
    if mode == "none":
        return scores.select("u", "v", "w")
    if mode not in ("sum", "max"):
        raise ValueError(f"unknown mode {mode!r}")
    both = scores.select("u", "v", "w").unionByName(scores.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).where("u <> v")
    return both.groupBy("u", "v").agg((F.sum("w") if mode == "sum" else F.max("w")).alias("w"))


def symmetrize_scores(scores: DataFrame) -> DataFrame:
    return aggregate_scores(scores, "sum")


def row_seeds(scores: DataFrame, seed: int) -> DataFrame:
    """Edges u < v: for each row in order, one edge at it by its odds, of those that no earlier row took.

    Each row depends on all rows before it, so this is one task over the positive scores, a row of scores at a time in
    memory; `seeds_in_parallel` is the relaxation for scores that are too many for one task.
    """

    def run(batches):
        import pyarrow as pa

        taken, row, options = set(), None, []

        def draw():
            total = sum(w for _, w in options)
            if total <= 0:
                return
            r = int(hashlib.md5(f"{seed}:row:{row}".encode()).hexdigest()[:13], 16) / 2**52 * total
            for edge, w in options:
                r -= w
                if r < 0:
                    break
            taken.add(edge)

        for batch in batches:
            for u, v, w in zip(*batch.to_pydict().values(), strict=True):
                if u != row:
                    if options:
                        draw()
                    row, options = u, []
                edge = (min(u, v), max(u, v))
                if edge not in taken:
                    options.append((edge, w))
        if options:
            draw()
        edges = sorted(taken)
        yield pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    rows = scores.where("u <> v and w > 0").select("u", "v", F.col("w").cast("double"))
    return rows.repartition(1).sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def seeds_in_parallel(scores: DataFrame, seed: int) -> DataFrame:
    """As row_seeds, but every row draws by itself: both ends may take the same edge, so there can be fewer."""
    draw = exponential(seed, "row", F.col("u"), F.col("v")) / F.col("w")
    best = scores.where("u <> v and w > 0").groupBy("u").agg(F.min_by("v", F.struct(draw, "v")).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def fill(scores: DataFrame, chosen: DataFrame | None, count: int, seed: int) -> DataFrame:
    """`count` further edges of the upper triangle, drawn without replacement by their scores."""
    rows = scores.where("u < v and w > 0")
    if chosen is not None:
        rows = rows.join(chosen, ["u", "v"], "left_anti")
    return first_rows(rows, count, exponential(seed, "fill", F.col("u"), F.col("v")) / F.col("w"), "u", "v").select("u", "v")


def sample_graph(scores: DataFrame, *, target: int | None = None, seed: int = 0, walk_type: str = "facial", mode: str | None = None, parallel_seeds: bool | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Edges u < v of a graph drawn from scores: an edge for each row that has one, then more up to the target.

    The target is at most the entries of the upper triangle (the default); rows' edges are all kept, even beyond it.
    With mode none, an entry below the diagonal can be a row's edge, but not one of the others. parallel_seeds: by
    default, rows choose one after another for up to `one_task` scores and by themselves for more.
    """
    own = Work(scores.sparkSession).keep(aggregate_scores(scores, mode or default_mode(walk_type)))
    if parallel_seeds is None:
        parallel_seeds = own.count() > one_task
    seeds = Work(scores.sparkSession).keep(seeds_in_parallel(own, seed) if parallel_seeds else row_seeds(own, seed))
    entries = own.where("u < v and w <> 0").count()
    target = entries if target is None else min(target, entries)
    return seeds.unionByName(fill(own, seeds, target - seeds.count(), seed))


def reconstruct_graph(walks: DataFrame, n: int, *, walk_type: str = "facial", **options) -> tuple[DataFrame, DataFrame]:
    """(edges, scores) of generated walks."""
    scores = Work(walks.sparkSession).keep(transition_counts(walks, n, walk_type))
    return sample_graph(scores, walk_type=walk_type, **options), scores


def adjacency(edges: DataFrame) -> DataFrame:
    return darts(edges).withColumn("w", F.lit(1.0))
