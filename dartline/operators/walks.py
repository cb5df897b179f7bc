"""Second-order random walks, one join a step for all walks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dartline.functions.rng import exponential, randint
from dartline.operators.graph import darts, dense_ids
from dartline.plans.work import Work


def corpus_size(configs: int, train_edges: int, context: int, nodes: int) -> int:
    """Walks that match the faces of the configs in tokens (halves round to even), at least one a node."""
    return max(round(configs * 2 * train_edges / max(context - 2, 1)), nodes)


def second_order_steps(edges: DataFrame, starts: DataFrame, steps: int, *, p: float = 1.0, q: float = 1.0, key: tuple = ()) -> DataFrame:
    """walk, pos, node: `steps` steps from each start (walk, node at pos 0).

    The first step is uniform; after that a neighbour weighs 1/p if it is where the walk came from, 1 if it is
    next to that, else 1/q. The neighbour with the least exponential(key) / weight is taken: the right odds,
    and a minimum that is reduced before any shuffle. A node without neighbours ends its walk.
    """
    if not (p > 0 and q > 0):
        raise ValueError("p and q must be above 0")
    work = Work(edges.sparkSession)
    links = work.keep(darts(edges))
    now = work.keep(starts.select("walk", F.col("node").cast("long").alias("node"), F.lit(None).cast("long").alias("prev")))
    parts = [now.select("walk", F.lit(0).alias("pos"), "node")]
    back = links.select(F.col("u").alias("prev"), F.col("v").alias("next"), F.lit(True).alias("near"))
    for step in range(1, steps + 1):
        options = now.join(links, now.node == links.u).select("walk", "prev", "node", F.col("v").alias("next"))
        if step == 1:
            weight: Column = F.lit(1.0)
        else:
            options = options.join(back, ["prev", "next"], "left")
            weight = F.when(F.col("next") == F.col("prev"), F.lit(1 / p)).when(F.col("near"), F.lit(1.0)).otherwise(F.lit(1 / q))
        draw = exponential(*key, F.col("walk"), step, F.col("next")) / weight
        chosen = options.groupBy("walk").agg(F.min(F.struct(draw.alias("draw"), F.col("next").alias("next"), F.col("node").alias("node"))).alias("c"))
        now = work.keep(chosen.select("walk", F.col("c.next").alias("node"), F.col("c.node").alias("prev")))
        parts.append(now.select("walk", F.lit(step).alias("pos"), "node"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def uniform_starts(nodes: DataFrame, walks: int, *key) -> DataFrame:
    """walk, node: each walk starts at a uniform node."""
    ids = dense_ids(nodes)
    n = ids.count()
    draws = nodes.sparkSession.range(walks).select(F.col("id").alias("walk"), randint(n, *key, F.col("id"), 0).alias("new"))
    return draws.join(ids, "new").select("walk", F.col("id").alias("node"))


def random_walk_corpus(edges: DataFrame, nodes: DataFrame, *, walks: int, context: int, seed: int, p: float = 1.0, q: float = 1.0, epoch: int = 0, online: bool = False, bos: int | None = None) -> DataFrame:
    """Chunk records of walks of context - 1 vertices after the begin mark.

    A static corpus is the same in every epoch, an online one is drawn anew. A node without edges is a ValueError.
    bos: by default the number of nodes.
    """
    if not nodes.select("id").join(darts(edges).select(F.col("u").alias("id")), "id", "left_anti").isEmpty():
        raise ValueError("a node has no edges")
    key = (seed, epoch) if online else (seed, 0)
    length = max(context - 1, 1)
    rows = second_order_steps(edges, uniform_starts(nodes, walks, *key), length - 1, p=p, q=q, key=key)
    mark = F.lit(bos if bos is not None else nodes.select("id").distinct().count()).cast("long")
    path = rows.groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("s"))
    return path.select(
        F.concat(F.array(mark), F.col("s.node")).alias("tokens"), F.col("walk").alias("face_index"), F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_start"),
        (F.size("s") - 1).alias("dart_length"), F.lit(True).alias("is_terminal"), F.lit(False).alias("has_eos"), F.lit(1).alias("num_chunks_for_face"),
        F.lit(-1).alias("sign_config_index"), F.col("walk").cast("int").alias("face_index_within_config"),
    )


def dart_walks(edges: DataFrame, *, walks: int, darts_each: int, seed: int, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """walk, pos, u, v: walks of darts_each darts from nodes that have edges; p and q are 1e-12 at least."""
    nodes = darts(edges).select(F.col("u").alias("id")).distinct()
    rows = second_order_steps(edges, uniform_starts(nodes, walks, seed), darts_each, p=max(p, 1e-12), q=max(q, 1e-12), key=(seed,))
    rows = Work(edges.sparkSession).keep(rows)
    ends = rows.select("walk", (F.col("pos") - 1).alias("pos"), F.col("node").alias("v"))
    return rows.withColumnRenamed("node", "u").join(ends, ["walk", "pos"]).select("walk", "pos", "u", "v")
