"""Edge splits, samples of non-edges, and measures of link prediction."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import rand01, randint
from dartline.operators.connectivity import component_count, spanning_tree
from dartline.operators.graph import canonical, dense_ids, first_rows, numbered, running_sums
from dartline.operators.scores import aggregate_scores, default_mode, transition_counts
from dartline.plans.work import Work


def non_edges(edges: DataFrame, nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """u, v, place 0..count-1: distinct pairs u < v that aren't edges, in the order they are drawn.

    More than there are is a ValueError. Draws go on, twice as many each time, until enough are distinct.
    """
    ids = Work(edges.sparkSession).keep(dense_ids(nodes))
    n = ids.count()
    if n * (n - 1) // 2 - edges.count() < count:
        raise ValueError(f"the graph has fewer than {count} pairs without an edge")
    draws = max(64, math.ceil(2.3 * count))
    while True:
        # pairs of dense numbers a <> b, by two hashes of the draw's number
        rows = edges.sparkSession.range(draws).select(F.col("id").alias("t"), randint(n, seed, "a", F.col("id")).alias("a"), randint(n, seed, "b", F.col("id")).alias("b")).where("a <> b")
        rows = rows.join(ids.select(F.col("new").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("new").alias("b"), F.col("id").alias("v")), "b")
        rows = canonical(rows.select("t", "u", "v")).groupBy("u", "v").agg(F.min("t").alias("t")).join(edges.select("u", "v"), ["u", "v"], "left_anti")
        found = Work(edges.sparkSession).keep(numbered(rows, "t", name="place").where(F.col("place") < count).select("u", "v", "place"))
        if found.count() >= count:
            return found
        draws *= 2


def link_split(edges: DataFrame, nodes: DataFrame, *, val: float = 0.10, test: float = 0.05, seed: int = 0, check_connected: bool = True) -> DataFrame:
    """u, v, split (train, val, test), is_pos. Training edges hold a spanning tree, so their graph is connected.

    Each held-out set comes with as many pairs that aren't edges. The graph must be connected, with edges and
    without isolated nodes, and the tree must fit in the training share; else ValueError. check_connected: not for a
    component that was just computed.
    """
    if not val + test > 0:
        raise ValueError("val + test must be above 0")
    work = Work(edges.sparkSession)
    total = edges.count()
    if not total:
        raise ValueError("the graph has no edges")
    if check_connected and component_count(edges, nodes) != 1:
        raise ValueError("the graph is not connected")
    tree = work.keep(spanning_tree(edges))
    more = int(total * (1 - val - test)) - tree.count()
    if more < 0:
        raise ValueError("a spanning tree has more edges than the training share")
    rest = numbered(edges.select("u", "v").join(tree, ["u", "v"], "left_anti"), rand01(seed, F.col("u"), F.col("v")), "u", "v", name="place")
    held = total - tree.count() - more
    cut = int(held * val / (val + test))
    part = lambda place: F.when(place < cut, "val").otherwise("test")
    edge = rest.select("u", "v", F.when(F.col("place") < more, "train").otherwise(part(F.col("place") - more)).alias("split"), F.lit(True).alias("is_pos"))
    train = tree.select("u", "v", F.lit("train").alias("split"), F.lit(True).alias("is_pos"))
    others = non_edges(edges, nodes, held, seed).select("u", "v", part(F.col("place")).alias("split"), F.lit(False).alias("is_pos"))
    return work.keep(train.unionByName(edge).unionByName(others))


def train_subsample(edges: DataFrame, *, fraction: float, seed: int = 0) -> DataFrame:
    """The breadth-first tree from the smallest node and random further edges, round(fraction E) in all or the tree."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    edges = edges.select("u", "v")
    if fraction == 1:
        return edges
    work = Work(edges.sparkSession)
    tree = work.keep(spanning_tree(edges))
    size, total = tree.count(), edges.count()
    more = min(max(round(fraction * total), size), total) - size
    rest = first_rows(edges.join(tree, ["u", "v"], "left_anti"), more, rand01(seed, F.col("u"), F.col("v")), "u", "v")
    return tree.unionByName(rest)


def relative_train_fraction(fraction: float, val: float, test: float) -> float:
    """A share of all edges as a share of the split's training edges; more than those is a ValueError."""
    left = 1 - val - test
    if fraction > left:
        raise ValueError(f"a training share of {fraction} exceeds the {left} that the split leaves")
    return fraction / left


def edge_overlap(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """One row, overlap: the share of the reference's edges that were generated; 0.0 without any."""
    own, ref = canonical(generated.select("u", "v")).distinct(), canonical(reference.select("u", "v")).distinct()
    both = ref.join(own.withColumn("hit", F.lit(1)), ["u", "v"], "left")
    return both.agg(F.coalesce(F.try_divide(F.count("hit").cast("double"), F.count("*")), F.lit(0.0)).alias("overlap"))


def pair_scores(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with score: that of the direction given; without one, 0."""
    return pairs.join(scores.select("u", "v", F.col("w").alias("score")), ["u", "v"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: ties are one row whatever their number."""
    pos = F.col("is_pos")
    return rows.groupBy(*by, "score").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))


def same(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a joined with one row of b for each group; without groups, with its only row."""
    if not by:
        return a.crossJoin(b)
    named = b.withColumnsRenamed({c: f"_{c}" for c in by})
    condition = [a[c].eqNullSafe(named[f"_{c}"]) for c in by]
    return a.join(named, condition).drop(*[f"_{c}" for c in by])


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """by_score with p_up, n_up (of lower and equal scores of the group) and p_all, n_all; summed in ranges of the scores."""
    counts = running_sums(by_score(rows, by), {"p_up": "p", "n_up": "n"}, *by, "score")
    counts = Work(rows.sparkSession).keep(counts)
    base = counts.groupBy(*by).agg(*[F.min(F.col(f"{c}_up") - F.col(c)).alias(f"{c}_base") for c in "pn"], *[F.sum(c).alias(f"{c}_all") for c in "pn"])
    return same(counts, base, by).withColumns({f"{c}_up": F.col(f"{c}_up") - F.col(f"{c}_base") for c in "pn"})


def roc_auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auc of rows (score, is_pos): the share of pairs in order, ties one half; null if a side is empty."""
    by = by or []
    counts = ranked(rows, by)
    won = F.col("p") * (F.col("n_up") - F.col("n") / 2)
    return counts.withColumn("won", won).groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def average_precision(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ap: sum over distinct scores of the recall they add times the precision down to them; null if a side is empty."""
    by = by or []
    down = {c: F.col(f"{c}_all") - F.col(f"{c}_up") + F.col(c) for c in "pn"}
    counts = ranked(rows, by).withColumns({"tp": down["p"], "all": down["p"] + down["n"]})
    ap = F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p").cast("double"))
    return counts.groupBy(*by).agg(F.when(F.sum("n") > 0, ap).alias("ap"))


def link_prediction(scores: DataFrame, pairs: DataFrame, *, walk_type: str = "random", mode: str | None = None) -> DataFrame:
    """split, auc, ap and val_score (their mean) of pairs (u, v, split, is_pos)."""
    own = aggregate_scores(scores, mode or default_mode(walk_type))
    rows = Work(scores.sparkSession).keep(pair_scores(own, pairs))
    both = roc_auc(rows, ["split"]).join(average_precision(rows, ["split"]), "split")
    return both.withColumn("val_score", (F.col("auc") + F.col("ap")) / 2)


def link_prediction_from_walks(walks: DataFrame, n: int, pairs: DataFrame, *, walk_type: str, mode: str | None = None) -> DataFrame:
    return link_prediction(transition_counts(walks, n, walk_type), pairs, walk_type=walk_type, mode=mode)


def scaled_scores(scores: DataFrame, pairs: DataFrame, darts_per_sequence: int) -> DataFrame:
    """pairs with score = darts_per_sequence * S(u, v) / sum of S; no rows if the sum is 0."""
    mass = scores.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("mass")).where("mass > 0")  # one row or none
    return pair_scores(scores, pairs).crossJoin(mass).withColumn("score", F.lit(float(darts_per_sequence)) * F.col("score") / F.col("mass")).drop("mass")


def smallest_gap(value: Column | str, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """min_gap between distinct values; null for fewer than two."""
    by = by or []
    own = rows.select(*by, F.col(value).alias("x") if isinstance(value, str) else value.alias("x")).distinct()
    own = Work(rows.sparkSession).keep(own.repartitionByRange(*by, "x").withColumn("_part", F.spark_partition_id()))
    inside = F.col("x") - F.lag("x").over(Window.partitionBy("_part", *by).orderBy("x"))
    ends = own.groupBy("_part", *by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row a range and group
    between = F.col("lo") - F.lag("hi").over(Window.partitionBy(*by).orderBy("_part"))
    gaps = own.select(*by, inside.alias("gap")).unionByName(ends.select(*by, between.alias("gap")))
    return gaps.groupBy(*by).agg(F.min("gap").alias("min_gap"))


def score_diagnostics(scores: DataFrame, pairs: DataFrame, darts_per_sequence: int) -> DataFrame:
    """split, edges, min_score, min_gap over the splits' edges."""
    rows = Work(scores.sparkSession).keep(scaled_scores(scores, pairs.where("is_pos"), darts_per_sequence))
    ends = rows.groupBy("split").agg(F.count("*").alias("edges"), F.min("score").alias("min_score"))
    return ends.join(smallest_gap("score", rows, ["split"]), "split")


@dataclass
class EarlyStopping:
    """Stops after `patience` values in a row that aren't above the best by more than min_delta; unknown values count."""

    patience: int
    min_delta: float = 0.0
    best: float = -math.inf
    best_step: int | None = None
    bad: int = 0
    stopped: bool = False

    def update(self, value: float, *, step: int) -> bool:
        if value > self.best + self.min_delta:
            self.best, self.best_step, self.bad = value, step, 0
        else:
            self.bad += 1
            self.stopped = self.bad >= self.patience
        return self.stopped


def early_stopping(history: DataFrame, *, patience: int, min_delta: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """best, best_epoch, bad and stop_epoch (null: never) of each history (epoch, value): the same, as one fold."""
    by = by or []
    rows = history.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("epoch", F.nanvl("value", F.lit(None).cast("double")).alias("value")))).alias("h"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"), F.lit(0).cast("long").alias("bad"), F.lit(None).cast("long").alias("stop_epoch"))

    def step(s, x):
        better = F.coalesce(x["value"] > s["best"] + min_delta, F.lit(False))
        bad = F.when(better, F.lit(0).cast("long")).otherwise(s["bad"] + 1)
        now = F.struct(
            F.when(better, x["value"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"].cast("long")).otherwise(s["best_epoch"]).alias("best_epoch"),
            bad.alias("bad"), F.when(bad >= patience, x["epoch"].cast("long")).alias("stop_epoch"),
        )
        return F.when(s["stop_epoch"].isNull(), now).otherwise(s)

    return rows.select(*by, F.aggregate("h", start, step).alias("s")).select(*by, "s.*")
