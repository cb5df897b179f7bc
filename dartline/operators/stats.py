"""Structural statistics of undirected simple graphs, and comparisons of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.operators.connectivity import characteristic_path_length
from dartline.operators.graph import darts, degrees
from dartline.operators.triangles import triangle_count
from dartline.plans.work import Work

DIGITS = 6


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends over darts (population moments); 0.0 without variance."""
    d = degrees(edges)
    ends = darts(edges).join(d.select(F.col("id").alias("u"), F.col("degree").alias("x")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("y")), "v")
    # whole numbers until the last step: exact, whatever the order of the sums
    m = ends.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("y")).alias("p"), F.sum(F.col("x") * F.col("x")).alias("q"))
    top = (F.col("n") * F.col("p") - F.col("s") * F.col("s")).cast("double")
    bottom = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    return m.select(F.coalesce(F.when(bottom != 0, F.try_divide(top, bottom)), F.lit(0.0)).alias("assortativity"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c of each triangle once. Edges point to the end of higher degree, so hubs fan out little."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("u"), F.col("degree").alias("x")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("y")), "v")
    left, right = F.struct(F.col("x").alias("d"), F.col("u").alias("id")), F.struct(F.col("y").alias("d"), F.col("v").alias("id"))
    up = left < right
    e = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"), F.when(up, right).otherwise(left).alias("k"))
    wedge = e.select("a", "b", "k").join(e.select("a", F.col("b").alias("c"), F.col("k").alias("l")), "a").where("k < l")
    return wedge.select("a", "b", "c").join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])


def clustering_coefficient(edges: DataFrame, count: DataFrame | None = None) -> DataFrame:
    """3 triangles / paths of two edges; 0.0 without such paths. count: triangle_count, if it is known."""
    paths = degrees(edges).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"))
    share = F.try_divide(3.0 * F.col("triangles"), F.col("wedges"))
    return (triangle_count(edges) if count is None else count).crossJoin(paths).select(F.coalesce(F.when(F.col("wedges") > 0, share), F.lit(0.0)).alias("clustering"))


def power_law_exponent(edges: DataFrame, xmin: int = 1) -> DataFrame:
    """1 + n / sum(ln(d / (xmin - 1/2))) over degrees d >= xmin; null if there are none."""
    d = degrees(edges).where(F.col("degree") >= xmin).groupBy("degree").agg(F.count("*").alias("n"))
    logs = F.sum(F.col("n") * F.log(F.col("degree") / F.lit(xmin - 0.5)))
    return d.agg(F.sum("n").alias("n"), logs.alias("s")).select((1 + F.try_divide(F.col("n").cast("double"), F.col("s"))).alias("power_law"))


def community_density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row, intra and inter: realised / possible edges inside and between labels, over all of nodes; 0.0 if none is possible."""
    label = nodes.select("id", "label")
    ends = edges.join(label.select(F.col("id").alias("u"), F.col("label").alias("x")), "u").join(label.select(F.col("id").alias("v"), F.col("label").alias("y")), "v")
    real = ends.agg(F.count_if(F.expr("x <=> y")).alias("inside"), F.count_if(F.expr("not (x <=> y)")).alias("between"))
    sizes = label.groupBy("label").agg(F.count("*").alias("c"))
    possible = sizes.agg(F.sum(F.expr("c * (c - 1) div 2")).alias("pi"), F.sum("c").alias("n"))
    one = real.crossJoin(possible).withColumn("pb", F.expr("n * (n - 1) div 2 - pi"))
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.try_divide(F.col(a).cast("double"), F.col(b))), F.lit(0.0))
    return one.select(share("inside", "pi").alias("intra"), share("between", "pb").alias("inter"))


def compute_graph_statistics(edges: DataFrame, nodes: DataFrame | None = None, *, labels: bool = False, path_length: bool = True, digits: int = DIGITS) -> DataFrame:
    """metric, value in long form: six metrics, with labels two more. nodes: needed for path length and labels."""
    count = Work(edges.sparkSession).keep(triangle_count(edges))
    parts = [max_degree(edges), degree_assortativity(edges), count, power_law_exponent(edges), clustering_coefficient(edges, count)]
    if path_length:
        parts.append(characteristic_path_length(edges, nodes))
    if labels:
        parts.append(community_density(edges, nodes))
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.crossJoin(p)  # rows of one
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), digits).alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def generated(stats: DataFrame, prefix: str = "generated_") -> DataFrame:
    """Metrics under their names in a history."""
    return stats.withColumn("metric", F.concat(F.lit(prefix), "metric"))


def average_rank(reference: DataFrame, candidates: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """cand, average_rank: candidates (cand, metric, value) by their distance from reference (metric, value).

    Ranks are 1, 2, ... within a metric, ties in the order of cand; an unknown value ranks last.
    """
    ref = reference.select("metric", F.col("value").alias("ref"))
    if metrics is not None:
        ref = ref.where(F.col("metric").isin(metrics))
    rows = candidates.select("cand").distinct().crossJoin(ref).join(candidates, ["cand", "metric"], "left")  # a few metrics
    error = F.coalesce(F.nanvl(F.abs(F.col("value") - F.col("ref")), F.lit(None).cast("double")), F.lit(float("inf")))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(error, "cand"))
    return rows.withColumn("rank", rank).groupBy("cand").agg(F.avg("rank").alias("average_rank"))


def budget_report(values: DataFrame, reference: DataFrame) -> DataFrame:
    """budget, metric, reference, mean, std: over the graphs of a budget, unknown values left out; population std."""
    v = F.nanvl("value", F.lit(None).cast("double"))
    own = values.groupBy("budget", "metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return own.join(reference.select("metric", F.col("value").alias("reference")), "metric", "left").select("budget", "metric", "reference", "mean", "std")


def mean_differences(report: DataFrame) -> DataFrame:
    return report.withColumn("abs_difference", F.abs(F.col("mean") - F.col("reference")))


def mean_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row, mean_degree = 2 E / n."""
    one = edges.agg(F.count("*").alias("e")).crossJoin(nodes.agg(F.count("*").alias("n")))
    return one.select(F.try_divide(2.0 * F.col("e"), F.col("n")).alias("mean_degree"))


def rounded(c: Column | str, digits: int = DIGITS) -> Column:
    return F.round(c, digits)
