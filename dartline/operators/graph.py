"""Normal forms of graphs: edges (u, v) with u < v, each once; darts in both directions; node ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.plans.work import Work


def undirected_simple(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges of the undirected simple graph of directed edges u, v: loops and repeats left out.

    With a weight column, weights of repeated edges are added, a missing direction counts as 0, and a pair
    is an edge if the larger direction isn't 0: a one-sided negative weight is dropped, one of both
    directions stays.
    """
    rows = edges.where("u <> v")
    if weight is None:
        return rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sums = rows.groupBy("u", "v").agg(F.sum(weight).alias("w"))
    pairs = sums.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"), F.count("*").alias("n"))
    return pairs.where("if(n = 2, w, greatest(w, 0)) <> 0").select("u", "v")


def darts(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def upper_triangle(rows: DataFrame) -> DataFrame:
    return rows.where("u < v")


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller end first; repeats stay."""
    return pairs.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def valid_vertices(tokens: Column, n: Column | int) -> Column:
    """The tokens of an array that are vertices 0..n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.filter(tokens, lambda t: (t >= 0) & (t < n))


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def numbered(rows: DataFrame, *order: str | Column, name: str = "new") -> DataFrame:
    """rows with their place 0, 1, ... in the order given. Ranges are numbered apart, so no task sorts all."""
    work = Work(rows.sparkSession)
    rows = work.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_inside", inside).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_inside", "_before")


def running_sum(rows: DataFrame, value: str, *order: str | Column, name: str) -> DataFrame:
    """rows with the sum of value up to each in the order given (no ties), added up a range at a time."""
    return running_sums(rows, {name: value}, *order)


def running_sums(rows: DataFrame, values: dict[str, str], *order: str | Column) -> DataFrame:
    """running_sum of several values in one pass: name -> value."""
    work = Work(rows.sparkSession)
    rows = work.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_n_{name}") for name, v in values.items()])  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_n_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_inside_{name}": F.sum(v).over(inside) for name, v in values.items()}).join(F.broadcast(sums), "_part")
    return rows.withColumns({name: F.col(f"_before_{name}") + F.col(f"_inside_{name}") for name in values}).drop("_part", *[f"_{k}_{name}" for name in values for k in ("inside", "before")])


def first_rows(rows: DataFrame, count: int, *order: str | Column) -> DataFrame:
    """The first `count` rows in the order given, by numbers of ranges: a count that grows with the rows is no one task's."""
    return numbered(rows, *order, name="_place").where(F.col("_place") < max(count, 0)).drop("_place")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """id, new: 0, 1, ... in the order of id."""
    return numbered(nodes.select("id").distinct(), "id")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, map id -> new): the edges between the nodes, renumbered 0, 1, ... in the order of id."""
    ids = dense_ids(nodes)
    a = ids.select(F.col("id").alias("u"), F.col("new").alias("x"))
    b = ids.select(F.col("id").alias("v"), F.col("new").alias("y"))
    return edges.join(a, "u").join(b, "v").select(F.col("x").alias("u"), F.col("y").alias("v")), ids


def num_edges(edges: DataFrame) -> int:
    return edges.where("u < v").count()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree of the nodes that have edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """u and its neighbours, sorted."""
    return darts(edges).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))
