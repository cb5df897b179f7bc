"""Graphs and walks from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import rand01

EVENT_TYPES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_of(rows: DataFrame, group: str, item: str) -> DataFrame:
    """u, v, w: items u < v that share w groups."""
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    other = own.select("g", F.col("i").alias("j"))
    return own.join(other, "g").where("i < j").groupBy(F.col("i").alias("u"), F.col("j").alias("v")).agg(F.count("*").alias("w"))


def part_pairs(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Parts that share at least `least` orders: u, v, w with u < v."""
    return pairs_of(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where(F.col("w") >= least)


def supp_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share more orders than the mean pair."""
    pairs = pairs_of(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return pairs.crossJoin(pairs.agg(F.avg("w").alias("mean"))).where("w > mean").select("u", "v", "w")  # one row


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite: parts, and suppliers with ids after the last part's."""
    first = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("first"))  # one row
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("w"))
    return rows.crossJoin(first).select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + F.col("first")).alias("v"), "w")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and label (the brand) of all parts, isolated ones too."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))


def supp_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk, pos, token: a user's events in time, their types as 0, 1, ... by name."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().withColumn("token", F.row_number().over(Window.orderBy("event_type")) - 1)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", (F.row_number().over(w) - 1).alias("pos"))
    return rows.join(kinds, "event_type").select(F.col("user_id").alias("walk"), "pos", F.col("token").cast("long"))


def event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk and its tokens as an array."""
    rows = event_tokens(spark, sf_dir).groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.select("walk", F.col("t.token").alias("tokens"))


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Directed edges u, v of a file, each once; not symmetrised. Extra columns are dropped.

    fmt: parquet or csv, by default from the path's end. An unknown one is a ValueError.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt == "csv":
        rows = spark.read.csv(path, header=True, schema="u long, v long")
    else:
        raise ValueError(f"unknown graph format {fmt!r}")
    return rows.select(F.col("u").cast("long"), F.col("v").cast("long")).distinct()


def dataset_name(name: str) -> str:
    """The normal form of a dataset's name."""
    return name.strip().lower().replace("-", "_")


#: Names of known datasets: fixed values.
DATASETS = ("coraml", "cora_ml", "dblp", "pubmed", "citeseer", "polblogs")


def load_graph_dataset(spark: SparkSession, name: str, *, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges u, v; nodes id, label) of a dataset exported to <data_dir>/<name>/{edges,nodes}.parquet.

    An unknown name is a ValueError. Labels that are absent are -1.
    """
    name = dataset_name(name)
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    name = "cora_ml" if name == "coraml" else name
    nodes = spark.read.parquet(f"{data_dir}/{name}/nodes.parquet")
    label = F.coalesce(F.col("label"), F.lit(-1)) if "label" in nodes.columns else F.lit(-1)
    return read_graph(spark, f"{data_dir}/{name}/edges.parquet"), nodes.select("id", label.alias("label"))


def identity_features(nodes: DataFrame) -> DataFrame:
    """node, feature, value: the default features, one for each node."""
    return nodes.select(F.col("id").alias("node"), F.col("id").alias("feature"), F.lit(1.0).alias("value"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """G(n, p): each pair u < v is an edge if its own random number is below p. Each node makes its own pairs."""
    left = spark.range(n - 1).withColumnRenamed("id", "u") if n > 1 else spark.range(0).withColumnRenamed("id", "u")
    rows = left.repartition("u").select("u", F.explode(F.sequence(F.col("u") + 1, F.lit(n - 1).cast("long"))).alias("v"))
    return rows.where(rand01(seed, F.col("u"), F.col("v")) < p)
