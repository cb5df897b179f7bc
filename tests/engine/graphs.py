"""Small graphs with known answers."""

TOY = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
KAPPA = [0.1, -0.2, 0.3, 0.4]


def graph(spark, edges, n=None):
    """(edges, nodes 0..n-1)."""
    n = n or 1 + max(max(e) for e in edges)
    return spark.createDataFrame(edges, "u long, v long"), spark.range(n).withColumnRenamed("id", "id")


def cycle(n):
    return [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def values(df, key="id", value="kappa"):
    return {r[key]: r[value] for r in df.collect()}
