"""The registered queries: every operator over graphs and walks made from the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.operators import connectivity, curvature, graph, linkpred, rotation, scores, stats, tokens, walks
from dartline.plans import catalog_sql as sql
from dartline.plans import model as models
from dartline.plans import reports
from dartline.plans.work import Work
from dartline.sources import tables
from dartline.streaming import transitions as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VERTICES = tables.EVENT_TYPES


def query(oracle: str | None = None):
    """Registers a function under its name, with SQL where there is an equivalent."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def kept(df: DataFrame) -> DataFrame:
    return Work(df.sparkSession).keep(df)


def parts(spark, d) -> DataFrame:
    return kept(tables.part_pairs(spark, d)).select("u", "v")


def suppliers(spark, d) -> DataFrame:
    return kept(tables.supp_dense(spark, d)).select("u", "v")


def ends(edges: DataFrame) -> DataFrame:
    return graph.node_ids(edges)


def degree_kappa(edges: DataFrame) -> DataFrame:
    return graph.degrees(edges).select("id", F.col("degree").cast("double").alias("kappa"))


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


# sources


@query(with_(sql.PARTS) + "SELECT * FROM e")
def part_pairs(spark, d):
    return tables.part_pairs(spark, d)


@query(with_(sql.PARTS_ALL) + "SELECT * FROM e")
def part_pairs_all(spark, d):
    return tables.part_pairs(spark, d, least=1)


@query(with_(sql.SUPPLIERS) + "SELECT * FROM e")
def supp_dense(spark, d):
    return tables.supp_dense(spark, d)


@query("SELECT l_partkey AS u, l_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS v, count(*) AS w FROM lineitem GROUP BY ALL")
def part_supp(spark, d):
    return tables.part_supp(spark, d)


@query(with_(sql.EVENTS) + "SELECT * FROM t")
def event_tokens(spark, d):
    return tables.event_tokens(spark, d)


@query(with_(sql.EVENTS) + "SELECT walk, string_agg(token, ' ' ORDER BY pos) AS tokens FROM t GROUP BY walk")
def event_walks(spark, d):
    return tables.event_walks(spark, d).select("walk", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query(f"SELECT a AS u, b AS v FROM range(400) x(a), range(400) y(b) WHERE a < b AND {sql.rand01_sql('7', 'a', 'b')} < 0.05::DOUBLE")
def erdos_renyi(spark, d):
    return tables.erdos_renyi(spark, 400, 0.05, 7)


@query("SELECT p_partkey AS node, p_partkey AS feature, 1.0::DOUBLE AS value, p_brand AS label FROM part")
def default_features(spark, d):
    nodes = tables.part_nodes(spark, d)
    return tables.identity_features(nodes).join(nodes.withColumnRenamed("id", "node"), "node")


# normal forms


@query(
    """WITH r AS (SELECT l_partkey AS u, l_suppkey AS v, sum(l_quantity::BIGINT - 40) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL),
p AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w, count(*) AS n FROM r GROUP BY ALL)
SELECT u, v FROM p WHERE CASE WHEN n = 2 THEN w ELSE greatest(w, 0) END <> 0"""
)
def undirected_weighted(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), (F.col("l_quantity").cast("long") - 40).alias("w"))
    return graph.undirected_simple(rows, "w")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem WHERE l_partkey <> l_suppkey")
def undirected_simple(spark, d):
    return graph.undirected_simple(tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")))


@query(with_(sql.PARTS, sql.DARTS, sql.DEGREES) + "SELECT id, degree FROM g")
def degrees(spark, d):
    return graph.degrees(parts(spark, d))


@query(with_(sql.PARTS, sql.DARTS) + "SELECT u, string_agg(v, ' ' ORDER BY v) AS neighbours FROM d GROUP BY u")
def neighbours(spark, d):
    return graph.neighbours(parts(spark, d)).select("u", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(
    with_(sql.PARTS, sql.DARTS, sql.DEGREES, "i AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS x FROM g WHERE degree >= 4)")
    + "SELECT a.x AS u, b.x AS v FROM e JOIN i a ON a.id = e.u JOIN i b ON b.id = e.v"
)
def induced_subgraph(spark, d):
    edges = parts(spark, d)
    return graph.induced_subgraph(edges, graph.degrees(edges).where("degree >= 4"))[0]


# connectivity


@query(
    with_(sql.PARTS, sql.DARTS, sql.COMPONENTS, recursive=True)
    + "SELECT p_partkey AS id, coalesce(component, p_partkey) AS component FROM part LEFT JOIN comp ON comp.id = p_partkey"
)
def components(spark, d):
    return connectivity.node_components(parts(spark, d), tables.part_nodes(spark, d))


@query(with_(sql.PARTS, sql.DARTS, sql.COMPONENTS, sql.LARGEST, recursive=True) + "SELECT u, v FROM le")
def largest_component(spark, d):
    edges = parts(spark, d)
    return connectivity.largest_connected_component(edges, ends(edges))[0]


@query(with_(sql.SUPPLIERS, sql.DARTS, "n AS (SELECT DISTINCT u AS id FROM d)", sql.bfs("n", 6), recursive=True) + "SELECT i, j, x AS d FROM x")
def distances(spark, d):
    edges = suppliers(spark, d)
    return connectivity.distances(edges, ends(edges), predecessors=False)


@query(
    with_(sql.SUPPLIERS, sql.DARTS, "n AS (SELECT min(u) AS id FROM d)", sql.bfs("n", 8), recursive=True)
    + "SELECT a.j AS node, min(d.u) AS pred FROM x a JOIN d ON d.v = a.j JOIN x b ON b.j = d.u AND b.x = a.x - 1 GROUP BY a.j"
)
def predecessors(spark, d):
    edges = suppliers(spark, d)
    found = connectivity.distances(edges, edges.agg(F.min("u").alias("id")))
    return found.where("pred is not null").select(F.col("j").alias("node"), "pred")


@query(
    with_(
        sql.SUPPLIERS,
        "d AS MATERIALIZED (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e)",
        "walk(j, x, k) AS (SELECT min(u), 0::BIGINT, 0 FROM d UNION SELECT v, min(walk.x + d.w), k + 1 FROM walk JOIN d ON d.u = walk.j WHERE k < 12 GROUP BY v, k)",
        recursive=True,
    )
    + "SELECT j AS node, min(x)::DOUBLE AS d FROM walk GROUP BY j"
)
def weighted_distances(spark, d):
    edges = kept(tables.supp_dense(spark, d))
    return connectivity.distances(edges, edges.agg(F.min("u").alias("id")), weight="w").select(F.col("j").alias("node"), "d")


@query(
    with_(sql.SUPPLIERS, sql.DARTS, sql.COMPONENTS, sql.LARGEST, sql.bfs("ln", 6), recursive=True)
    + "SELECT round(coalesce(avg(x), 0.0), 6) AS path_length FROM x JOIN ln a ON a.id = i JOIN ln b ON b.id = j WHERE x > 0"
)
def path_length(spark, d):
    edges = suppliers(spark, d)
    return connectivity.characteristic_path_length(edges, ends(edges)).select(F.round("path_length", 6).alias("path_length"))


@query(
    with_(sql.PARTS, sql.DARTS, sql.COMPONENTS, sql.LARGEST, "n0 AS (SELECT min(id) AS id FROM ln)", sql.bfs("n0", 64), recursive=True)
    + "SELECT least(j, q) AS u, greatest(j, q) AS v FROM (SELECT a.j, min(d.u) AS q FROM x a JOIN d ON d.v = a.j JOIN x b ON b.j = d.u AND b.x = a.x - 1 GROUP BY a.j)"
)
def spanning_tree(spark, d):
    edges = parts(spark, d)
    return connectivity.spanning_tree(kept(connectivity.largest_connected_component(edges, ends(edges))[0]))


# statistics

_TRIANGLES = "tr AS (SELECT count(*) AS triangles FROM e a JOIN e b ON b.u = a.v JOIN e c ON c.u = a.u AND c.v = b.v)"
_BASIC = """SELECT (SELECT max(degree) FROM g) AS max_degree,
 (SELECT round(coalesce((count(*) * sum(a.degree * b.degree) - sum(a.degree) * sum(a.degree))::DOUBLE / nullif((count(*) * sum(a.degree * a.degree) - sum(a.degree) * sum(a.degree))::DOUBLE, 0), 0), 6)
  FROM d JOIN g a ON a.id = d.u JOIN g b ON b.id = d.v) AS assortativity,
 (SELECT triangles FROM tr) AS triangles,
 (SELECT round(1 + count(*) / sum(ln(degree / 0.5)), 6) FROM g) AS power_law,
 (SELECT round(coalesce(3.0 * (SELECT triangles FROM tr) / nullif(sum(degree * (degree - 1) / 2), 0), 0), 6) FROM g) AS clustering"""


@query(with_(sql.PARTS, sql.DARTS, sql.DEGREES, _TRIANGLES) + _BASIC)
def graph_stats_basic(spark, d):
    edges = parts(spark, d)
    count = kept(stats.triangle_count(edges))
    wide = [stats.max_degree(edges), stats.degree_assortativity(edges), count, stats.power_law_exponent(edges), stats.clustering_coefficient(edges, count)]
    out = wide[0]
    for w in wide[1:]:
        out = out.crossJoin(w)
    return out.select("max_degree", F.round("assortativity", 6).alias("assortativity"), "triangles", F.round("power_law", 6).alias("power_law"), F.round("clustering", 6).alias("clustering"))


@query(with_(sql.PARTS_ALL, sql.DARTS, sql.DEGREES, _TRIANGLES) + "SELECT triangles FROM tr")
def triangle_count_all(spark, d):
    return stats.triangle_count(kept(tables.part_pairs(spark, d, least=1)).select("u", "v"))


@query(
    with_(sql.PARTS, "y AS (SELECT p_partkey AS id, p_brand AS label FROM part)")
    + """, r AS (SELECT count(*) FILTER (a.label = b.label) AS i, count(*) FILTER (a.label <> b.label) AS o FROM e JOIN y a ON a.id = e.u JOIN y b ON b.id = e.v),
s AS (SELECT sum(c * (c - 1) // 2) AS pi, sum(c) AS n FROM (SELECT count(*) AS c FROM y GROUP BY label))
SELECT round(coalesce(i / nullif(pi, 0), 0.0), 9) AS intra, round(coalesce(o / nullif(n * (n - 1) // 2 - pi, 0), 0.0), 9) AS inter FROM r, s"""
)
def community_density(spark, d):
    return stats.community_density(parts(spark, d), tables.part_nodes(spark, d)).select(F.round("intra", 9).alias("intra"), F.round("inter", 9).alias("inter"))


@query(
    with_(sql.SUPPLIERS, sql.DARTS, sql.DEGREES, _TRIANGLES, sql.COMPONENTS, sql.LARGEST, sql.bfs("ln", 6), f"b AS ({_BASIC})", recursive=True)
    + """SELECT * FROM (UNPIVOT (SELECT max_degree::DOUBLE AS max_degree, assortativity::DOUBLE AS assortativity, triangles::DOUBLE AS triangles, power_law::DOUBLE AS power_law, clustering::DOUBLE AS clustering,
 (SELECT round(avg(x), 6) FROM x WHERE x > 0)::DOUBLE AS path_length FROM b) ON COLUMNS(*) INTO NAME metric VALUE value)"""
)
def graph_statistics(spark, d):
    edges = suppliers(spark, d)
    return stats.compute_graph_statistics(edges, ends(edges))


def candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    """Statistics of a month's lines as candidates, those of the year as the reference: cand, metric, value."""
    rows = tables.table(spark, d, "lineitem").select(F.month("l_shipdate").alias("cand"), F.floor(F.col("l_quantity")).alias("q"), F.col("l_linenumber").alias("n"))
    metric = lambda c, m, f: rows.groupBy("cand").agg(f(c).cast("double").alias("value")).select("cand", F.lit(m).alias("metric"), "value")
    own = metric("q", "sum_q", F.sum).unionByName(metric("n", "max_n", F.max)).unionByName(metric("q", "count_q", F.count))
    ref = own.groupBy("metric").agg(F.max("value").alias("value"))
    return own, ref


_CANDIDATES = """q AS (SELECT month(l_shipdate) AS cand, floor(l_quantity) AS q, l_linenumber AS n FROM lineitem),
c AS (SELECT cand, 'sum_q' AS metric, sum(q)::DOUBLE AS value FROM q GROUP BY cand UNION ALL SELECT cand, 'max_n', max(n)::DOUBLE FROM q GROUP BY cand UNION ALL SELECT cand, 'count_q', count(q)::DOUBLE FROM q GROUP BY cand),
r AS (SELECT metric, max(value) AS value FROM c GROUP BY metric)"""


@query(
    with_(_CANDIDATES)
    + """, k AS (SELECT cand, row_number() OVER (PARTITION BY metric ORDER BY abs(c.value - r.value), cand) AS k FROM c JOIN r USING (metric))
SELECT cand, round(avg(k), 6) AS average_rank FROM k GROUP BY cand"""
)
def average_rank(spark, d):
    own, ref = candidates(spark, d)
    return stats.average_rank(ref, own).select("cand", F.round("average_rank", 6).alias("average_rank"))


@query(
    with_(_CANDIDATES)
    + "SELECT cand % 3 AS budget, metric, any_value(r.value) AS reference, round(avg(c.value), 6) AS mean, round(stddev_pop(c.value), 4) AS std, round(abs(avg(c.value) - any_value(r.value)), 6) AS abs_difference FROM c JOIN r USING (metric) GROUP BY cand % 3, metric"
)
def budget_report(spark, d):
    own, ref = candidates(spark, d)
    report = stats.mean_differences(stats.budget_report(own.withColumn("budget", F.col("cand") % 3), ref))
    return report.select("budget", "metric", "reference", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), F.round("abs_difference", 6).alias("abs_difference"))


@query(with_(sql.PARTS) + "SELECT 2.0::DOUBLE * count(*) / (SELECT count(*) FROM part) AS mean_degree FROM e")
def mean_degree(spark, d):
    return stats.mean_degree(parts(spark, d), tables.part_nodes(spark, d))


# curvature


_LARGEST = (sql.SUPPLIERS, sql.DARTS, sql.COMPONENTS, sql.LARGEST)


@query(with_(*_LARGEST, sql.RESISTANCES, recursive=True) + "SELECT u, v, round(omega, 6) AS omega FROM le JOIN ids a ON a.id = u JOIN ids b ON b.id = v JOIN om ON om.i = a.i AND om.j = b.i")
def resistance_distance(spark, d):
    """Of the edges."""
    own, ids = _split_edges(spark, d)
    omega = curvature.resistance_distance(own, ids, check_connected=False, of_edges=True)
    return omega.select(F.col("i").alias("u"), F.col("j").alias("v"), F.round("omega", 6).alias("omega"))


@query(
    with_(*_LARGEST, sql.RESISTANCES, "rc_rows AS MATERIALIZED (SELECT i, list_append(list(omega ORDER BY j), count(*)::DOUBLE) AS r FROM om GROUP BY i)", sql.solution("rc"), recursive=True)
    + "SELECT id, round(x[1], 6) + 0.0 AS kappa FROM rc JOIN ids USING (i)"
)
def resistance_curvature(spark, d):
    own, ids = _split_edges(spark, d)
    kappa = curvature.resistance_curvature(own, ids, use_lcc=False, rhs=float(ids.count()))
    return kappa.select("id", (F.round("kappa", 6) + 0.0).alias("kappa"))


@query(
    with_(*_LARGEST, sql.bfs("ln", 6), "sc_rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) AS i, i AS id, r FROM (SELECT i, list_append(list(x::DOUBLE ORDER BY j), 1.0::DOUBLE) AS r FROM x GROUP BY i))", sql.solution("sc"), recursive=True)
    + "SELECT id, round(x[1], 6) + 0.0 AS kappa FROM sc JOIN sc_rows USING (i)"
)
def steinerberger_curvature(spark, d):
    own, ids = _split_edges(spark, d)
    kappa = curvature.steinerberger_curvature(own, ids, use_lcc=False, method="lstsq")
    return kappa.select("id", (F.round("kappa", 6) + 0.0).alias("kappa"))


@query()
def ollivier_ricci_curvature(spark, d):
    edges = suppliers(spark, d)
    own, ids = connectivity.largest_connected_component(edges, ends(edges))
    return curvature.ollivier_ricci_curvature(kept(own), kept(ids))


@query()
def lin_lu_yau_curvature(spark, d):
    edges = suppliers(spark, d)
    own, ids = connectivity.largest_connected_component(edges, ends(edges))
    return curvature.lin_lu_yau_curvature(kept(own), kept(ids))


# rotations and faces

CONFIGS, SIGN_SEED = 2, 11
_SORTED = (sql.PARTS, sql.DARTS, sql.DEGREES, sql.sorted_rotation(CONFIGS, SIGN_SEED))
_RANDOM = (sql.PARTS, sql.DARTS, sql.random_rotation(1, 5))


def sorted_rotation(spark, d, configs: int = CONFIGS) -> DataFrame:
    edges = parts(spark, d)
    kappa = kept(degree_kappa(edges))
    return rotation.rotation_from_curvature_signs(edges, kappa, rotation.sample_signs(kappa, configs, SIGN_SEED))


def sorted_faces(spark, d) -> DataFrame:
    return rotation.facial_walks(kept(sorted_rotation(spark, d)))


@query(with_(sql.PARTS, sql.DARTS, sql.DEGREES, sql.signs("g", 4, SIGN_SEED)) + "SELECT config, id, sign FROM sg")
def sign_configurations(spark, d):
    return rotation.sample_signs(graph.degrees(parts(spark, d)), 4, SIGN_SEED)


@query(with_(*_SORTED) + "SELECT config, u, pos, v FROM rot")
def rotation_from_signs(spark, d):
    return sorted_rotation(spark, d)


@query(with_(*_RANDOM) + "SELECT config, u, pos, v FROM rot")
def random_rotation(spark, d):
    return rotation.random_rotation(parts(spark, d), 5)


@query(with_(*_SORTED, sql.faces()) + "SELECT config, u, v, nxt FROM pi")
def pi_map(spark, d):
    return rotation.pi_from_rotation(sorted_rotation(spark, d)).select("config", "u", "v", "nxt")


@query(with_(*_SORTED, sql.faces()) + "SELECT config, u, v, nxt AS u2, u AS v2 FROM pi")
def facial_successor(spark, d):
    pi = rotation.pi_from_rotation(sorted_rotation(spark, d))
    return rotation.facial_successor(rotation.all_darts(pi), pi)


@query(with_(*_RANDOM, "m AS (SELECT config, u, min_by(pos, v) AS first, count(*) AS n FROM rot GROUP BY ALL)") + "SELECT config, u, (pos - first + n) % n AS pos, v FROM rot JOIN m USING (config, u)")
def rotation_from_pi(spark, d):
    """From the smallest neighbour on."""
    return rotation.rotation_from_pi(rotation.pi_from_rotation(kept(rotation.random_rotation(parts(spark, d), 5))))


@query(with_(*_SORTED, sql.faces()) + "SELECT config, face, pos, u, v FROM f")
def faces(spark, d):
    return sorted_faces(spark, d)


@query(with_(*_RANDOM, sql.faces()) + "SELECT config, face, pos, u, v FROM f")
def random_faces(spark, d):
    return rotation.config_faces(parts(spark, d), "random_rotations", seed=5)


@query(with_(*_SORTED, sql.faces()) + ", y AS (SELECT config, face, count(*) AS length FROM f GROUP BY ALL) SELECT round(avg(length), 6) AS mean, median(length) AS median, max(length) AS max, count(*) AS count FROM y")
def face_length_summary(spark, d):
    return rotation.face_length_summary(rotation.face_lengths(sorted_faces(spark, d))).withColumn("mean", F.round("mean", 6))


@query(
    with_(*_SORTED, sql.faces(), "y AS (SELECT count(*) AS length FROM f GROUP BY config, face)", "z AS (SELECT min(length) AS lo, max(length) AS hi FROM y)")
    + "SELECT CASE WHEN hi > lo THEN least(floor((length - lo) * 60 / (hi - lo)) + 1, 60) ELSE 1 END::INT AS bin, count(*) AS faces FROM y, z GROUP BY 1"
)
def face_length_histogram(spark, d):
    return rotation.face_length_histogram(rotation.face_lengths(sorted_faces(spark, d)))


@query(
    with_(*_SORTED, sql.faces(), "y AS (SELECT config, count(DISTINCT face) AS n FROM f GROUP BY config)")
    + "SELECT 'degree' AS method, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max FROM y"
)
def face_count_summary(spark, d):
    out = rotation.face_count_summary(rotation.face_lengths(sorted_faces(spark, d)), "degree")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    with_(
        f"er AS (SELECT p, a AS u, b AS v FROM range(60) x(a), range(60) y(b), (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) z(p) WHERE a < b AND {sql.rand01_sql('3', 'a', 'b')} < p)",
        "e AS MATERIALIZED (SELECT CASE WHEN p < 0.15 THEN u ELSE u + 1000 END AS u, CASE WHEN p < 0.15 THEN v ELSE v + 1000 END AS v FROM er)",
        sql.DARTS,
        sql.random_rotation(1, 9),
        sql.faces(),
    )
    + "SELECT CASE WHEN u < 1000 THEN 0.1 ELSE 0.2 END::DOUBLE AS p, count(DISTINCT face)::DOUBLE AS random_rotations FROM f GROUP BY 1"
)
def face_count_sweep(spark, d):
    """Faces of G(n, p) for two p, as disjoint graphs in one pass."""
    both = None
    for k, p in enumerate((0.1, 0.2)):
        own = tables.erdos_renyi(spark, 60, p, 3).select((F.col("u") + 1000 * k).alias("u"), (F.col("v") + 1000 * k).alias("v"))
        both = own if both is None else both.unionByName(own)
    found = rotation.config_faces(kept(both), "random_rotations", seed=9)
    counts = found.groupBy(F.when(F.col("u") < 1000, 0.1).otherwise(0.2).cast("double").alias("p")).agg(F.countDistinct("face").alias("faces"))
    return rotation.face_count_sweep(counts.withColumn("method", F.lit("random_rotations")), ["p"], ["random_rotations"])


@query(
    with_(*_SORTED, sql.faces(), "y AS (SELECT config, face, string_agg(u || ' ' || v, ' ' ORDER BY pos) AS tokens FROM f GROUP BY ALL)")
    + "SELECT config, face, tokens, row_number() OVER (ORDER BY config, face) - 1 AS seq_id FROM y"
)
def face_vertex_sequences(spark, d):
    rows = rotation.face_vertex_sequences(sorted_faces(spark, d))
    return rows.select("config", "face", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), "seq_id")


@query(
    with_(*_SORTED, sql.faces())
    + "SELECT config, face, max(CASE WHEN pos = 0 THEN u || ' ' || v END) || coalesce(' ' || string_agg(u, ' ' ORDER BY pos) FILTER (pos > 0), '') AS vertices FROM f GROUP BY config, face"
)
def dart_vertex_sequences(spark, d):
    rows = rotation.face_arrays(sorted_faces(spark, d))
    return rows.select("config", "face", F.array_join(rotation.dart_face_to_vertex_sequence(F.col("darts")).cast("array<string>"), " ").alias("vertices"))


@query(with_(*_RANDOM, sql.faces()) + "SELECT (SELECT count(*) FROM (SELECT config, u, v FROM f INTERSECT SELECT config, u, v FROM pi)) = count(*) AND count(*) = (SELECT count(*) FROM pi) AS partition, count(*) AS darts, count(DISTINCT face) AS faces FROM f")
def faces_partition_darts(spark, d):
    edges = parts(spark, d)
    pi = rotation.pi_from_rotation(kept(rotation.random_rotation(edges, 5)))
    found = kept(rotation.faces_from_pi(pi))
    return found.agg(F.lit(rotation.check_faces(found, pi)).alias("partition"), F.count("*").alias("darts"), F.countDistinct("face").alias("faces"))


# chunks

CONTEXT, EPOCH_SEED = 17, 19


def _chunk_sql(epoch: int, width: int, online: bool) -> str:
    """Chunk records with tokens as text; online, of signs drawn for the epoch."""
    signs = sql.sorted_rotation(CONFIGS, f"'{SIGN_SEED}:{epoch}'" if online else SIGN_SEED)
    offset = f"CASE WHEN n <= 1 THEN 0 ELSE floor({sql.rand01_sql(str(EPOCH_SEED), str(epoch), 'seq')} * n)::BIGINT END"
    end = "''" if online else f"CASE WHEN n <= {width} THEN ' ' || (bos + 1) ELSE '' END"
    return (
        with_(
            *_SORTED[:-1],
            signs,
            sql.faces(),
            "y AS (SELECT config, face, count(*) AS n FROM f GROUP BY ALL)",
            "z AS (SELECT *, row_number() OVER (ORDER BY config, face) - 1 AS seq, (SELECT max(p_partkey) + 1 FROM part) AS bos FROM y)",
            f"oo AS MATERIALIZED (SELECT *, {offset} AS off, CASE WHEN n <= {width} THEN 1 ELSE (n - {width}) // {width} + 1 END AS k FROM z)",
            "c AS MATERIALIZED (SELECT *, unnest(range(k)) AS chunk FROM oo)",
            f"a AS (SELECT c.*, least(n - chunk * {width}, {width}) AS len, f.u, f.v, (f.pos - off - chunk * {width} + 2 * n) % n AS place FROM c JOIN f USING (config, face))",
        )
        + f"""SELECT bos || ' ' || string_agg(u || ' ' || v, ' ' ORDER BY place) || any_value({end}) AS tokens, seq AS face_index, chunk AS chunk_index, any_value(len) AS dart_length,
 any_value(chunk = k - 1) AS is_terminal, any_value({'false' if online else f'n <= {width}'}) AS has_eos, any_value(k) AS num_chunks_for_face
FROM a WHERE place < len GROUP BY bos, seq, chunk"""
    )


def _chunk_rows(spark, d, epoch: int, online: bool) -> DataFrame:
    if online:
        edges = parts(spark, d)
        kappa = kept(degree_kappa(edges))
        faces_ = rotation.epoch_faces(edges, kappa, "degree", curvature=kappa, configs=CONFIGS, seed=SIGN_SEED, epoch=epoch)
    else:
        faces_ = sorted_faces(spark, d)
    sequences = rotation.face_vertex_sequences(faces_)
    bos = tables.part_nodes(spark, d).agg(F.max("id") + 1).first()[0]
    rows = tokens.face_chunks(sequences, context=CONTEXT, seed=EPOCH_SEED, bos=bos, epoch=epoch, online=online)
    text = F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens")
    return rows.select(text, "face_index", "chunk_index", "dart_length", "is_terminal", "has_eos", "num_chunks_for_face")


@query(_chunk_sql(3, 8, False))
def face_chunks(spark, d):
    return _chunk_rows(spark, d, 3, False)


@query(_chunk_sql(4, 8, True))
def online_face_chunks(spark, d):
    return _chunk_rows(spark, d, 4, True)


@query(
    with_(sql.EVENTS, "n AS (SELECT walk, count(*) AS n FROM t GROUP BY walk)", "c AS (SELECT walk, pos // 8 AS chunk, string_agg(token, ' ' ORDER BY pos) AS tokens FROM t JOIN n USING (walk) WHERE pos < 8 * (n // 8) GROUP BY ALL)")
    + "SELECT walk, chunk, tokens FROM c"
)
def exact_chunks(spark, d):
    rows = tokens.exact_chunks(tables.event_tokens(spark, d), ["walk"], 8).groupBy("walk", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.select("walk", "chunk", F.array_join(F.col("t.token").cast("array<string>"), " ").alias("tokens"))


@query(
    with_(sql.EVENTS, "n AS (SELECT walk, count(*) AS n FROM t GROUP BY walk)")
    + "SELECT walk, n, len(list_distinct(CASE WHEN n <= 16 THEN [0] ELSE list_append(range(0, n - 15, 5), n - 16) END)) AS windows, list_sum(list_distinct(CASE WHEN n <= 16 THEN [0] ELSE list_append(range(0, n - 15, 5), n - 16) END))::BIGINT AS total FROM n"
)
def window_starts(spark, d):
    rows = tables.event_walks(spark, d).select("walk", F.size("tokens").cast("long").alias("n"))
    starts = tokens.window_starts(F.col("n"), 16, 5, allow_tail_overlap=True)
    return rows.select("walk", "n", F.size(starts).cast("long").alias("windows"), F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    with_(sql.EVENTS, "w AS (SELECT walk, list(token ORDER BY pos) AS k FROM t GROUP BY walk)", f"b AS (SELECT *, row_number() OVER (ORDER BY {sql.rand01_sql('23', '0', 'walk')}, walk) - 1 AS nr FROM w)", "m AS (SELECT *, nr // 32 AS batch, max(len(k)) OVER (PARTITION BY nr // 32) AS most FROM b)")
    + """SELECT walk, batch, (nr % 32)::INT AS place, array_to_string(list_concat(k, list_transform(range(most - len(k)), lambda i: 7)), ' ') AS input_ids,
 array_to_string(list_concat(list_transform(k, lambda i: 1), list_transform(range(most - len(k)), lambda i: 0)), ' ') AS attention_mask,
 array_to_string(list_concat(k, list_transform(range(most - len(k)), lambda i: -100)), ' ') AS labels FROM m"""
)
def padded_batches(spark, d):
    rows = tokens.collate(tokens.batches(tables.event_walks(spark, d), 32, order=["walk"], shuffle=True, seed=23), pad=VERTICES + 2)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return rows.select("walk", "batch", "place", text("input_ids"), text("attention_mask"), text("labels"))


@query(
    with_(sql.EVENTS, "w AS (SELECT walk, string_agg(token, ' ' ORDER BY pos) AS k, count(*) AS n FROM t GROUP BY walk)")
    + "SELECT min(n) AS min, median(n) AS median, round(avg(n), 6) AS mean, max(n) AS max, count(*) AS count, 0::BIGINT AS eos, round(count(DISTINCT k) / count(*), 6) AS ratio FROM w"
)
def chunk_summary(spark, d):
    rows = kept(tables.event_walks(spark, d).withColumn("has_eos", F.lit(False)))
    return tokens.chunk_length_summary(rows).crossJoin(tokens.unique_chunk_ratio(rows)).withColumns({"mean": F.round("mean", 6), "ratio": F.round("ratio", 6)})


_EVENT_DARTS = "x AS (SELECT walk, pos, token AS u, lead(token) OVER (PARTITION BY walk ORDER BY pos) AS v FROM t)"


@query(with_(sql.EVENTS, _EVENT_DARTS, "y AS (SELECT u, v, min(walk) AS walk FROM x WHERE v IS NOT NULL GROUP BY ALL)", "z AS (SELECT walk, count(*) AS n FROM y GROUP BY walk)") + "SELECT walk, sum(n) OVER (ORDER BY walk)::BIGINT AS covered FROM z")
def dart_coverage(spark, d):
    rows = tables.event_walks(spark, d).select("walk", F.explode(scores.token_pairs(F.col("tokens"), "random")).alias("d")).select("walk", "d.u", "d.v")
    return tokens.dart_coverage(rows)


@query(with_(sql.EVENTS, "c AS (SELECT pos, token, count(*) AS n FROM t GROUP BY ALL)", "p AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS p FROM c)") + "SELECT pos, round(sum(-p * ln(p)) + 0.0, 6) AS entropy FROM p GROUP BY pos")
def position_entropy(spark, d):
    return tokens.position_entropy(tables.event_tokens(spark, d)).select("pos", F.round(F.col("entropy") + 0.0, 6).alias("entropy"))


@query(
    with_(sql.EVENTS, "a AS (SELECT walk, min(walk) OVER () AS one, pos, token FROM t)", "b AS (SELECT w.walk, x.pos, x.token FROM (SELECT DISTINCT walk FROM a) w, a x WHERE x.walk = x.one)")
    + "SELECT coalesce(a.walk, b.walk) AS walk, count(*) FILTER (a.token IS DISTINCT FROM b.token) AS hamming FROM a FULL JOIN b ON a.walk = b.walk AND a.pos = b.pos GROUP BY 1"
)
def hamming_to_first(spark, d):
    rows = kept(tables.event_walks(spark, d))
    first = rows.orderBy("walk").limit(1).select(F.col("tokens").alias("first"))  # one row
    return rows.crossJoin(first).select("walk", tokens.hamming(F.col("tokens"), F.col("first")).cast("long").alias("hamming"))


# scores


@query(with_(sql.EVENTS, _EVENT_DARTS) + "SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v GROUP BY ALL")
def transition_counts_random(spark, d):
    return scores.transition_counts(tables.event_walks(spark, d), VERTICES, "random")


@query(with_(sql.EVENTS, _EVENT_DARTS) + "SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v AND pos % 2 = 0 GROUP BY ALL")
def transition_counts_facial(spark, d):
    return scores.transition_counts(tables.event_walks(spark, d), VERTICES, "facial")


@query(with_(sql.EVENTS, _EVENT_DARTS) + "SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v AND pos > 0 AND u < 4 AND v < 4 GROUP BY ALL")
def transition_counts_positional(spark, d):
    """With the last type as an invalid token."""
    return scores.transition_counts(tables.event_walks(spark, d), VERTICES - 1, "random", pairing="positional")


@query(with_(sql.EVENTS, "t4 AS (SELECT walk, row_number() OVER (PARTITION BY walk ORDER BY pos) AS pos, token FROM t WHERE token < 4)", "x AS (SELECT pos, token AS u, lead(token) OVER (PARTITION BY walk ORDER BY pos) AS v FROM t4)") + "SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v GROUP BY ALL")
def transition_counts_filtered(spark, d):
    """Invalid tokens are dropped before pairing."""
    return scores.transition_counts(tables.event_walks(spark, d), VERTICES - 1, "random")


_PART_SCORES = "c AS MATERIALIZED (SELECT l_partkey AS u, l_suppkey AS v, sum(l_linenumber)::DOUBLE AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL)"
_BOTH = "y AS (SELECT u, v, w FROM c UNION ALL SELECT v, u, w FROM c)"


def part_scores(spark, d) -> DataFrame:
    rows = tables.table(spark, d, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return kept(rows.agg(F.sum("l_linenumber").cast("double").alias("w")))


@query(with_(_PART_SCORES, _BOTH) + "SELECT u, v, sum(w) AS w FROM y GROUP BY ALL")
def scores_sum(spark, d):
    return scores.symmetrize_scores(part_scores(spark, d))


@query(with_(_PART_SCORES, _BOTH) + "SELECT u, v, max(w) AS w FROM y GROUP BY ALL")
def scores_max(spark, d):
    return scores.aggregate_scores(part_scores(spark, d), "max")


@query(with_(_PART_SCORES) + f"SELECT u, v FROM c WHERE u < v ORDER BY {sql.exponential_sql('13', chr(39) + 'fill' + chr(39), 'u', 'v')} / w, u, v LIMIT 500")
def fill_edges(spark, d):
    return scores.fill(part_scores(spark, d), None, 500, 13)


@query(
    with_(_PART_SCORES, f"r AS (SELECT u, v FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY {sql.exponential_sql('13', chr(39) + 'row' + chr(39), 'u', 'v')} / w, v) = 1)")
    + "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM r"
)
def seeds_in_parallel(spark, d):
    return scores.seeds_in_parallel(part_scores(spark, d), 13)


_SUMMED = "s AS MATERIALIZED (SELECT u, v, sum(w) AS w FROM y GROUP BY ALL)"


@query(with_(_PART_SCORES, _BOTH, _SUMMED, sql.row_seeds(13), recursive=True) + ", " + sql.filled(13, "2000"))
def sample_graph(spark, d):
    return scores.sample_graph(part_scores(spark, d), target=2000, seed=13, walk_type="random", parallel_seeds=False)


@query(
    with_(
        _PART_SCORES, _BOTH, _SUMMED,
        f"r AS (SELECT u, v FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY {sql.exponential_sql('13', chr(39) + 'row' + chr(39), 'u', 'v')} / w, v) = 1)",
        "t AS MATERIALIZED (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM r)",
    )
    + ", " + sql.filled(13, "(SELECT count(*) // 2 FROM c)")
)
def sample_graph_in_parallel(spark, d):
    """With half as many edges as there are scores."""
    rows = part_scores(spark, d)
    return scores.sample_graph(rows, target=rows.count() // 2, seed=13, walk_type="random", one_task=0)


@query(
    with_(sql.EVENTS.replace("t AS MATERIALIZED", "tk AS MATERIALIZED"), _EVENT_DARTS.replace("FROM t)", "FROM tk)"), "c AS MATERIALIZED (SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v GROUP BY ALL)", _BOTH, _SUMMED, sql.row_seeds(3), recursive=True)
    + ", " + sql.filled(3, "6")
)
def reconstruct_graph(spark, d):
    return scores.reconstruct_graph(tables.event_walks(spark, d), VERTICES, walk_type="random", target=6, seed=3)[0]


# random walks


@query(
    with_(
        sql.SUPPLIERS,
        sql.DARTS,
        "n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM (SELECT DISTINCT u AS id FROM d))",
        f"st AS (SELECT w.walk, n.id AS node FROM range(300) w(walk) JOIN n ON n.new = floor({sql.rand01_sql('29', 'w.walk', '0')} * (SELECT count(*) FROM n)))",
        f"""wk(walk, pos, node, prev) AS (SELECT walk, 0, node, NULL::BIGINT FROM st UNION ALL
 (SELECT w.walk, w.pos + 1, d.v, w.node FROM wk w JOIN d ON d.u = w.node LEFT JOIN d b ON b.u = w.prev AND b.v = d.v WHERE w.pos < 6
  QUALIFY row_number() OVER (PARTITION BY w.walk ORDER BY {sql.exponential_sql('29', 'w.walk', 'w.pos + 1', 'd.v')} / CASE WHEN w.pos = 0 THEN 1.0::DOUBLE WHEN d.v = w.prev THEN 4.0::DOUBLE WHEN b.u IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, d.v) = 1))""",
        recursive=True,
    )
    + "SELECT walk, pos, node FROM wk"
)
def second_order_walks(spark, d):
    edges = suppliers(spark, d)
    return walks.second_order_steps(edges, walks.uniform_starts(ends(edges), 300, 29), 6, p=0.25, q=2.0, key=(29,))


@query(
    with_(
        sql.SUPPLIERS,
        sql.DARTS,
        "n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM (SELECT DISTINCT u AS id FROM d))",
        f"st AS (SELECT w.walk, n.id AS node FROM range(200) w(walk) JOIN n ON n.new = floor({sql.rand01_sql('13', '1', 'w.walk', '0')} * (SELECT count(*) FROM n)))",
        f"""wk(walk, pos, node, prev) AS (SELECT walk, 0, node, NULL::BIGINT FROM st UNION ALL
 (SELECT w.walk, w.pos + 1, d.v, w.node FROM wk w JOIN d ON d.u = w.node LEFT JOIN d b ON b.u = w.prev AND b.v = d.v WHERE w.pos < 6
  QUALIFY row_number() OVER (PARTITION BY w.walk ORDER BY {sql.exponential_sql('13', '1', 'w.walk', 'w.pos + 1', 'd.v')} / CASE WHEN w.pos = 0 OR d.v = w.prev OR b.u IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, d.v) = 1))""",
        recursive=True,
    )
    + """SELECT (SELECT count(*) FROM n) || ' ' || string_agg(node, ' ' ORDER BY pos) AS tokens, walk AS face_index, 0 AS chunk_index, 0 AS chunk_start, (count(*) - 1)::INT AS dart_length,
 true AS is_terminal, false AS has_eos, 1 AS num_chunks_for_face, -1 AS sign_config_index, walk::INT AS face_index_within_config FROM wk GROUP BY walk"""
)
def random_walk_corpus(spark, d):
    edges = suppliers(spark, d)
    rows = walks.random_walk_corpus(edges, ends(edges), walks=200, context=8, seed=13, q=2.0, epoch=1, online=True)
    return rows.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), " "))


# splits and link prediction


def _split_edges(spark, d) -> tuple[DataFrame, DataFrame]:
    edges = suppliers(spark, d)
    own, ids = connectivity.largest_connected_component(edges, ends(edges))
    return kept(own), kept(ids)


_SPLIT = (
    sql.SUPPLIERS,
    sql.DARTS,
    sql.COMPONENTS,
    sql.LARGEST,
    "n0 AS (SELECT min(id) AS id FROM ln)",
    sql.bfs("n0", 10),
    "tp AS (SELECT a.j, min(d.u) AS q FROM x a JOIN d ON d.v = a.j JOIN x b ON b.j = d.u AND b.x = a.x - 1 GROUP BY a.j)",
    "tree AS MATERIALIZED (SELECT least(j, q) AS u, greatest(j, q) AS v FROM tp)",
    f"rest AS MATERIALIZED (SELECT u, v, row_number() OVER (ORDER BY {sql.rand01_sql('3', 'u', 'v')}, u, v) - 1 AS place FROM le WHERE (u, v) NOT IN (SELECT (u, v) FROM tree))",
    "z AS (SELECT (SELECT count(*) FROM le) AS total, (SELECT count(*) FROM tree) AS tree)",
    "zz AS MATERIALIZED (SELECT floor(total * (1 - 0.1::DOUBLE - 0.05::DOUBLE))::BIGINT - tree AS more, total - floor(total * (1 - 0.1::DOUBLE - 0.05::DOUBLE))::BIGINT AS held FROM z)",
    "cut AS MATERIALIZED (SELECT more, held, floor(held * 0.1::DOUBLE / (0.1::DOUBLE + 0.05::DOUBLE))::BIGINT AS c FROM zz)",
    "ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM ln)",
    f"dr AS (SELECT t, floor({sql.rand01_sql('3', chr(39) + 'a' + chr(39), 't')} * (SELECT count(*) FROM ids))::BIGINT AS a, floor({sql.rand01_sql('3', chr(39) + 'b' + chr(39), 't')} * (SELECT count(*) FROM ids))::BIGINT AS b FROM range(200000) r(t))",
    "pp AS (SELECT least(x.id, y.id) AS u, greatest(x.id, y.id) AS v, min(t) AS t FROM dr JOIN ids x ON x.new = a JOIN ids y ON y.new = b WHERE a <> b GROUP BY ALL)",
    "ne AS MATERIALIZED (SELECT u, v, row_number() OVER (ORDER BY t) - 1 AS place FROM pp WHERE (u, v) NOT IN (SELECT (u, v) FROM le))",
    """sp AS MATERIALIZED (SELECT u, v, 'train' AS split, true AS is_pos FROM tree
 UNION ALL SELECT u, v, CASE WHEN place < more THEN 'train' WHEN place - more < c THEN 'val' ELSE 'test' END, true FROM rest, cut
 UNION ALL SELECT u, v, CASE WHEN place < c THEN 'val' ELSE 'test' END, false FROM ne, cut WHERE place < held)""",
)


@query(with_(*_SPLIT, recursive=True) + "SELECT * FROM sp")
def link_split(spark, d):
    return linkpred.link_split(*_split_edges(spark, d), seed=3, check_connected=False)


@query(
    with_(*_SPLIT[:8], f"rest AS (SELECT u, v FROM le WHERE (u, v) NOT IN (SELECT (u, v) FROM tree) ORDER BY {sql.rand01_sql('5', 'u', 'v')}, u, v LIMIT greatest((SELECT round_even(0.4::DOUBLE * count(*), 0)::BIGINT FROM le) - (SELECT count(*) FROM tree), 0))", recursive=True)
    + "SELECT u, v FROM tree UNION ALL SELECT u, v FROM rest"
)
def train_subsample(spark, d):
    return linkpred.train_subsample(_split_edges(spark, d)[0], fraction=0.4, seed=5)


_LINK_SCORES = "sc AS MATERIALIZED (SELECT u, v, w::DOUBLE AS w FROM e0)"
_RATED = "ra AS MATERIALIZED (SELECT sp.*, coalesce(sc.w, 0.0::DOUBLE) AS score FROM sp LEFT JOIN sc USING (u, v) WHERE split <> 'train')"
_AUC = """au AS (SELECT split, sum(CASE WHEN is_pos THEN r END) AS s, count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS n FROM
 (SELECT *, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM ra) GROUP BY split),
ab AS (SELECT split, (s - p * (p + 1) / 2.0::DOUBLE) / (p * n) AS auc FROM au),
bs AS (SELECT split, score, count(*) FILTER (is_pos) AS p, count(*) AS a FROM ra GROUP BY ALL),
bc AS (SELECT split, p, sum(p) OVER w AS tp, sum(a) OVER w AS al, sum(p) OVER (PARTITION BY split) AS pp FROM bs WINDOW w AS (PARTITION BY split ORDER BY score DESC)),
ap AS (SELECT split, sum(p * tp / al) / any_value(pp) AS ap FROM bc GROUP BY split)"""


def _link_scores(spark, d) -> DataFrame:
    rows = tables.pairs_of(tables.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    return kept(rows.withColumn("w", F.col("w").cast("double")))


@query(with_(*_SPLIT, _LINK_SCORES, _RATED, _AUC, recursive=True) + "SELECT split, round(auc, 6) AS auc, round(ap, 6) AS ap, round((auc + ap) / 2, 6) AS val_score FROM ab JOIN ap USING (split)")
def link_prediction(spark, d):
    pairs = linkpred.link_split(*_split_edges(spark, d), seed=3, check_connected=False).where("split <> 'train'")
    rows = linkpred.link_prediction(_link_scores(spark, d), pairs, mode="none")
    return rows.select("split", *[F.round(c, 6).alias(c) for c in ("auc", "ap", "val_score")])


@query(with_("ra AS (SELECT l_linestatus AS split, l_quantity AS score, l_returnflag = 'R' AS is_pos FROM lineitem)", _AUC) + "SELECT split, round(auc, 6) AS auc, round(ap, 6) AS ap FROM ab JOIN ap USING (split)")
def ranking_with_ties(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("is_pos"))
    both = linkpred.roc_auc(rows, ["split"]).join(linkpred.average_precision(rows, ["split"]), "split")
    return both.select("split", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query(with_(sql.SUPPLIERS, "o AS (SELECT count(*) FILTER ((u, v) IN (SELECT (u, v) FROM e)) AS h, count(*) AS n FROM e0)") + "SELECT round(h / n, 6) AS overlap FROM o")
def edge_overlap(spark, d):
    every = tables.pairs_of(tables.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    return linkpred.edge_overlap(suppliers(spark, d), every).select(F.round("overlap", 6).alias("overlap"))


@query(
    with_(*_SPLIT, _LINK_SCORES, "q AS (SELECT split, 8.0::DOUBLE * coalesce(w, 0.0::DOUBLE) / (SELECT sum(w) FROM sc) AS score FROM sp LEFT JOIN sc USING (u, v) WHERE is_pos)", "k AS (SELECT DISTINCT split, score FROM q)", "h AS (SELECT split, score - lag(score) OVER (PARTITION BY split ORDER BY score) AS gap FROM k)", recursive=True)
    + "SELECT q.split, count(*) AS edges, round(min(score), 12) AS min_score, round((SELECT min(gap) FROM h WHERE h.split = q.split), 12) AS min_gap FROM q GROUP BY q.split"
)
def score_diagnostics(spark, d):
    rows = linkpred.score_diagnostics(_link_scores(spark, d), linkpred.link_split(*_split_edges(spark, d), seed=3, check_connected=False), 8)
    return rows.select("split", "edges", F.round("min_score", 12).alias("min_score"), F.round("min_gap", 12).alias("min_gap"))


# models


@query(
    with_(sql.EVENTS, "w AS (SELECT walk, pos, token, lag(token) OVER o AS p1, lag(token, 2) OVER o AS p2 FROM t WINDOW o AS (PARTITION BY walk ORDER BY pos))")
    + "SELECT p1::VARCHAR AS context, token AS next, count(*) AS n FROM w WHERE pos > 0 GROUP BY ALL UNION ALL SELECT p2 || ' ' || p1, token, count(*) FROM w WHERE pos > 1 GROUP BY ALL"
)
def context_counts(spark, d):
    rows = models.context_counts(tables.event_walks(spark, d), 2)
    return rows.select(F.array_join(F.col("context").cast("array<string>"), " ").alias("context"), "next", "n")


@query(
    with_(sql.EVENTS, "w AS (SELECT pos, token, lag(token) OVER o AS p1, lag(token, 2) OVER o AS p2 FROM t WINDOW o AS (PARTITION BY walk ORDER BY pos))", "c AS (SELECT coalesce(p2, -1) AS p2, p1, token, count(*) AS n FROM w WHERE pos > 0 GROUP BY ALL)",
          "c1 AS (SELECT p1, token, sum(n) AS n FROM c GROUP BY ALL)",
          "q AS (SELECT c.n AS k, CASE WHEN p2 >= 0 THEN c.n ELSE c1.n END AS n, CASE WHEN p2 >= 0 THEN sum(c.n) OVER (PARTITION BY p2, c.p1) ELSE (SELECT sum(n) FROM c1 z WHERE z.p1 = c.p1) END AS total FROM c JOIN c1 ON c1.p1 = c.p1 AND c1.token = c.token)")
    + "SELECT round(sum(-k * ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * 7))) / sum(k), 6) AS nll, sum(k)::BIGINT AS tokens, round(exp(sum(-k * ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * 7))) / sum(k)), 6) AS perplexity FROM q"
)
def model_nll(spark, d):
    rows = kept(tables.event_walks(spark, d))
    return models.negative_log_likelihood(models.train(rows, VERTICES), rows).select(F.round("nll", 6).alias("nll"), "tokens", F.round("perplexity", 6).alias("perplexity"))


@query(with_(sql.EVENTS, sql.generated(3, 500, 17, True), recursive=True) + "SELECT walk, array_to_string(tokens, ' ') AS tokens FROM gw")
def generated_facial_walks(spark, d):
    model = models.train(kept(tables.event_walks(spark, d)), VERTICES)
    rows = models.generate_walks(model, 500, length=17, walk_type="facial", seed=3)
    return rows.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), " "))


@query(with_(sql.EVENTS, sql.generated(3, 500, 12, False), recursive=True) + "SELECT walk, array_to_string(tokens, ' ') AS tokens FROM gw")
def generated_random_walks(spark, d):
    model = models.train(kept(tables.event_walks(spark, d)), VERTICES)
    rows = models.generate_walks(model, 500, length=12, walk_type="random", block=8, seed=3)
    return rows.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), " "))


@query(
    with_(sql.EVENTS, sql.generated(5, 500, 12, False), "pl AS (SELECT unnest(tokens[2:11]) AS u, unnest(tokens[3:12]) AS v FROM gw)", recursive=True)
    + "SELECT u, v, count(*)::DOUBLE AS w FROM pl WHERE u <> v GROUP BY ALL"
)
def model_transition_counts(spark, d):
    model = models.train(kept(tables.event_walks(spark, d)), VERTICES)
    return models.model_transition_counts(model, 500, length=12, walk_type="random", seed=5)


# histories and reports


def history(spark, d) -> DataFrame:
    """A run for each user: epochs are places, the validation score is the event's value, in every 7th epoch none."""
    events = tables.table(spark, d, "events")
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("epoch")
    own = events.select(F.col("user_id").alias("run"), place, F.round("value", 3).alias("value"), "event_type")
    return own.select("run", "epoch", F.when(F.col("epoch") % 7 != 0, F.col("value")).alias("val_score"), "event_type")


_HISTORY = "hi AS MATERIALIZED (SELECT user_id AS run, row_number() OVER o - 1 AS epoch, CASE WHEN (row_number() OVER o - 1) % 7 <> 0 THEN round(value, 3) END AS val_score, event_type FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(with_(_HISTORY) + "SELECT run, epoch AS best_epoch, val_score AS best_val_score FROM hi WHERE val_score IS NOT NULL AND epoch > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_score DESC, epoch) = 1")
def best_epochs(spark, d):
    return reports.best_epoch(history(spark, d), ["run"]).select("run", F.col("epoch").alias("best_epoch"), F.col("val_score").alias("best_val_score"))


@query(
    with_(
        _HISTORY,
        "mo AS (SELECT run, max(epoch) AS most FROM hi GROUP BY run)",
        """s(run, epoch, best, best_epoch, bad, stop_epoch) AS (SELECT run, -1::BIGINT, '-infinity'::DOUBLE, NULL::BIGINT, 0::BIGINT, NULL::BIGINT FROM mo UNION ALL
 SELECT s.run, hi.epoch, CASE WHEN stop_epoch IS NULL AND coalesce(val_score > best + 0.01::DOUBLE, false) THEN val_score ELSE best END,
  CASE WHEN stop_epoch IS NULL AND coalesce(val_score > best + 0.01::DOUBLE, false) THEN hi.epoch ELSE best_epoch END,
  CASE WHEN stop_epoch IS NOT NULL THEN bad WHEN coalesce(val_score > best + 0.01::DOUBLE, false) THEN 0 ELSE bad + 1 END,
  CASE WHEN stop_epoch IS NOT NULL THEN stop_epoch WHEN coalesce(val_score > best + 0.01::DOUBLE, false) THEN NULL WHEN bad + 1 >= 5 THEN hi.epoch END
 FROM s JOIN hi ON hi.run = s.run AND hi.epoch = s.epoch + 1)""",
        recursive=True,
    )
    + "SELECT s.run, best, best_epoch, bad, stop_epoch FROM s JOIN mo ON mo.run = s.run AND mo.most = s.epoch"
)
def early_stopping(spark, d):
    rows = history(spark, d).select("run", "epoch", F.col("val_score").alias("value"))
    return linkpred.early_stopping(rows, patience=5, min_delta=0.01, by=["run"])


@query(with_(_HISTORY) + "SELECT run, count(*) FILTER (event_type = 'click')::BIGINT AS \"n[click]\", round(min(val_score) FILTER (event_type = 'click'), 3) AS \"min[click]\", count(*) FILTER (event_type = 'purchase')::BIGINT AS \"n[purchase]\", round(min(val_score) FILTER (event_type = 'purchase'), 3) AS \"min[purchase]\" FROM hi GROUP BY run")
def diagnostics_by_split(spark, d):
    rows = history(spark, d).groupBy("run", F.col("event_type").alias("split")).agg(F.count("*").alias("n"), F.round(F.min("val_score"), 3).alias("min"))
    out = reports.pivot_diagnostics(rows, ["run"], ["click", "purchase"], ["n", "min"])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n[click]", "n[purchase]")})


@query(with_(_HISTORY) + "SELECT run || ' | ' || coalesce(val_score::VARCHAR, '') AS label, row_number() OVER (ORDER BY val_score DESC NULLS LAST, run, epoch) AS place FROM hi")
def sorted_labels(spark, d):
    rows = history(spark, d)
    rows = graph.numbered(rows, *reports.sort_keys([("val_score", False), ("run", True), ("epoch", True)]), name="place")
    return rows.select(reports.label(["run", "val_score"]).alias("label"), (F.col("place") + 1).alias("place"))


@query(with_(_HISTORY) + "SELECT event_type, run, epoch FROM hi QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY run, epoch) = 1")
def first_rows(spark, d):
    return reports.first_of_group(history(spark, d), ["event_type"], ["run", "epoch"]).select("event_type", "run", "epoch")


# streaming


@query(with_(sql.EVENTS, _EVENT_DARTS) + "SELECT u, v, count(*)::DOUBLE AS w FROM x WHERE u <> v GROUP BY ALL")
def streamed_transition_counts(spark, d):
    return streaming.counts_of_stream(spark, d)
