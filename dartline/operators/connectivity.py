"""Connected components, distances and spanning trees by iterative joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dartline.plans.work import Work


#: Edges up to which components are found by one task, over arrays of 16 bytes an edge.
LOCAL_EDGES = 2_000_000


def smallest_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges in order, and the smallest node of each one's component.

    Roots are hooked onto the smallest root next to them and paths made short: at least half of a component's roots
    go in a round.
    """
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        left = low < high
        a, b = a[left], b[left]
        np.minimum.at(root, high[left], low[left])
        while not np.array_equal(root, further := root[root]):
            root = further
    return ids, ids[root]


def local_components(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), in one task."""

    def run(batches):
        import pyarrow as pa

        ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if ends:
            ids, least = smallest_nodes(*map(np.concatenate, zip(*ends, strict=True)))
            for start in range(0, len(ids), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(x[start : start + SLICE]) for x in (ids, least)], names=["node", "component"])

    found = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, component long")
    return found.select(*(F.col(c).cast(edges.schema["u"].dataType) for c in found.columns))


def components(edges: DataFrame, a: str = "u", b: str = "v", local_edges: int | None = None) -> DataFrame:
    """(node, component) of the nodes of undirected edges; component is its smallest node.

    Alternating star contraction: the large star links each node's larger neighbours to its smallest
    neighbour, the small star its smaller ones. Edges never grow, the rounds grow with the logarithm of
    the diameter, and no node's neighbours are ever gathered in one place. Loops and nulls are left out.
    Up to local_edges edges (LOCAL_EDGES by default) between whole numbers need no rounds, of which each is eight stages
    for the driver to plan and follow: one task finds the same components.
    """
    work = Work(edges.sparkSession)
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    now, last = work.keep(now), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not last and state["n"] <= local_edges and now.schema["u"].dataType.typeName() in ("byte", "short", "integer", "long"):
            found = work.keep(local_components(now))
            work.drop(now)
            return found
        if last and state == last[0]:
            work.drop(last[1])
            break
        if last:
            work.drop(last[1])
        last = (state, now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def node_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component of all nodes; an isolated node is its own component."""
    found = components(edges)
    return nodes.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_connected_component(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the component with the most nodes; among equals the one with the smallest id."""
    own = Work(edges.sparkSession).keep(node_components(edges, nodes))
    best = own.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    ids = own.join(F.broadcast(best), "component", "left_semi").select("id")  # one row
    return edges.join(ids, edges.u == ids.id, "left_semi"), nodes.join(ids, "id", "left_semi")


def component_count(edges: DataFrame, nodes: DataFrame) -> int:
    return node_components(edges, nodes).select("component").distinct().count()


def require_connected(edges: DataFrame, nodes: DataFrame) -> None:
    if component_count(edges, nodes) != 1:
        raise ValueError("the graph is not connected")


#: Steps up to which a breadth-first search sends the whole graph to its tasks (4 bytes a step, 8 if directed).
LOCAL_STEPS = 8_000_000
#: Nodes whose rows are made at a time (64 rows each at most), and neighbours looked at one by one for a predecessor.
SLICE, TRIED = 1 << 14, 64
LITTLE = np.dtype("<u8")


def local_arrays(u: np.ndarray, v: np.ndarray, directed: bool) -> tuple:
    """ids, into, out: a graph's ids in order, and where each begins in the numbers of those before and after it, ascending."""
    ids = np.unique(np.concatenate([u, v]))
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    if not directed:
        u, v = np.concatenate([u, v]), np.concatenate([v, u])
    n = max(len(ids), 1)

    def lists(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(own * n + other)
        return (key % n).astype(np.int32), np.searchsorted(key, np.arange(len(ids) + 1) * n)

    return ids, lists(v, u), lists(u, v) if directed else None


class LocalGraph:
    """Searches over local_arrays, which are sent without this class."""

    def __init__(self, ids: np.ndarray, into: tuple[np.ndarray, np.ndarray], out: tuple[np.ndarray, np.ndarray] | None):
        self.ids, self.into, self.out = ids, into, out or into

    def places(self, side: tuple[np.ndarray, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the nodes' lists one after the other, and where each begins among them."""
        begins = side[1]
        n = begins[nodes + 1] - begins[nodes]
        first = np.cumsum(n) - n
        return np.repeat(begins[nodes] - first, n) + np.arange(n.sum()), first

    def levels(self, at: np.ndarray, rounds: int | None = None):
        """Breadth first from up to 64 nodes at once, a bit for each: (d, nodes first reached, their bits, all bits reached at d - 1)."""
        into, begins = self.into
        known = np.zeros(len(self.ids), LITTLE)
        known[at] = np.uint64(1) << np.arange(len(at), dtype=np.uint64)
        full = np.uint64((1 << len(at)) - 1)
        front, nodes, d = known.copy(), np.sort(at), 0
        entered = np.flatnonzero(begins[1:] > begins[:-1])
        while len(nodes) and (rounds is None or d < rounds):
            d += 1
            out, after = self.out
            if 4 * int((after[nodes + 1] - after[nodes]).sum()) < len(out):
                to = np.unique(out[self.places(self.out, nodes)[0]])
                to = to[known[to] != full]
            else:
                to = entered[known[entered] != full]
            if not len(to):
                return
            if len(to) == len(entered):
                new = np.bitwise_or.reduceat(front[into], begins[to])
            else:
                place, first = self.places(self.into, to)
                new = np.bitwise_or.reduceat(front[into[place]], first)
            new &= ~known[to]
            hit = new != 0
            nodes, new = to[hit].astype(np.int64), new[hit]
            if len(nodes):
                yield d, nodes, new, front
            known[nodes] |= new
            front[:] = 0
            front[nodes] = new

    def predecessors(self, nodes: np.ndarray, need: np.ndarray, front: np.ndarray):
        """(nodes, bits, predecessors), every bit of need once, with the node's smallest predecessor that has it in front."""
        into, begins = self.into
        for k in range(TRIED):
            if not len(nodes):
                return
            last = into[begins[nodes] + k]
            got = need & front[last]
            yield nodes, got, last
            need = need & ~got
            more = need != 0
            nodes, need = nodes[more], need[more]
        for node, own in zip(nodes.tolist(), need.tolist(), strict=True):
            last = into[begins[node] + TRIED : begins[node + 1]]
            bits = front[last]
            while own:
                k = int(np.argmax((bits & np.uint64(own)) != 0))
                got = own & int(bits[k])
                yield np.array([node]), np.array([got], LITTLE), last[k : k + 1]
                own &= ~got


def set_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bits stand: their rows and numbers."""
    return np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def graph_arrays(steps: DataFrame, directed: bool) -> tuple:
    pairs = (steps if directed else steps.where("u < v")).select("u", "v").toArrow()
    return local_arrays(*(pairs.column(c).to_numpy() for c in ("u", "v")), directed)


def searched(steps: DataFrame, sources: DataFrame, directed: bool, fn, schema: str) -> DataFrame:
    """fn(graph, sources) -> Arrow batches, over up to 64 sources at a time; the graph goes to every task."""
    sent = steps.sparkSession.sparkContext.broadcast(graph_arrays(steps, directed))

    def run(batches):
        graph = LocalGraph(*sent.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start in range(0, len(ids), 64):
                yield from fn(graph, ids[start : start + 64])

    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = sources.select(F.col("id").cast("long")).where("id is not null").distinct().repartition(tasks, F.xxhash64("id"))  # by id alone it is left out, and few tasks stay
    return own.mapInArrow(run, schema)


def known_nodes(graph: LocalGraph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sources that are nodes of the graph, and their numbers."""
    at = np.searchsorted(graph.ids, sources)
    own = at < len(graph.ids)
    own[own] = graph.ids[at[own]] == sources[own]
    return sources[own], at[own]


def local_distances(steps: DataFrame, sources: DataFrame, rounds: int | None, directed: bool, predecessors: bool) -> DataFrame:
    """Breadth-first distances of few steps (u, v): each task searches from its own sources over arrays of the graph."""
    names = ["i", "j", "d", "pred"] if predecessors else ["i", "j", "d"]

    def batch(*columns):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    def fn(graph, sources):
        import pyarrow as pa

        yield batch(sources, sources, np.zeros(len(sources), np.int32), *([pa.nulls(len(sources), pa.int64())] if predecessors else []))
        own, at = known_nodes(graph, sources)
        for d, nodes, bits, front in graph.levels(at, rounds):
            for start in range(0, len(nodes), SLICE):
                parts = [(nodes[start : start + SLICE], bits[start : start + SLICE], None)]
                found = []
                for node, got, last in graph.predecessors(*parts[0][:2], front) if predecessors else parts:
                    row, bit = set_bits(got)
                    found.append((own[bit], graph.ids[node[row]], *([graph.ids[last[row]]] if predecessors else [])))
                i, j, *pred = map(np.concatenate, zip(*found, strict=True))
                yield batch(i, j, np.full(len(i), d, np.int32), *pred)

    return searched(steps, sources, directed, fn, "i long, j long, d int" + ", pred long" * predecessors)


def local_counts(steps: DataFrame, sources: DataFrame, rounds: int | None, directed: bool) -> DataFrame:
    """d and n: numbers of pairs at each distance d > 0, in parts, counted without a row a pair."""

    def fn(graph, sources):
        import pyarrow as pa

        found = [(d, int(np.bitwise_count(bits).sum(dtype=np.int64))) for d, _, bits, _ in graph.levels(known_nodes(graph, sources)[1], rounds)]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["d", "n"])

    return searched(steps, sources, directed, fn, "d int, n long")


def search_steps(edges: DataFrame, directed: bool = False, weight: str | None = None) -> DataFrame:
    """u, v, length: the shortest step of each pair, in both directions unless directed; kept."""
    columns = ["u", "v", *([weight] if weight else [])]
    steps = edges.select(*columns)
    if not directed:
        steps = steps.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *columns[2:]))
    length = F.col(weight).cast("double") if weight else F.lit(1)
    steps = steps.select("u", "v", length.alias("length"))
    return Work(edges.sparkSession).keep(steps.groupBy("u", "v").agg(F.min("length").alias("length")))


def distances(edges: DataFrame, sources: DataFrame, *, directed: bool = False, weight: str | None = None, rounds: int | None = None, local_steps: int = LOCAL_STEPS, predecessors: bool = True) -> DataFrame:
    """i, j, d, pred: shortest distances from each source (column id) to all it reaches, itself at 0.

    pred is the smallest last step of a shortest path (null at the source); without predecessors there is no such
    column. Unweighted: breadth first, a join a round, each pair found once. With weights (at least 0): relaxation until
    nothing improves. Rows grow with sources times nodes; give few sources to large graphs. A graph of up to local_steps
    steps goes to the tasks whole, which search from 64 sources at once over arrays; larger ones are searched by joins.
    """
    work = Work(edges.sparkSession)
    steps = search_steps(edges, directed, weight)
    if not weight and steps.count() <= local_steps:
        return local_distances(steps, sources, rounds, directed, predecessors)
    zero = F.lit(0.0) if weight else F.lit(0)
    first = sources.select(F.col("id").alias("i"), F.col("id").alias("j"), zero.alias("d"), F.lit(None).cast("long").alias("pred")).distinct()
    known = frontier = work.keep(first)
    before, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        reached = frontier.join(steps, frontier.j == steps.u).select("i", F.col("v").alias("j"), (F.col("d") + F.col("length")).alias("d"), F.col("u").alias("pred"))
        best = reached.groupBy("i", "j").agg(F.min(F.struct("d", "pred")).alias("b")).select("i", "j", "b.d", "b.pred")
        if not weight:
            # both ways, a step from distance d leads to d - 1, d or d + 1: only those rows are compared
            seen = known if directed or before is None else frontier.unionByName(before)
            before, frontier = frontier, work.keep(best.join(seen.select("i", "j"), ["i", "j"], "left_anti"))
            if frontier.isEmpty():
                break
            known = known.unionByName(frontier)
        else:
            old = known.select("i", "j", F.col("d").alias("old"))
            better = best.join(old, ["i", "j"], "left").where("old is null or d < old").drop("old")
            frontier = work.keep(better)
            if frontier.isEmpty():
                break
            both = known.unionByName(frontier)
            known = work.keep(both.groupBy("i", "j").agg(F.min(F.struct("d", "pred")).alias("b")).select("i", "j", "b.d", "b.pred"))
    return known if predecessors else known.drop("pred")


def distance_counts(edges: DataFrame, sources: DataFrame, *, directed: bool = False, rounds: int | None = None, local_steps: int = LOCAL_STEPS) -> DataFrame:
    """d and n: how many pairs of a source and another node it reaches are d > 0 apart, breadth first."""
    steps = search_steps(edges, directed)
    if steps.count() <= local_steps:
        found = local_counts(steps, sources, rounds, directed)
    else:
        found = distances(edges, sources, directed=directed, rounds=rounds, local_steps=local_steps, predecessors=False).where("d > 0").groupBy("d").agg(F.count("*").alias("n"))
    return found.groupBy("d").agg(F.sum("n").alias("n"))


def distance_matrix(edges: DataFrame, nodes: DataFrame, *, check_connected: bool = True, **options) -> DataFrame:
    """All pairs' distances in long form; by default a graph that isn't connected is a ValueError."""
    if check_connected:
        require_connected(edges, nodes)
    return distances(edges, nodes, **options)


def characteristic_path_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row, path_length: the mean distance over ordered pairs of the largest component, 0.0 if it has none."""
    own, ids = largest_connected_component(edges, nodes)
    mean = F.try_divide(F.sum(F.col("d") * F.col("n")).cast("double"), F.sum("n"))
    return distance_counts(own, ids).agg(F.coalesce(mean, F.lit(0.0)).alias("path_length"))


def spanning_tree(edges: DataFrame, root: int | None = None) -> DataFrame:
    """Edges of the breadth-first tree from the root, by default the smallest node; parents are the smallest possible."""
    if root is None:
        source = edges.agg(F.min("u").alias("id")).where("id is not null")
    else:
        source = edges.sparkSession.createDataFrame([(root,)], "id long")
    tree = distances(edges, source).where("pred is not null")
    return tree.select(F.least("j", "pred").alias("u"), F.greatest("j", "pred").alias("v"))
