"""Rotation systems and the faces they trace, in long form.

rotation(config, u, pos, v): the neighbours of u in cyclic order. pi(config, u, v, nxt): the neighbour after v
at u. faces(config, face, pos, u, v): the orbits of (u, v) -> (nxt, u). Orbits are found by pointer doubling:
as many joins as the logarithm of the longest orbit, whatever the number of darts or configs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import rand01
from dartline.operators.graph import darts, numbered
from dartline.plans.work import Work

#: Decimals of curvature that decide an order; less than that is round-off, and ids break the tie.
DIGITS = 9


def sign_of(value: Column) -> Column:
    """1 for positive numbers and true, -1 for all others, 0 too."""
    return F.when(value.cast("double") > 0, 1).otherwise(-1)


def sample_signs(nodes: DataFrame, configs: int, seed: int | str) -> DataFrame:
    """config, id, sign: uniform -1 or 1 for each node in each of the configs."""
    rows = nodes.select("id").withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1))))
    return rows.select("config", "id", F.when(rand01(seed, F.col("config"), F.col("id")) < 0.5, -1).otherwise(1).alias("sign"))


def rotation_from_curvature_signs(edges: DataFrame, curvature: DataFrame, signs: DataFrame) -> DataFrame:
    """At u, neighbours by sign(u) * curvature(v), then v. curvature: id, kappa; signs: [config,] id, sign."""
    if "config" not in signs.columns:
        signs = signs.withColumn("config", F.lit(0))
    signs = signs.select("config", F.col("id").alias("u"), sign_of(F.col("sign")).alias("s"))
    kappa = curvature.select(F.col("id").alias("v"), F.round("kappa", DIGITS).alias("k"))
    rows = darts(edges).join(kappa, "v").join(signs, "u")
    w = Window.partitionBy("config", "u").orderBy(F.col("s") * F.col("k"), "v")
    return rows.select("config", "u", (F.row_number().over(w) - 1).alias("pos"), "v")


def random_rotation(edges: DataFrame, seed: int | str, configs: int = 1) -> DataFrame:
    """Neighbours of each node in an order of hashes, one for each config."""
    rows = darts(edges).withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1))))
    w = Window.partitionBy("config", "u").orderBy(rand01(seed, F.col("config"), F.col("u"), F.col("v")), "v")
    return rows.select("config", "u", (F.row_number().over(w) - 1).alias("pos"), "v")


def pi_from_rotation(rotation: DataFrame) -> DataFrame:
    """config, u, pos, v, nxt: the last neighbour is followed by the first, an only one by itself."""
    w = Window.partitionBy("config", "u").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rotation.select("config", "u", "pos", "v", F.coalesce(F.lead("v").over(w), F.first("v").over(whole)).alias("nxt"))


def orbits(links: DataFrame) -> DataFrame:
    """id, orbit, pos of a permutation id -> nxt of longs: orbit is its smallest id, which has pos 0."""
    work = Work(links.sparkSession)
    state = work.keep(links.select("id", "nxt", F.least("id", "nxt").alias("m")))
    last = None
    while True:
        total = state.agg(F.sum("m").alias("s")).first()["s"]
        if total == last:  # labels only fall: no label has changed
            break
        last = total
        ahead = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("m").alias("m2"))
        old, state = state, work.keep(state.join(ahead, "nxt").select("id", F.col("nxt2").alias("nxt"), F.least("m", "m2").alias("m")))
        work.drop(old)
    labels = state.select("id", F.col("m").alias("orbit"))
    # list ranking: cut the orbit before its first, then double the distances to its end
    rank = links.select("id", "nxt").join(labels, "id").select("id", "orbit", F.when(F.col("nxt") != F.col("orbit"), F.col("nxt")).alias("nxt"))
    rank = work.keep(rank.withColumn("d", F.when(F.col("nxt").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")))
    while not rank.where("nxt is not null").isEmpty():
        ahead = rank.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("d").alias("d2"))
        step = rank.join(ahead, "nxt", "left").select("id", "orbit", F.col("nxt2").alias("nxt"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        old, rank = rank, work.keep(step)
        work.drop(old)
    length = rank.groupBy("orbit").agg(F.count("*").alias("n"))
    return rank.join(length, "orbit").select("id", "orbit", (F.col("n") - 1 - F.col("d")).alias("pos"))


def faces_from_pi(pi: DataFrame, seed: int | None = None) -> DataFrame:
    """config, face, pos, u, v. Faces are numbered in each config by their first dart, which they start with.

    Darts come in the order of u and of the place in the rotation (without `pos`: of v); with a seed, in an order of
    hashes. A dart whose successor isn't a dart is a ValueError.
    """
    pi = pi if "pos" in pi.columns else pi.withColumn("pos", F.col("v"))
    order = ["config", "u", "pos"] if seed is None else ["config", rand01(seed, F.col("config"), F.col("u"), F.col("v")), "u", "v"]
    work = Work(pi.sparkSession)
    ids = work.keep(numbered(pi.select("config", "u", "pos", "v", "nxt"), *order, name="id"))
    target = ids.select("config", F.col("u").alias("nxt"), F.col("v").alias("u"), F.col("id").alias("to"))
    links = ids.join(target, ["config", "nxt", "u"], "left").select("id", F.col("to").alias("nxt"))
    links = work.keep(links)
    if not links.where("nxt is null").isEmpty():
        raise ValueError("the successor of a dart is not a dart")
    found = orbits(links)
    rows = ids.select("config", "u", "v", "id").join(found, "id")
    starts = numbered(rows.where("id = orbit").select("config", "orbit"), "orbit", name="face")
    base = starts.groupBy("config").agg(F.min("face").alias("base"))
    starts = starts.join(base, "config").select("orbit", (F.col("face") - F.col("base")).alias("face"))
    return rows.join(starts, "orbit").select("config", "face", "pos", "u", "v")


def faces_from_rotation(rotation: DataFrame, seed: int | None = None) -> DataFrame:
    return faces_from_pi(pi_from_rotation(rotation), seed)


def rotation_from_pi(pi: DataFrame) -> DataFrame:
    """The rotation of pi, at each node from its smallest neighbour on.

    At a node, the neighbours and their successors must be the same set and one cycle; else ValueError.
    """
    rows = numbered(pi.select("config", "u", "v", "nxt"), "config", "u", "v", name="id")
    rows = Work(pi.sparkSession).keep(rows)
    target = rows.select("config", "u", F.col("v").alias("nxt"), F.col("id").alias("to"))
    links = rows.join(target, ["config", "u", "nxt"], "left")
    bad = links.groupBy("config", "u").agg(F.count_if(F.col("to").isNull()).alias("lost"), F.countDistinct("nxt").alias("d"), F.count("*").alias("n")).where("lost > 0 or d < n")
    if not bad.isEmpty():
        raise ValueError("pi does not permute the neighbours of a node")
    found = rows.join(orbits(links.select("id", F.col("to").alias("nxt"))), "id")
    if not found.groupBy("config", "u").agg(F.countDistinct("orbit").alias("n")).where("n > 1").isEmpty():
        raise ValueError("pi is not one cycle at a node")
    return found.select("config", "u", "pos", "v")


def all_darts(rows: DataFrame) -> DataFrame:
    """Darts of a rotation, of pi or of faces."""
    return rows.select("config", "u", "v")


def facial_successor(darts_: DataFrame, pi: DataFrame) -> DataFrame:
    """config, u, v and the dart after it, u2 and v2."""
    nxt = pi.select("config", "u", "v", "nxt")
    return darts_.select("config", "u", "v").join(nxt, ["config", "u", "v"]).select("config", "u", "v", F.col("nxt").alias("u2"), F.col("u").alias("v2"))


def check_faces(faces: DataFrame, pi: DataFrame) -> bool:
    """Whether the faces hold every dart of pi once and nothing else."""
    have, want = all_darts(faces), all_darts(pi)
    return have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()


def facial_walks(rotation: DataFrame, seed: int | None = None, check: bool = True) -> DataFrame:
    """Faces of a rotation; with check, faces that don't partition the darts are a ValueError."""
    pi = pi_from_rotation(rotation)
    found = Work(rotation.sparkSession).keep(faces_from_pi(pi, seed))
    if check and not check_faces(found, pi):
        raise ValueError("the faces do not partition the darts")
    return found


def facial_walks_from_curvature_signs(edges: DataFrame, curvature: DataFrame, signs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(faces, rotation) of sorted neighbours."""
    rotation = rotation_from_curvature_signs(edges, curvature, signs)
    return facial_walks(rotation, **options), rotation


def config_faces(edges: DataFrame, method: str, *, curvature: DataFrame | None = None, signs: DataFrame | None = None, configs: int = 1, seed: int | str = 0) -> DataFrame:
    """Faces by walk method: random_rotations shuffles (always seeded), all others sort by curvature."""
    if method == "random_rotations":
        return faces_from_rotation(random_rotation(edges, seed, configs))
    return facial_walks_from_curvature_signs(edges, curvature, signs)[0]


def epoch_faces(edges: DataFrame, nodes: DataFrame, method: str, *, curvature: DataFrame, configs: int, seed: int, epoch: int) -> DataFrame:
    """Faces of signs, or of shuffles, that are drawn anew in each epoch."""
    key = f"{seed}:{epoch}"
    return config_faces(edges, method, curvature=curvature, signs=sample_signs(nodes, configs, key), configs=configs, seed=key)


def face_arrays(faces: DataFrame) -> DataFrame:
    """config, face, darts: each face as an array of (u, v)."""
    rows = faces.groupBy("config", "face").agg(F.sort_array(F.collect_list(F.struct("pos", "u", "v"))).alias("d"))
    return rows.select("config", "face", F.transform("d", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("darts"))


def dart_face_to_vertex_sequence(face: Column) -> Column:
    """u and v of the first dart, then u of the others; an empty face is empty."""
    rest = F.transform(F.slice(face, 2, F.greatest(F.size(face) - 1, F.lit(0))), lambda d: d["u"])
    return F.when(F.size(face) > 0, F.concat(F.array(F.get(face, 0)["u"], F.get(face, 0)["v"]), rest)).otherwise(F.slice(F.transform(face, lambda d: d["u"]), 1, 0))


def face_vertex_sequences(faces: DataFrame) -> DataFrame:
    """config, face, seq_id, tokens: u v of every dart, two tokens a dart, no begin or end marks.

    seq_id numbers the faces of all configs, 0, 1, ...
    """
    rows = face_arrays(faces)
    tokens = F.flatten(F.transform("darts", lambda d: F.array(d["u"], d["v"])))
    return numbered(rows.select("config", "face", tokens.alias("tokens")), "config", "face", name="seq_id")


def face_lengths(faces: DataFrame) -> DataFrame:
    return faces.groupBy("config", "face").agg(F.count("*").alias("length"))


def face_count_summary(lengths: DataFrame, method: str) -> DataFrame:
    """Faces by config over a method's configs: mean, population std, min and max."""
    n = lengths.groupBy("config").agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max")).select(F.lit(method).alias("method"), "*")


def face_length_summary(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.avg("length").alias("mean"), F.percentile("length", F.lit(0.5)).alias("median"), F.max("length").alias("max"), F.count("*").alias("count"))


def face_length_histogram(lengths: DataFrame, bins: int = 60) -> DataFrame:
    """bin 1..bins and its faces, over equal bins from the shortest to the longest."""
    ends = lengths.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("length") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).otherwise(1)
    return lengths.crossJoin(ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("faces"))


def face_count_sweep(counts: DataFrame, by: list[str], methods: list[str]) -> DataFrame:
    """Mean faces by parameters, a column for each method."""
    return counts.groupBy(*by).pivot("method", methods).agg(F.avg("faces"))
