import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dartline.operators import rotation as r
from dartline.operators import scores as sc
from dartline.operators import tokens as t
from dartline.operators import walks as w
from tests.engine.graphs import KAPPA, TOY, graph, rows

SIGNS = {
    "++++": ["01 20 32 13", "02 10 21", "12 31 23"],
    "----": ["02 10 31 23", "01 20 12", "13 21 32"],
    "+-++": ["01 20 32 13 21 02 10 31 23 12"],
    "-++-": ["02 10 21", "01 20 32 13", "12 31 23"],
}


def toy(spark):
    e, n = graph(spark, TOY)
    kappa = spark.createDataFrame(list(enumerate(KAPPA)), "id long, kappa double")
    return e, n, kappa


def signs(spark, texts):
    return spark.createDataFrame([(c, i, 1 if x == "+" else -1) for c, text in enumerate(texts) for i, x in enumerate(text)], "config int, id long, sign int")


def face_texts(faces):
    out = {}
    for x in r.face_arrays(faces).orderBy("config", "face").collect():
        out.setdefault(x["config"], []).append(" ".join(f"{d['u']}{d['v']}" for d in x["darts"]))
    return out


def walk_orbits(pi):
    """Faces in plain Python: (u, v) -> (pi(u, v), u) from the first dart not yet seen."""
    out, seen = [], set()
    for dart in pi:
        face = []
        while dart not in seen:
            seen.add(dart)
            face.append(dart)
            dart = (pi[dart], dart[0])
        if face:
            out.append(face)
    return out


def test_faces_of_toy(spark):
    e, _, kappa = toy(spark)
    faces, rotation = r.facial_walks_from_curvature_signs(e, kappa, signs(spark, SIGNS))
    got = face_texts(faces)
    for c, want in enumerate(SIGNS.values()):
        assert sorted(" ".join(f) for f in map(str.split, got[c])) == sorted(want)
    at1 = {c: [v for _, v in sorted((x["pos"], x["v"]) for x in rotation.where(f"config = {c} and u = 1").collect())] for c in range(4)}
    assert at1 == {0: [0, 2, 3], 1: [3, 2, 0], 2: [3, 2, 0], 3: [0, 2, 3]}


def test_all_sign_vectors(spark):
    e, _, kappa = toy(spark)
    texts = ["".join(x) for x in itertools.product("+-", repeat=4)]
    faces, rotation = r.facial_walks_from_curvature_signs(e, kappa, signs(spark, texts))
    counts = Counter(len(x) for x in face_texts(faces).values())
    assert counts == {3: 8, 1: 8}
    # the order of darts and faces is that of a walk from the first dart on
    pi = {}
    for x in r.pi_from_rotation(rotation).orderBy("config", "u", "pos").collect():
        pi.setdefault(x["config"], {})[x["u"], x["v"]] = x["nxt"]
    for c, got in face_texts(faces).items():
        assert got == [" ".join(f"{u}{v}" for u, v in f) for f in walk_orbits(pi[c])]


def test_signs(spark):
    e, n, kappa = toy(spark)
    zero = spark.createDataFrame([(i, 0) for i in range(4)], "id long, sign int")
    minus = spark.createDataFrame([(i, -1) for i in range(4)], "id long, sign int")
    yes = spark.createDataFrame([(i, True) for i in range(4)], "id long, sign boolean")
    plus = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, sign double")
    build = lambda s: rows(r.rotation_from_curvature_signs(e, kappa, s), "config", "u", "pos", "v")
    assert build(zero) == build(minus) and build(yes) == build(plus) != build(minus)
    drawn = r.sample_signs(spark.range(4000), 1, 5).groupBy("sign").count().collect()
    assert all(1800 < x["count"] < 2200 for x in drawn)
    rounded = kappa.withColumn("kappa", F.lit(1.5) + F.col("id") * 1e-16)  # round-off doesn't decide
    assert rows(r.rotation_from_curvature_signs(e, rounded, plus).where("u = 1"), "pos", "v") == [(0, 0), (1, 2), (2, 3)]


def test_pi_and_back(spark):
    e, _, _ = toy(spark)
    pi = r.pi_from_rotation(r.random_rotation(e, 3))
    back = r.rotation_from_pi(pi)
    assert rows(r.pi_from_rotation(back), "u", "v", "nxt") == rows(pi, "u", "v", "nxt")
    assert all(x["v"] == min(y["v"] for y in back.where(f"u = {x['u']}").collect()) for x in back.where("pos = 0").collect())
    for bad in ([(0, 0, 1, 2), (0, 0, 2, 3)], [(0, 0, 1, 1), (0, 0, 2, 2)], [(0, 0, 1, 2), (0, 0, 2, 2)]):
        with pytest.raises(ValueError):
            r.rotation_from_pi(spark.createDataFrame(bad, "config int, u long, v long, nxt long"))
    assert r.rotation_from_pi(pi.limit(0)).count() == 0
    with pytest.raises(ValueError):
        r.faces_from_pi(spark.createDataFrame([(0, 0, 1, 5)], "config int, u long, v long, nxt long"))


def test_only_neighbour_follows_itself(spark):
    e, _ = graph(spark, [(0, 1), (1, 2)])
    faces = r.facial_walks(r.random_rotation(e, 1))
    assert len(face_texts(faces)[0]) == 1 and faces.count() == 4


def test_random_scan_order(spark):
    e, _, _ = toy(spark)
    pi = r.pi_from_rotation(r.random_rotation(e, 3))
    plain, mixed = face_texts(r.faces_from_pi(pi))[0], face_texts(r.faces_from_pi(pi, seed=9))[0]
    turn = lambda f: min(tuple(f[i:] + f[:i]) for i in range(len(f)))
    assert plain != mixed and sorted(turn(f.split()) for f in plain) == sorted(turn(f.split()) for f in mixed)


def test_check_of_faces(spark):
    e, _, _ = toy(spark)
    pi = r.pi_from_rotation(r.random_rotation(e, 3))
    faces = r.faces_from_pi(pi)
    assert r.check_faces(faces, pi)
    assert not r.check_faces(faces.where("not (face = 0 and pos = 0)"), pi) and not r.check_faces(faces.unionByName(faces.limit(1)), pi)


def test_vertex_sequences(spark):
    e, _, kappa = toy(spark)
    faces, _ = r.facial_walks_from_curvature_signs(e, kappa, signs(spark, ["++++"]))
    seq = r.face_vertex_sequences(faces).orderBy("seq_id").collect()
    assert [x["tokens"] for x in seq] == [[0, 1, 2, 0, 3, 2, 1, 3], [0, 2, 1, 0, 2, 1], [1, 2, 3, 1, 2, 3]]
    short = r.face_arrays(faces).select("face", r.dart_face_to_vertex_sequence(F.col("darts")).alias("s")).orderBy("face").collect()
    assert short[0]["s"] == [0, 1, 2, 3, 1]


def test_summaries(spark):
    e, _, kappa = toy(spark)
    faces, _ = r.facial_walks_from_curvature_signs(e, kappa, signs(spark, ["++++", "+-++"]))
    n = r.face_lengths(faces)
    assert tuple(r.face_count_summary(n, "m").first()) == ("m", 2.0, 1.0, 1, 3)
    assert tuple(r.face_length_summary(n).first()) == (5.0, 3.5, 10, 4)
    assert rows(r.face_length_histogram(n, 7), "bin", "faces") == [(1, 2), (2, 1), (7, 1)]


# chunks


@pytest.mark.parametrize("context, configs, sign_seed, epoch_seed", [(5, 2, 11, 19), (7, 1, 5, 13), (32, 1, 17, 23)])
def test_face_chunks_are_turned_windows(spark, context, configs, sign_seed, epoch_seed):
    e, n, kappa = toy(spark)
    faces, _ = r.facial_walks_from_curvature_signs(e, kappa, r.sample_signs(n, configs, sign_seed))
    seq = r.face_vertex_sequences(faces)
    width, whole = (context - 1) // 2, {x["seq_id"]: x["tokens"] for x in seq.collect()}
    epochs = []
    for epoch in (0, 1):
        chunks = t.face_chunks(seq, context=context, seed=epoch_seed, bos=4, epoch=epoch).collect()
        epochs.append(sorted((c["face_index"], c["chunk_index"], tuple(c["tokens"])) for c in chunks))
        for c in chunks:
            face = whole[c["face_index"]]
            darts = [tuple(face[i : i + 2]) for i in range(0, len(face), 2)]
            body = c["tokens"][1 : -1 if c["has_eos"] else None]
            own = [tuple(body[i : i + 2]) for i in range(0, len(body), 2)]
            assert c["tokens"][0] == 4 and len(c["tokens"]) <= max(context, 2 * len(darts) + 2) and len(own) == c["dart_length"]
            assert any(own == [darts[(s + c["chunk_start"] + i) % len(darts)] for i in range(len(own))] for s in range(len(darts)))
            assert c["has_eos"] == (len(darts) <= width) and (not c["has_eos"] or c["tokens"][-1] == 5)
            assert c["num_chunks_for_face"] == max(1, len(darts) // width) and c["is_terminal"] == (c["chunk_index"] == c["num_chunks_for_face"] - 1)
    if width < 3:
        assert epochs[0] != epochs[1]
    online = t.face_chunks(seq, context=context, seed=epoch_seed, bos=4, online=True).collect()
    assert not any(c["has_eos"] for c in online)


def test_small_contexts(spark):
    e, n, kappa = toy(spark)
    seq = r.face_vertex_sequences(r.facial_walks_from_curvature_signs(e, kappa, signs(spark, ["++++"]))[0])
    with pytest.raises(ValueError):
        t.face_chunks(seq, context=2, seed=1, bos=4)
    assert {len(c["tokens"]) for c in t.face_chunks(seq, context=2, seed=1, bos=4, online=True).collect()} == {3}
    assert (t.generation_length(17, "facial"), t.generation_length(2, "facial"), t.generation_length(17, "random"), t.generation_length(1, "random")) == (17, 3, 17, 2)


def test_window_starts(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 5, 9, 10)], "n long")
    got = lambda **o: [x[0] for x in df.orderBy("n").select(t.window_starts(F.col("n"), 4, 3, **o)).collect()]
    assert got() == [[0], [0], [0], [0, 3], [0, 3, 6]]
    assert got(allow_tail_overlap=True) == [[0], [0], [0, 1], [0, 3, 5], [0, 3, 6]]


def test_codecs(spark):
    df = spark.createDataFrame([([0, 1, 2, 0],), ([],)], "a array<long>")
    back = df.select(t.darts_to_tokens(t.tokens_to_darts(F.col("a"))).alias("b"), t.cyclic_slice(F.col("a"), F.lit(7), F.lit(3)).alias("c")).collect()
    assert [x["b"] for x in back] == [[0, 1, 2, 0], []] and [x["c"] for x in back] == [[0, 0, 1], []]
    with pytest.raises(Exception, match="even number"):
        spark.createDataFrame([([1],)], "a array<long>").select(t.tokens_to_darts(F.col("a"))).collect()


def test_batches(spark):
    df = spark.createDataFrame([(i, [i] * (i + 1)) for i in range(5)], "id long, tokens array<long>")
    rows_ = t.collate(t.batches(df, 2, order=["id"]), pad=9).orderBy("id").collect()
    assert rows_[0]["input_ids"] == [0, 9] and rows_[0]["attention_mask"] == [1, 0] and rows_[0]["labels"] == [0, -100]
    assert [x["batch"] for x in rows_] == [0, 0, 1, 1, 2] and rows_[4]["input_ids"] == [4] * 5
    assert t.batches(df, 2, order=["id"], shuffle=True, seed=1, drop_last=True).count() == 4


def test_measures_of_chunks(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([3],), ([],)], "tokens array<long>")
    assert t.unique_chunk_ratio(df).first()[0] == pytest.approx(2 / 3) and t.unique_chunk_ratio(df.limit(0)).first()[0] is None
    walks = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 0, 1), (2, 1, 0), (2, 1, 2)], "walk long, u long, v long")
    cover = t.dart_coverage(walks)
    assert rows(cover, "walk", "covered") == [(0, 1), (2, 3)]
    assert t.full_coverage_walk(cover, 3).first()[0] == 2 and t.full_coverage_walk(cover, 4).first()[0] is None and t.full_coverage_budget(10, 3) == 4
    pair = spark.createDataFrame([([1, 2, 3], [1, 5])], "a array<long>, b array<long>")
    assert pair.select(t.hamming(F.col("a"), F.col("b"))).first()[0] == 2


def test_online_faces_are_drawn_in_each_epoch(spark):
    """Signs, faces and chunks depend on the epoch, no chunk ends with a mark, and a rerun agrees."""
    e, n, kappa = toy(spark)
    drawn = {}
    for method in ("resistance", "random_rotations"):
        for epoch in (0, 1, 1):
            faces = r.epoch_faces(e, n, method, curvature=kappa, configs=3, seed=17, epoch=epoch)
            chunks = t.face_chunks(r.face_vertex_sequences(faces), context=5, seed=13, bos=4, epoch=epoch, online=True).collect()
            assert {c["sign_config_index"] for c in chunks} <= {0, 1, 2} and all(c["tokens"][0] == 4 and c["dart_length"] <= 2 and not c["has_eos"] for c in chunks)
            own = face_texts(faces)
            assert all(sum(len(f.split()) for f in fs) == 10 for fs in own.values()) and len(own) == 3
            assert drawn.setdefault((method, epoch), own) == own
        assert drawn[method, 0] != drawn[method, 1]
    want = r.facial_walks_from_curvature_signs(e, kappa, r.sample_signs(n, 3, "17:1"))[0]
    assert drawn["resistance", 1] == face_texts(want)


# random walks


def test_corpus(spark):
    e, n, _ = toy(spark)
    make = lambda **o: {x["face_index"]: x for x in w.random_walk_corpus(e, n, walks=8, context=6, seed=13, q=2.0, **o).collect()}
    chunks, near = make(), {(u, v) for u, v in TOY} | {(v, u) for u, v in TOY}
    for c in chunks.values():
        assert len(c["tokens"]) == 6 and c["tokens"][0] == 4 and c["dart_length"] == 4 and not c["has_eos"] and c["sign_config_index"] == -1
        assert all(p in near for p in zip(c["tokens"][1:], c["tokens"][2:]))
    same = lambda a, b: all(a[i]["tokens"] == b[i]["tokens"] for i in a)
    assert same(chunks, make(epoch=1)) and not same(make(online=True), make(online=True, epoch=1))
    with pytest.raises(ValueError):
        w.random_walk_corpus(e, spark.range(6), walks=1, context=4, seed=1)
    with pytest.raises(ValueError):
        w.second_order_steps(e, spark.createDataFrame([(0, 0)], "walk long, node long"), 1, p=0)
    assert w.corpus_size(2, 10, 10, 3) == 5 and w.corpus_size(1, 5, 6, 0) == 2 and w.corpus_size(0, 5, 6, 7) == 7


def test_second_order_odds(spark):
    """From 1 to 2: back to 1 weighs 1/p, 0 and 3 are next to 1."""
    e, _ = graph(spark, [*TOY, (2, 4)])
    starts = spark.range(6000).select(F.col("id").alias("walk"), F.lit(1).alias("node"))
    steps = w.second_order_steps(e, starts, 2, p=0.5, q=4.0, key=(1,))
    paths = steps.groupBy("walk").agg(F.max(F.when(F.col("pos") == 1, F.col("node"))).alias("a"), F.max(F.when(F.col("pos") == 2, F.col("node"))).alias("b"))
    got = Counter(x["b"] for x in paths.where("a = 2").collect())
    weight = {1: 2.0, 0: 1.0, 3: 1.0, 4: 0.25}
    for node, x in weight.items():
        assert got[node] / sum(got.values()) == pytest.approx(x / 4.25, abs=0.04)


def test_dart_walks(spark):
    e, _ = graph(spark, TOY, 6)  # isolated nodes aren't starts
    got = w.dart_walks(e, walks=20, darts_each=5, seed=2, p=0).collect()
    assert len(got) == 100 and all((min(x["u"], x["v"]), max(x["u"], x["v"])) in TOY for x in got)


# scores


def counts(df):
    return {(x["u"], x["v"]): x["w"] for x in df.collect()}


def test_transition_counts(spark):
    df = lambda *tokens: spark.createDataFrame([(list(x),) for x in tokens], "tokens array<long>")
    assert counts(sc.transition_counts(df([10, 0, 1, 2, 0, 3, 2, 11]), 4, "facial")) == {(0, 1): 1, (2, 0): 1, (3, 2): 1}
    assert counts(sc.transition_counts(df([10, 0, 1, 2, 3, 11]), 4, "random")) == {(0, 1): 1, (1, 2): 1, (2, 3): 1}
    three = df([4, 0, 1, 2, 3, 5], [4, 1, 2, 1, 0, 5], [4, 2, 3, 2, 1, 5])
    assert counts(sc.transition_counts(three, 4, "facial")) == {(0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 1): 1, (2, 3): 2}
    assert counts(sc.transition_counts(three, 4, "random")) == {(0, 1): 1, (1, 0): 1, (1, 2): 2, (2, 1): 2, (2, 3): 2, (3, 2): 1}
    dirty = df([4, 0, 9, 1, 2, 2, 3])
    assert counts(sc.transition_counts(dirty, 4, "random")) == {(0, 1): 1, (1, 2): 1, (2, 3): 1}
    assert counts(sc.transition_counts(dirty, 4, "random", pairing="positional")) == {(1, 2): 1, (2, 3): 1}
    assert counts(sc.transition_counts(dirty, 4, "facial")) == {(0, 1): 1}
    assert counts(sc.transition_counts(dirty, 4, "facial", pairing="positional")) == {(1, 2): 1, (2, 3): 1}
    assert counts(sc.transition_counts(df([], [4], [1]), 4, "random")) == {}
    for bad in (lambda: sc.transition_counts(three, 4, "other"), lambda: sc.transition_counts(three, 4, "random", pairing="x"), lambda: sc.aggregate_scores(three, "x")):
        with pytest.raises(ValueError):
            bad()


def test_aggregated_scores(spark):
    s = spark.createDataFrame([(0, 1, 2.0), (1, 0, 5.0), (2, 2, 1.0), (1, 2, 1.0)], "u long, v long, w double")
    assert counts(sc.aggregate_scores(s, "sum")) == {(0, 1): 7, (1, 0): 7, (1, 2): 1, (2, 1): 1}
    assert counts(sc.aggregate_scores(s, "max")) == {(0, 1): 5, (1, 0): 5, (1, 2): 1, (2, 1): 1}
    assert counts(sc.aggregate_scores(s, "none")) == {(0, 1): 2, (1, 0): 5, (2, 2): 1, (1, 2): 1}


def test_sampled_graphs(spark):
    three = spark.createDataFrame([([4, 0, 1, 2, 3, 5],), ([4, 1, 2, 1, 0, 5],), ([4, 2, 3, 2, 1, 5],)], "tokens array<long>")
    for seed in range(4):
        edges, s = sc.reconstruct_graph(three, 4, walk_type="random", target=3, seed=seed)
        got = rows(edges, "u", "v")
        assert len(got) == len(set(got)) == 3 and all(u < v for u, v in got) and {x for e in got for x in e} == {0, 1, 2, 3}
    # every row keeps its edge, even beyond the target; below the diagonal only rows choose
    s = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "u long, v long, w double")
    assert rows(sc.sample_graph(s, target=1), "u", "v") == [(0, 1), (0, 2), (0, 3)]
    s = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 9.0)], "u long, v long, w double")
    assert len(rows(sc.sample_graph(s, target=99, walk_type="random"), "u", "v")) == 4
    assert sc.sample_graph(s.limit(0)).count() == 0


def test_rows_choose_by_odds_and_never_twice(spark):
    s = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (1, 0, 3.0)], "u long, v long, w double")
    got = Counter(tuple(rows(sc.row_seeds(s, seed), "u", "v")) for seed in range(120))
    # if row 0 takes (0, 1), row 1 has nothing left
    assert set(got) == {((0, 1),), ((0, 1), (0, 2))} and 70 < got[((0, 1),)] < 108
