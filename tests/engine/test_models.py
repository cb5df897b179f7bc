import json
import math

import pytest
from pyspark.sql import functions as F

from dartline.operators import connectivity
from dartline.operators import linkpred as lp
from dartline.plans import experiment as ex
from dartline.plans import model as m
from dartline.plans import reports as rp
from dartline.sources import artifacts as ar
from dartline.sources import tables as tb
from tests.engine.graphs import TOY, graph, rows

SPLIT5 = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_split_keeps_training_connected(spark):
    e, n = graph(spark, SPLIT5)
    pairs = lp.link_split(e, n, val=0.15, test=0.15, seed=3)
    got = {}
    for r in pairs.collect():
        got.setdefault((r["split"], r["is_pos"]), set()).add((r["u"], r["v"]))
    edges = set(SPLIT5)
    assert connectivity.component_count(pairs.where("split = 'train' and is_pos").select("u", "v"), n) == 1
    assert got["val", True] and got["test", True] and not got["val", True] & got["test", True]
    assert got["train", True] | got["val", True] | got["test", True] == edges
    for s in ("val", "test"):
        assert len(got[s, False]) == len(got[s, True]) and not got[s, False] & edges and all(u < v for u, v in got[s, False])
    with pytest.raises(ValueError):
        lp.link_split(e, n, val=0.4, test=0.4)  # the tree doesn't fit
    with pytest.raises(ValueError):
        lp.link_split(e, spark.range(7), val=0.1, test=0.1)
    with pytest.raises(ValueError):
        lp.link_split(e, n, val=0, test=0)


def test_non_edges_and_subsample(spark):
    e, n = graph(spark, SPLIT5)
    assert len(rows(lp.non_edges(e, n, 3, seed=1), "u", "v")) == 3
    with pytest.raises(ValueError):
        lp.non_edges(e, n, 4, seed=1)
    assert rows(lp.train_subsample(e, fraction=1), "u", "v") == SPLIT5
    for f, size in ((0.1, 4), (0.75, 5), (0.9, 6)):
        own = lp.train_subsample(e, fraction=f, seed=2)
        assert own.count() == size and connectivity.component_count(own, n) == 1
    with pytest.raises(ValueError):
        lp.train_subsample(e, fraction=0)
    assert lp.relative_train_fraction(0.5, 0.1, 0.1) == pytest.approx(0.625)
    with pytest.raises(ValueError):
        lp.relative_train_fraction(0.9, 0.1, 0.1)


def test_ranking_measures(spark):
    df = spark.createDataFrame([(3.0, True), (2.0, True), (2.0, True), (0.0, True), (2.0, False), (1.0, False), (0.0, False), (0.0, False)], "score double, is_pos boolean")
    assert lp.roc_auc(df).first()[0] == pytest.approx(0.75) and lp.average_precision(df).first()[0] == pytest.approx(0.75)
    only = df.where("is_pos")
    assert lp.roc_auc(only).first()[0] is None and lp.average_precision(only).first()[0] is None
    assert lp.average_precision(df.where("not is_pos")).first()[0] is None


def test_overlap_and_scores(spark):
    ref, gen = graph(spark, [(0, 1), (0, 2)])[0], graph(spark, [(0, 1), (1, 2)])[0]
    assert lp.edge_overlap(gen, ref).first()[0] == 0.5 and lp.edge_overlap(gen, ref.limit(0)).first()[0] == 0.0
    s = spark.createDataFrame([(0, 1, 2.0), (1, 0, 4.0), (1, 2, 2.0)], "u long, v long, w double")
    pairs = spark.createDataFrame([(0, 1, "test", True), (0, 2, "test", False)], "u long, v long, split string, is_pos boolean")
    assert [r["score"] for r in lp.pair_scores(s, pairs).orderBy("u", "v").collect()] == [2.0, 0.0]
    one = lp.link_prediction(s, pairs, walk_type="facial").first()
    assert (one["auc"], one["ap"], one["val_score"]) == (1.0, 1.0, 1.0)
    assert [r["score"] for r in lp.scaled_scores(s, pairs, 8).orderBy("u", "v").collect()] == [2.0, 0.0] and lp.scaled_scores(s.limit(0), pairs, 8).count() == 0
    gaps = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", 3.5), ("b", 1.0)], "split string, x double")
    assert rows(lp.smallest_gap("x", gaps, ["split"]), "split", "min_gap") == [("a", 0.5), ("b", None)]
    diag = lp.score_diagnostics(s, pairs, 8).first()
    assert (diag["edges"], diag["min_score"], diag["min_gap"]) == (1, 2.0, None)


@pytest.mark.parametrize("values", [[0.5, 0.6, 0.6, 0.61, 0.4, 0.3, 0.9], [None, float("nan"), 0.2, 0.25, 0.29, 0.31], [0.1, 0.2, 0.3]])
def test_early_stopping_folds_alike(spark, values):
    state, stop = lp.EarlyStopping(2, 0.05), None
    for i, v in enumerate(values):
        if state.update(math.nan if v is None else v, step=i):
            stop = i
            break
    got = lp.early_stopping(spark.createDataFrame(list(enumerate(values)), "epoch long, value double"), patience=2, min_delta=0.05).first()
    assert (got["best_epoch"], got["stop_epoch"], got["bad"]) == (state.best_step, stop, state.bad)


# models


def sequences(spark):
    return spark.createDataFrame([([4, 0, 1, 2, 0, 3, 2, 1, 3],), ([4, 1, 2, 1, 0, 5],), ([4, 2, 3, 2, 1, 5],)], "tokens array<long>")


def test_context_counts(spark):
    got = {(tuple(r["context"]), r["next"]): r["n"] for r in m.context_counts(sequences(spark), 2).collect()}
    assert got[(4,), 0] == 1 and got[(2,), 1] == 3 and got[(3, 2), 1] == 2 and sum(got.values()) == 8 + 5 + 5 + 7 + 4 + 4


def test_likelihood(spark):
    data = spark.createDataFrame([([2, 0, 1],), ([2, 0, 0],)], "tokens array<long>")
    model = m.train(data, 2, order=1, smoothing=0.5)
    got = m.negative_log_likelihood(model, data).first()
    p = [2.5 / 4, 1.5 / 4, 2.5 / 4, 1.5 / 4]
    assert got["nll"] == pytest.approx(-sum(map(math.log, p)) / 4) and got["tokens"] == 4 and got["perplexity"] == pytest.approx(math.exp(got["nll"]))
    assert m.perplexity(25.0) == math.inf


@pytest.mark.parametrize("length, block", [(0, None), (1, None), (2, None), (3, None), (9, None), (12, 6), (17, 8)])
def test_facial_grammar(spark, length, block):
    model = m.train(sequences(spark), 4)
    for r in m.generate_walks(model, 25, length=length, walk_type="facial", block=block, seed=1).collect() if length else []:
        x = r["tokens"]
        assert len(x) == length and x[0] == 4 and all(0 <= t < 4 for t in x[1:])
        body, free = x[1:], []
        at = 0
        while at < len(body):
            if len(free) >= 3:
                copied = at < len(body) and body[at] == (free[0] if len(free) == 3 else free[-2])
                assert copied
                at += 1
                if at >= len(body):
                    break
            if free:
                assert body[at] != (free[0] if len(free) <= 2 else free[-1])
            free.append(body[at])
            at += 1
    if not length:
        assert m.generate_walks(model, 25, length=0, walk_type="facial").count() == 0


def test_random_grammar_and_options(spark):
    model = m.train(sequences(spark), 4)
    for options in ({}, {"block": 4}, {"temperature": 0.5}, {"top_k": 1}):
        got = m.generate_walks(model, 20, length=9, walk_type="random", seed=2, **options).collect()
        assert len(got) == 20 and all(len(r["tokens"]) == 9 and all(a != b for a, b in zip(r["tokens"], r["tokens"][1:])) for r in got)
    a, b = [{r["walk"]: r["tokens"] for r in m.generate_walks(model, 20, length=6, walk_type="random", seed=s).collect()} for s in (2, 3)]
    assert a != b
    prompts = spark.createDataFrame([(0, [4, 0])], "walk long, tokens array<long>")
    assert len(m.generate(model, prompts, new_tokens=3, top_k=2).first()["tokens"]) == 5
    s = m.model_transition_counts(model, 30, length=9, walk_type="facial", seed=1)
    assert s.where("u = v or u > 3 or v > 3").count() == 0 and s.agg(F.sum("w")).first()[0] == 30 * 4


def test_draws_follow_the_weights(spark):
    model = m.CountModel(spark.createDataFrame([([1], 0, 6), ([1], 2, 2), ([1], 3, 90)], "context array<long>, next long, n long"), 4, order=1, smoothing=1.0)
    states = spark.range(6000).select(F.col("id").alias("walk"), F.array(F.lit(1).cast("long")).alias("tokens"))
    got = {r["next"]: r["count"] / 6000 for r in m.choose(model, states, 4, F.lit(3).cast("long"), (5,)).groupBy("next").count().collect()}
    assert got == {0: pytest.approx(7 / 11, abs=0.03), 1: pytest.approx(1 / 11, abs=0.03), 2: pytest.approx(3 / 11, abs=0.03)}


# experiments and files


def inputs(spark, tmp_path):
    e = tb.erdos_renyi(spark, 14, 0.5, 3)
    e.write.parquet(f"{tmp_path}/edges.parquet")
    spark.range(14).select("id", (F.col("id") % 3).cast("int").alias("label")).write.parquet(f"{tmp_path}/nodes.parquet")
    return ["--edges", f"{tmp_path}/edges.parquet", "--nodes", f"{tmp_path}/nodes.parquet", "--save-dir", f"{tmp_path}/runs", "--final-generated-walks-list", "60"]


def test_experiment_from_the_command_line(spark, tmp_path):
    argv = [*inputs(spark, tmp_path), "--epochs", "2", "--num-sign-configs", "2", "--vertex-context-size", "9", "--use-link-prediction-split", "--early-stop-mode", "val", "--eval-generated-walks", "40", "--checkpoint-every", "1"]
    grid = ex.main(argv)
    assert {r["split"] for r in grid["link"].collect()} == {"val", "test"}
    stats = {r["metric"]: r for r in grid["stats"].collect()}
    assert {"max_degree", "path_length", "intra", "inter", "edge_overlap"} <= set(stats)
    base = f"{tmp_path}/runs/{ex.Config(epochs=2, vertex_context_size=9, early_stop_mode='val').run_name}"
    run = ar.read_run(spark, base)
    assert run["history"].count() == 2 and run["args"]["epochs"] == 2 and run["stats"].count() == len(stats) and run["metadata"]["nodes"] == 14
    assert ar.latest_checkpoint(spark, base)[1] == 2 and ar.resume_epoch(spark, base) == 2
    assert ar.best_checkpoint(spark, base).endswith("final") and ar.run_dirs(spark, f"{tmp_path}/runs") == [base.rsplit("/", 1)[1]]
    again = ex.main([*argv, "--skip-train"])
    assert rows(again["scores"], "u", "v", "w") == rows(grid["scores"], "u", "v", "w")
    more = ex.main([*argv, "--epochs", "2", "--resume-from-latest", "--no-save-final-eval"])
    assert more["stats"].count() == len(stats)


@pytest.mark.parametrize("walk", ["random", "random_online", "facial_online"])
def test_experiment_on_other_walks(spark, tmp_path, walk):
    if walk == "facial_online":  # a dataset by its name
        inputs(spark, f"{tmp_path}/data/cora_ml")
        source = ["--data-dir", f"{tmp_path}/data", "--dataset-name", "CoraML", "--facial-walk-method", "lly"]
    else:
        source = inputs(spark, tmp_path)[:4]
    grid = ex.main([*source, "--final-generated-walks-list", "30", "--epochs", "1", "--walk-type", walk, "--vertex-context-size", "6", "--num-sign-configs", "1", "--early-stop-mode", "edge_overlap", "--eval-generated-walks", "20", "--train-fraction", "0.8"])
    assert grid["link"].count() == 0 and grid["diagnostics"].count() == 1


def test_bad_settings():
    for bad in ({"walk_type": "x"}, {"facial_walk_method": "x"}, {"early_stop_mode": "x"}, {"edge_overlap_target": "x"}):
        with pytest.raises(ValueError):
            ex.Config(**bad)


def test_overlap_targets(spark):
    e, n = graph(spark, [(0, 1), (1, 2), (0, 2)])
    pairs = spark.createDataFrame([(0, 1, "train", True), (1, 2, "val", True), (0, 2, "test", True), (0, 3, "val", False)], "u long, v long, split string, is_pos boolean")
    got = lambda target, p: rows(ex.overlap_target(ex.Data(e, n, e, p, 3), ex.Config(edge_overlap_target=target)), "u", "v")
    assert got("validation", pairs) == [(1, 2)] and got("reference", pairs) == got("validation", None) == [(0, 1), (0, 2), (1, 2)]


def test_history_files(spark, tmp_path):
    path = f"{tmp_path}/history.json"
    assert ar.read_history(spark, path).count() == 0
    for text, n in (("[{\"epoch\": 1, \"val_score\": 0.5}, {\"epoch\": 2}]", 2), ("{}", 0), ("nonsense", 0)):
        ar.write_text(spark, path, text)
        assert ar.read_history(spark, path).count() == n
    with pytest.raises(ValueError):
        ar.read_history(spark, path, strict=True)
    assert ar.read_json(spark, path, {"a": 1}) == {"a": 1} and ar.read_csv_or_empty(spark, f"{tmp_path}/no.csv", ar.LINK).columns[0] == "budget"


def test_checkpoints(spark, tmp_path):
    with pytest.raises(ValueError):
        ar.latest_checkpoint(spark, str(tmp_path))
    assert ar.resume_epoch(spark, str(tmp_path)) == 0
    for e in (2, 999, 1000):
        ar.write_json(spark, f"{ar.checkpoint_dir(str(tmp_path), e)}/state.json", {"epoch": e})
    assert ar.latest_checkpoint(spark, str(tmp_path))[1] == 1000 and ar.resume_epoch(spark, str(tmp_path)) == 0  # no model
    ar.write_json(spark, f"{tmp_path}/history.json", [{"epoch": 0, "val_score": 0.99}, {"epoch": 2, "val_score": 0.7}, {"epoch": 999, "val_score": 0.7}, {"epoch": 1000, "val_score": None}])
    assert ar.best_checkpoint(spark, str(tmp_path)).endswith("epoch_002")
    assert [ar.checkpoint_due(e, 2) for e in (1, 2, 3, 4)] == [False, True, False, True] and not ar.checkpoint_due(4, 0)


def test_sources(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "u long, v long").coalesce(1).write.csv(f"{tmp_path}/e.csv", header=True)
    assert rows(tb.read_graph(spark, f"{tmp_path}/e.csv"), "u", "v") == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        tb.read_graph(spark, "x", fmt="xml")
    with pytest.raises(ValueError):
        tb.load_graph_dataset(spark, " No-Such ", data_dir=str(tmp_path))
    spark.createDataFrame([(0, 1)], "u long, v long").write.parquet(f"{tmp_path}/cora_ml/edges.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/cora_ml/nodes.parquet")
    edges, nodes = tb.load_graph_dataset(spark, " Cora-ML ", data_dir=str(tmp_path))
    assert rows(nodes, "id", "label") == [(0, -1), (1, -1)] and edges.count() == 1
    assert rows(tb.identity_features(nodes), "node", "feature", "value") == [(0, 0, 1.0), (1, 1, 1.0)]
    assert tb.erdos_renyi(spark, 1, 0.5, 1).count() == 0 and tb.erdos_renyi(spark, 5, 1.0, 1).count() == 10


# reports


def test_reports(spark):
    h = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, None), ("b", 1, float("nan"))], "run string, epoch long, val_score double")
    assert rows(rp.best_epoch(h, ["run"]), "run", "epoch") == [("a", 2)]
    d = spark.createDataFrame([("a", "train", 5, 0.1), ("a", "test", 2, None)], "run string, split string, edges long, min_score double")
    assert rp.pivot_diagnostics(d, ["run"], ["train", "test"], ["edges", "min_score"]).first().asDict() == {"run": "a", "edges[train]": 5, "min_score[train]": 0.1, "edges[test]": 2, "min_score[test]": None}
    nulls = spark.createDataFrame([(None, 1), ("x", 2), (None, 3)], "k string, i int")
    assert rows(rp.first_of_group(nulls, ["k"], ["i"]), "i") == [(1,), (2,)]
    assert [r["i"] for r in nulls.orderBy(*rp.sort_keys([("k", True), ("i", False)])).collect()] == [2, 3, 1]
    assert [r[0] for r in nulls.orderBy("i").select(rp.label(["k", "i"])).collect()] == [" | 1", "x | 2", " | 3"]
    runs = spark.createDataFrame([(True, None), (True, 5), (True, 10_000_000), (False, 5), (None, 5)], "full boolean, budget long")
    assert rp.full_run_rows(runs).count() == 4 and rp.select_present(runs, ["budget", "none"]).columns == ["budget"]
    assert rp.stack([runs, nulls]).columns == ["full", "budget", "k", "i"] and rp.long_history({"r": h.drop("run")}).count() == 6
    shares = spark.createDataFrame([(1.0,), (0.25,), (None,), (0.1234,)], "f double")
    assert [r[0] for r in shares.select(rp.fraction_label("f")).collect()] == ["1", "0.25", "", "0.123"]
    assert rp.command("x.py", {"a_b": 1, "c": True, "d": False, "e": None, "f": [1, 2]}) == ["python", "x.py", "--a-b", "1", "--c", "--f", "1", "2"]
    name = rp.run_name("g", "facial", "resistance", "val", val=0.1, epochs=5, context=17, layers=4, heads=4, width=256)
    assert name == "g_facial_resistance_val_V0p1_E5_T17_L4_H4_D256" and rp.save_dir(rp.save_dir("s", name), name) == f"s/{name}"


def test_run_summary(spark):
    runs = spark.createDataFrame([("a", [1, 2]), ("b", [])], "run string, budgets array<long>")
    h = spark.createDataFrame([("a", 1, 0.5)], "run string, epoch long, val_score double")
    link = spark.createDataFrame([("a", 1, 0.8, 0.7)], "run string, budget long, auc double, ap double")
    stats = spark.createDataFrame([("a", 1, "triangles", 3.0)], "run string, budget long, metric string, mean double")
    d = spark.createDataFrame([("a", "train", 5, 0.1, None)], "run string, split string, edges long, min_score double, min_gap double")
    got = {(r["run"], r["budget"]): r for r in rp.run_summary(runs, h, link, stats, d).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", None)} and got["a", 1]["triangles"] == 3.0 and got["a", 2]["auc"] is None and got["a", 2]["edges[train]"] == 5 and got["b", None]["best_epoch"] is None


def test_saved_scores(spark, tmp_path):
    s = spark.createDataFrame([(10, 0, 1, 2, 3.0)], "budget long, graph_id int, u long, v long, w double")
    ar.write_scores(s, f"{tmp_path}/scores")
    assert rows(spark.read.parquet(f"{tmp_path}/scores"), "budget", "graph_id", "u", "v", "w") == [(10, 0, 1, 2, 3.0)]
    assert json.loads(ar.read_text(spark, _json(spark, tmp_path))) == {"b": 1, "a": [2]}
    model = m.train(sequences(spark), 4)
    model.save(f"{tmp_path}/model")
    assert m.CountModel.load(spark, f"{tmp_path}/model", vertices=4).rows.count() == model.rows.count()
    assert TOY


def _json(spark, tmp_path):
    ar.write_json(spark, f"{tmp_path}/x.json", {"b": 1, "a": [2]})
    return f"{tmp_path}/x.json"
