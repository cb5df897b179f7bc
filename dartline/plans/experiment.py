"""Train on a graph's walks, generate walks, and compare the graph they give with the original.

    python -m dartline.plans.experiment --edges e.parquet --nodes n.parquet --save-dir runs \
        --final-generated-walks-list 1000 10000

--data-dir with --dataset-name reads a dataset's export instead of --edges and --nodes.
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.operators import connectivity, curvature, graph, linkpred, rotation, scores, stats, tokens, walks
from dartline.plans import model as models
from dartline.plans import reports
from dartline.plans.work import Work
from dartline.sources import artifacts, tables

WALK_TYPES = ("facial", "facial_online", "random", "random_online")
METHODS = ("resistance", "steinerberger", "ollivier_ricci", "lin_lu_yau", "lly", "random_rotations")
STOPS = ("none", "val", "edge_overlap")
TARGETS = ("validation", "reference")


@dataclass
class Config:
    """Settings of a run; names follow the command line's."""

    dataset_name: str = "graph"
    seed: int = 2026
    walk_type: str = "facial"
    facial_walk_method: str = "resistance"
    num_sign_configs: int = 8
    sign_seed: int = 2026
    epoch_seed: int = 99
    vertex_context_size: int = 32
    second_order_p: float = 1.0
    second_order_q: float = 1.0
    epochs: int = 5
    order: int = 2
    smoothing: float = 0.1
    use_link_prediction_split: bool = False
    val_fraction: float = 0.10
    test_fraction: float = 0.05
    train_fraction: float | None = None
    split_seed: int = 123
    early_stop_mode: str = "none"
    early_stop_patience: int = 5
    early_stop_min_delta: float = 0.0
    target_edge_overlap: float = 0.5
    edge_overlap_target: str = "validation"
    eval_generated_walks: int = 4096
    eval_every: int = 1
    eval_max_length: int | None = None
    score_symmetrization: str | None = None
    save_dir: str | None = None
    checkpoint_every: int = 1
    resume_from_latest: bool = False
    num_generated_graphs: int = 1
    reconstruction_seed: int = 777
    final_max_length: int | None = None

    def __post_init__(self):
        for value, known in ((self.walk_type, WALK_TYPES), (self.facial_walk_method, METHODS), (self.early_stop_mode, STOPS), (self.edge_overlap_target, TARGETS)):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {', '.join(known)}")

    @property
    def sampled_type(self) -> str:
        """Online walks are sampled and counted like static ones."""
        return "facial" if self.walk_type.startswith("facial") else "random"

    def max_length(self, given: int | None) -> int:
        return given or tokens.generation_length(self.vertex_context_size, self.sampled_type)

    @property
    def run_name(self) -> str:
        return reports.run_name(
            self.dataset_name, self.walk_type, self.facial_walk_method, self.early_stop_mode, val=self.val_fraction,
            epochs=self.epochs, context=self.vertex_context_size, layers=1, heads=1, width=self.order,
        )


@dataclass
class Data:
    """A prepared graph: its ids are 0..n-1."""

    edges: DataFrame
    nodes: DataFrame
    train_edges: DataFrame
    pairs: DataFrame | None
    n: int


def prepare(edges: DataFrame, nodes: DataFrame, config: Config) -> Data:
    """The largest component, renumbered; its split; and the part of the training edges to learn from."""
    keep = Work(edges.sparkSession).keep
    own, ids = connectivity.largest_connected_component(keep(graph.undirected_simple(edges)), nodes)
    own, numbers = graph.induced_subgraph(own, ids)
    own = keep(own)
    labels = nodes if "label" in nodes.columns else nodes.withColumn("label", F.lit(-1))
    ids = keep(numbers.join(labels, "id").select(F.col("new").alias("id"), "label"))
    train, pairs = own, None
    if config.use_link_prediction_split or config.early_stop_mode == "val":
        pairs = linkpred.link_split(own, ids, val=config.val_fraction, test=config.test_fraction, seed=config.split_seed)
        train = pairs.where("split = 'train' and is_pos").select("u", "v")
    if config.train_fraction is not None:
        share = config.train_fraction
        if pairs is not None:
            share = linkpred.relative_train_fraction(share, config.val_fraction, config.test_fraction)
        train = keep(linkpred.train_subsample(train, fraction=share, seed=config.split_seed + 17))
    return Data(own, ids, train, pairs, ids.count())


class Corpus:
    """Chunk records of each epoch."""

    def __init__(self, data: Data, config: Config):
        self.data, self.config = data, config
        if config.sampled_type == "facial":
            self.kappa = kappa = Work(data.nodes.sparkSession).keep(curvature.node_curvature(data.train_edges, data.nodes, config.facial_walk_method, seed=config.seed))
        if config.walk_type == "facial":
            signs = rotation.sample_signs(data.nodes, config.num_sign_configs, config.sign_seed)
            found = rotation.config_faces(data.train_edges, config.facial_walk_method, curvature=kappa, signs=signs, configs=config.num_sign_configs, seed=config.sign_seed)
            self.sequences = Work(data.nodes.sparkSession).keep(rotation.face_vertex_sequences(found))
        elif config.sampled_type == "random":
            self.walks = walks.corpus_size(config.num_sign_configs, data.train_edges.count(), config.vertex_context_size, data.n)

    def epoch(self, epoch: int) -> DataFrame:
        c = self.config
        if c.walk_type == "facial":
            return tokens.face_chunks(self.sequences, context=c.vertex_context_size, seed=c.epoch_seed, bos=self.data.n, epoch=epoch)
        if c.walk_type == "facial_online":
            found = rotation.epoch_faces(self.data.train_edges, self.data.nodes, c.facial_walk_method, curvature=self.kappa, configs=c.num_sign_configs, seed=c.sign_seed, epoch=epoch)
            return tokens.face_chunks(rotation.face_vertex_sequences(found), context=c.vertex_context_size, seed=c.epoch_seed, bos=self.data.n, epoch=epoch, online=True)
        return walks.random_walk_corpus(
            self.data.train_edges, self.data.nodes, walks=self.walks, context=c.vertex_context_size, seed=c.epoch_seed,
            p=c.second_order_p, q=c.second_order_q, epoch=epoch, online=c.walk_type == "random_online", bos=self.data.n,
        )


def overlap_target(data: Data, config: Config) -> DataFrame:
    """The edges that a run in training is compared with: with a split, its validation edges or the whole graph's."""
    if data.pairs is None or config.edge_overlap_target == "reference":
        return data.edges
    return data.pairs.where("split = 'val' and is_pos").select("u", "v")


def evaluate(model: models.CountModel, data: Data, config: Config, count: int, target: DataFrame, *, length: int, seed: int, overlap: DataFrame | None = None) -> dict:
    """Scores, the graph drawn from them with as many edges as target, and measures of both; overlap: by default with target."""
    keep = Work(data.nodes.sparkSession).keep
    s = keep(models.model_transition_counts(model, count, length=length, walk_type=config.sampled_type, seed=seed))
    drawn = keep(scores.sample_graph(s, target=target.count(), seed=seed, walk_type=config.sampled_type, mode=config.score_symmetrization))
    out = {"scores": s, "edges": drawn, "edge_overlap": linkpred.edge_overlap(drawn, target if overlap is None else overlap).first()[0]}
    if data.pairs is not None:
        rows = linkpred.link_prediction(s, data.pairs.where("split <> 'train'"), walk_type=config.sampled_type, mode=config.score_symmetrization)
        out["link"] = {r["split"]: r.asDict() for r in rows.collect()}
    return out


def train_model(spark: SparkSession, edges: DataFrame, nodes: DataFrame, config: Config) -> tuple[models.CountModel, Data, list[dict]]:
    """The best or last model, the prepared data and the history. Epochs add their counts to the model's."""
    data = prepare(edges, nodes, config)
    corpus, history, rows, done = Corpus(data, config), [], None, 0
    stop = linkpred.EarlyStopping(config.early_stop_patience, config.early_stop_min_delta)
    base = reports.save_dir(config.save_dir, config.run_name) if config.save_dir else None
    if base and config.resume_from_latest and (done := artifacts.resume_epoch(spark, base)):
        rows = spark.read.parquet(f"{artifacts.checkpoint_dir(base, done)}/model")
        history = artifacts.read_json(spark, f"{base}/history.json", [])[:done]
    model = best = None if rows is None else models.CountModel(rows, data.n, config.order, config.smoothing)
    for epoch in range(done + 1, config.epochs + 1):
        chunks = Work(spark).keep(corpus.epoch(epoch))
        counts = models.context_counts(chunks, config.order)
        if rows is not None:
            counts = rows.unionByName(counts).groupBy("context", "next").agg(F.sum("n").alias("n"))
        rows = Work(spark).keep(counts)
        model = models.CountModel(rows, data.n, config.order, config.smoothing)
        fit = models.negative_log_likelihood(model, chunks).first()
        row = {"epoch": epoch, "train_nll": fit["nll"], "train_perplexity": fit["perplexity"]}
        halt = False
        if config.early_stop_mode != "none" and epoch % config.eval_every == 0:
            found = evaluate(model, data, config, config.eval_generated_walks, data.train_edges, length=config.max_length(config.eval_max_length), seed=config.seed + epoch, overlap=overlap_target(data, config))
            row["edge_overlap"] = found["edge_overlap"]
            row |= {f"generated_{r['metric']}": r["value"] for r in stats.compute_graph_statistics(found["edges"], path_length=False).collect()}
            if config.early_stop_mode == "val":
                val = found.get("link", {}).get("val")
                if val is None:
                    raise ValueError("the split has no validation pairs to stop by")
                row |= {"val_auc": val["auc"], "val_ap": val["ap"], "val_score": val["val_score"]}
                value = float("nan") if val["val_score"] is None else val["val_score"]
                halt = stop.update(value, step=epoch)
                if stop.best_step == epoch:
                    best = model
            else:
                halt = found["edge_overlap"] >= config.target_edge_overlap
        history.append(row)
        if base:
            if artifacts.checkpoint_due(epoch, config.checkpoint_every) or halt:
                path = artifacts.checkpoint_dir(base, epoch)
                model.save(f"{path}/model")
                artifacts.write_json(spark, f"{path}/state.json", {"epoch": epoch})
            artifacts.write_json(spark, f"{base}/history.json", history)
        if halt:
            break
    model = best or model
    if base:
        model.save(f"{base}/final/model")
        artifacts.write_json(spark, f"{base}/train_args.json", asdict(config))
        if config.early_stop_mode == "val" and stop.best_step:
            artifacts.write_json(spark, f"{base}/best_val_checkpoint.json", {"checkpoint_dir": f"{base}/final", "epoch": stop.best_step, "val_score": stop.best})
    return model, data, history


def final_grid(model: models.CountModel, data: Data, config: Config, budgets: list[int]) -> dict[str, DataFrame]:
    """Tables over budgets of walks and graphs: link, stats (with report), diagnostics, scores."""
    spark = model.rows.sparkSession
    length, darts = config.max_length(config.final_max_length), config.max_length(config.final_max_length) // 2
    link, values, diagnostics, matrices = [], [], [], []
    every = data.edges.withColumns({"split": F.lit("train"), "is_pos": F.lit(True)})
    for budget in budgets:
        for g in range(config.num_generated_graphs):
            found = evaluate(model, data, config, budget, data.edges, length=length, seed=config.reconstruction_seed + g)
            link += [(budget, g, s, r["auc"], r["ap"]) for s, r in sorted(found.get("link", {}).items())]
            own = stats.compute_graph_statistics(found["edges"], data.nodes, labels=True)
            values += [(budget, r["metric"], r["value"]) for r in own.collect()] + [(budget, "edge_overlap", found["edge_overlap"])]
            rows = linkpred.score_diagnostics(found["scores"], data.pairs if data.pairs is not None else every, darts)
            diagnostics.append(rows.select(F.lit(budget).cast("long").alias("budget"), "split", "edges", "min_score", "min_gap"))
            matrices.append(found["scores"].select(F.lit(budget).cast("long").alias("budget"), F.lit(g).alias("graph_id"), "u", "v", "w"))
    reference = stats.compute_graph_statistics(data.edges, data.nodes, labels=True)
    reference = reference.unionByName(spark.createDataFrame([("edge_overlap", 1.0)], "metric string, value double"))
    return {
        "link": spark.createDataFrame(link, artifacts.LINK),
        "stats": stats.budget_report(spark.createDataFrame(values, "budget long, metric string, value double"), reference),
        "diagnostics": reports.stack(diagnostics),
        "scores": reports.stack(matrices),
    }


def save_grid(spark: SparkSession, base: str, tables_: dict[str, DataFrame], metadata: dict) -> None:
    artifacts.write_results(tables_["link"], f"{base}/link_prediction.csv")
    artifacts.write_results(tables_["stats"], f"{base}/graph_statistics.csv")
    artifacts.write_results(tables_["diagnostics"], f"{base}/score_diagnostics.csv")
    artifacts.write_scores(tables_["scores"], f"{base}/score_matrices")
    artifacts.write_json(spark, f"{base}/run_metadata.json", metadata)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    out.add_argument("--edges")
    out.add_argument("--nodes")
    out.add_argument("--data-dir")
    out.add_argument("--skip-train", action="store_true")
    out.add_argument("--final-generated-walks-list", type=int, nargs="+", required=True)
    out.add_argument("--save-final-eval", action=argparse.BooleanOptionalAction, default=True)
    for f in fields(Config):
        flag, default = "--" + f.name.replace("_", "-"), f.default
        if isinstance(default, bool):
            out.add_argument(flag, action="store_true")
        else:
            kind = {"train_fraction": float, "score_symmetrization": str, "save_dir": str}.get(f.name, int if default is None else type(default))
            out.add_argument(flag, type=kind, default=default)
    return out


def main(argv: list[str] | None = None) -> dict[str, DataFrame]:
    args = vars(parser().parse_args(argv))
    config = Config(**{f.name: args[f.name] for f in fields(Config)})
    spark = SparkSession.builder.getOrCreate()
    if args["data_dir"]:
        edges, nodes = tables.load_graph_dataset(spark, config.dataset_name, data_dir=args["data_dir"])
    elif args["edges"] and args["nodes"]:
        edges, nodes = tables.read_graph(spark, args["edges"]), spark.read.parquet(args["nodes"])
    else:
        raise ValueError("give --edges and --nodes, or --data-dir and --dataset-name")
    base = reports.save_dir(config.save_dir, config.run_name) if config.save_dir else None
    if args["skip_train"]:
        if not base:
            raise ValueError("a run to evaluate is found in --save-dir")
        data = prepare(edges, nodes, config)
        model = models.CountModel.load(spark, f"{artifacts.best_checkpoint(spark, base)}/model", vertices=data.n, order=config.order, smoothing=config.smoothing)
    else:
        model, data, _ = train_model(spark, edges, nodes, config)
    grid = final_grid(model, data, config, args["final_generated_walks_list"])
    if base and args["save_final_eval"]:
        save_grid(spark, base, grid, {"run": config.run_name, "budgets": args["final_generated_walks_list"], "nodes": data.n})
    return grid


if __name__ == "__main__":
    main()
