"""Files of training runs: histories, checkpoints, results. Small files go by the driver through Spark's file system."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "epoch long, train_loss double, train_nll double, train_perplexity double, val_score double, val_auc double, val_ap double, edge_overlap double"
LINK = "budget long, graph_id int, split string, auc double, ap double"
STATS = "budget long, metric string, reference double, mean double, std double"
DIAGNOSTICS = "budget long, split string, edges long, min_score double, min_gap double"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def run_dirs(spark: SparkSession, path: str) -> list[str]:
    """Run folders by name, without those that begin with an exclamation mark."""
    return [n for n in children(spark, path) if not n.startswith("!")]


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True))


def read_json(spark: SparkSession, path: str, default=None):
    """A JSON file; missing or broken: the default."""
    text = read_text(spark, path)
    try:
        return default if text is None else json.loads(text)
    except ValueError:
        return default


def read_history(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """A history of HISTORY's columns. A missing file, or one that isn't a list, has no rows; strict: broken JSON is a ValueError."""
    text = read_text(spark, path)
    try:
        rows = json.loads(text) if text is not None else []
    except ValueError:
        if strict:
            raise
        rows = []
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    names = [f.split()[0] for f in HISTORY.split(", ")]
    number = lambda r, c: None if r.get(c) is None else int(r[c]) if c == "epoch" else float(r[c])
    return spark.createDataFrame([tuple(number(r, c) for c in names) for r in rows], HISTORY)


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_run(spark: SparkSession, path: str) -> dict:
    """A run's arguments and metadata (dicts, maybe empty), history and result tables (maybe empty)."""
    return {
        "args": read_json(spark, f"{path}/train_args.json", {}),
        "metadata": read_json(spark, f"{path}/run_metadata.json", {}),
        "history": read_history(spark, f"{path}/history.json"),
        "link": read_csv_or_empty(spark, f"{path}/link_prediction.csv", LINK),
        "stats": read_csv_or_empty(spark, f"{path}/graph_statistics.csv", STATS),
        "diagnostics": read_csv_or_empty(spark, f"{path}/score_diagnostics.csv", DIAGNOSTICS),
    }


def write_results(rows: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header (in a folder of that name)."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_scores(rows: DataFrame, path: str) -> None:
    """Score matrices of several budgets and graphs: budget, graph_id, u, v, w."""
    rows.write.mode("overwrite").partitionBy("budget", "graph_id").parquet(path)


def checkpoint_due(epoch: int, every: int) -> bool:
    return every > 0 and epoch % every == 0


def checkpoint_dir(base: str, epoch: int) -> str:
    return f"{base}/epoch_{epoch:03d}"


def latest_checkpoint(spark: SparkSession, base: str) -> tuple[str, int | None]:
    """(folder, epoch) of the highest epoch, else of `final` (epoch None); neither is a ValueError."""
    names = children(spark, base)
    epochs = [int(m[1]) for n in names if (m := re.fullmatch(r"epoch_(\d+)", n))]
    if epochs:
        return checkpoint_dir(base, max(epochs)), max(epochs)
    if "final" in names:
        return f"{base}/final", None
    raise ValueError(f"no checkpoint in {base}")


def resume_epoch(spark: SparkSession, base: str) -> int:
    """The epoch to go on from: 0 unless a checkpoint holds both a model and its state."""
    try:
        path, epoch = latest_checkpoint(spark, base)
    except ValueError:
        return 0
    state = read_json(spark, f"{path}/state.json", {})
    return int(state.get("epoch", 0)) if epoch and exists(spark, f"{path}/model") and isinstance(state, dict) else 0


def best_checkpoint(spark: SparkSession, base: str) -> str:
    """The best model: `final` if its metadata are there, else the epoch of the best known score, else the latest."""
    meta = read_json(spark, f"{base}/best_val_checkpoint.json")
    if meta and exists(spark, f"{base}/final"):
        return f"{base}/final"
    rows = read_history(spark, f"{base}/history.json")
    best = rows.where(F.col("val_score").isNotNull() & ~F.isnan("val_score") & (F.col("epoch") > 0)).orderBy(F.desc("val_score"), "epoch").first()
    if best and exists(spark, checkpoint_dir(base, best["epoch"])):
        return checkpoint_dir(base, best["epoch"])
    return latest_checkpoint(spark, base)[0]
