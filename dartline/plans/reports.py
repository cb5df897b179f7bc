"""Reports over histories and run artifacts: best epochs, pivots, labels, sorted tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_epoch(history: DataFrame, by: list[str], score: str = "val_score") -> DataFrame:
    """The row of each run with the highest known score after epoch 0; among equals the first epoch."""
    rows = history.where(F.nanvl(F.col(score), F.lit(None).cast("double")).isNotNull() & (F.col("epoch") > 0))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "epoch"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_of_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in a recorded order; null is a group of its own."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def pivot_diagnostics(rows: DataFrame, by: list[str], splits: list[str], metrics: list[str]) -> DataFrame:
    """Columns metric[split] of rows (by, split, metrics); a split without a row is null."""
    cells = [F.first(F.when(F.col("split") == s, F.col(m)), ignorenulls=True).alias(f"{m}[{s}]") for s in splits for m in metrics]
    return rows.groupBy(*by).agg(*cells)


def sort_keys(keys: list[tuple[str, bool]]) -> list[Column]:
    """Columns to order by, nulls last in either direction (True: ascending)."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys]


def label(columns: list[str]) -> Column:
    """Values as text joined by a bar; null as nothing."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def full_run_rows(rows: DataFrame, full: str = "full", budget: str = "budget", most: int = 10_000_000) -> DataFrame:
    """Rows that aren't full runs, and of those the ones without a budget or with the largest."""
    return rows.where(~F.coalesce(F.col(full), F.lit(False)) | F.col(budget).isNull() | (F.col(budget) == most))


def stack(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def select_present(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c for c in columns if c in rows.columns])


def fraction_label(column: str) -> Column:
    """A share as a short decimal: 1 as 1, others with up to 3 digits and no zeros at the end."""
    c = F.col(column)
    return F.when(c.isNull(), F.lit("")).otherwise(F.regexp_replace(F.format_string("%.3f", c.cast("double")), r"\.?0+$", ""))


def run_label(dataset: str, method: str, fraction: str | None = None) -> Column:
    parts = [F.col(dataset), F.col(method)]
    if fraction:
        parts.append(F.concat(F.lit("f="), fraction_label(fraction)))
    return F.concat_ws(" ", *parts)


def run_summary(runs: DataFrame, history: DataFrame, link: DataFrame, stats: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row for each run and listed budget: the run's columns, its best epoch, and what was measured.

    runs: run, budgets (array, maybe empty), ...; link: run, budget, auc, ap; stats: run, budget, metric, mean;
    diagnostics: run, split, edges, min_score, min_gap. What a run lacks is null.
    """
    best = best_epoch(history, ["run"]).select("run", F.col("epoch").alias("best_epoch"), F.col("val_score").alias("best_val_score"))
    rows = runs.withColumn("budget", F.explode_outer("budgets")).drop("budgets")
    wide = stats.groupBy("run", "budget").pivot("metric").agg(F.first("mean"))
    split = pivot_diagnostics(diagnostics, ["run"], ["train", "validation", "test"], ["edges", "min_score", "min_gap"])
    return rows.join(best, "run", "left").join(link, ["run", "budget"], "left").join(wide, ["run", "budget"], "left").join(split, "run", "left")


def long_history(histories: dict[str, DataFrame]) -> DataFrame:
    """Histories of several runs, a row each epoch, by run and epoch."""
    return stack([h.withColumn("run", F.lit(name)) for name, h in histories.items()]).orderBy("run", "epoch")


def command(script: str, options: dict) -> list[str]:
    """A command line of options: true as a flag, false and None left out, lists as several values."""
    out = ["python", script]
    for k, v in options.items():
        flag = "--" + k.replace("_", "-")
        if v is True:
            out.append(flag)
        elif isinstance(v, (list, tuple)):
            out += [flag, *map(str, v)]
        elif v is not None and v is not False:
            out += [flag, str(v)]
    return out


def run_name(dataset: str, walk: str, method: str, stop: str, *, val: float, epochs: int, context: int, layers: int, heads: int, width: int) -> str:
    """dataset_walk_method_stop_V.._E.._T.._L.._H.._D.. with p for the decimal point."""
    text = f"{dataset}_{walk}_{method}_{stop}_V{val:g}_E{epochs}_T{context}_L{layers}_H{heads}_D{width}"
    return re.sub(r"(?<=\d)\.(?=\d)", "p", text)


def save_dir(base: str, name: str) -> str:
    """base/name, or base if it ends with the name already."""
    base = base.rstrip("/")
    return base if base.rsplit("/", 1)[-1] == name else f"{base}/{name}"
