"""Transition counts over a stream of events: our own addition to the batch operator.

The last vertex of each user is state, so events must come in the order of time for a user within and across
batches; memory grows with the users seen, in a state store that is checkpointed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dartline.plans.work import Work, shared_dir
from dartline.sources.tables import table

PAIRS = "walk long, u long, v long"


def consecutive(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    last = state.get[0] if state.exists else -1
    tokens = [last, *rows["token"].tolist()]
    state.update((int(tokens[-1]),))
    pairs = [(key[0], u, v) for u, v in zip(tokens[:-1], tokens[1:]) if u >= 0 and u != v]
    yield pd.DataFrame(pairs, columns=["walk", "u", "v"])


def stream_pairs(events: DataFrame) -> DataFrame:
    """walk, u, v of a stream of (walk, ts, event_id, token): each step between different vertices."""
    return events.groupBy("walk").applyInPandasWithState(consecutive, PAIRS, "last long", "append", GroupStateTimeout.NoTimeout)


def counts_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w over the events table read as a stream until its end; pairs go to a table, counts come from it."""
    kinds = {r["event_type"]: i for i, r in enumerate(table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect())}
    schema = table(spark, sf_dir, "events").schema
    token = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")].cast("long")
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = rows.select(F.col("user_id").alias("walk"), F.col("ts").cast("timestamp").alias("ts"), "event_id", token.alias("token"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream_pairs(rows).writeStream.format("parquet").option("path", f"{base}/pairs").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    pairs = Work(spark).keep(spark.read.schema(PAIRS).parquet(f"{base}/pairs"))
    return pairs.groupBy("u", "v").agg(F.count("*").cast("double").alias("w"))
