"""Token sequences: windows, codecs, chunks of faces, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.functions.rng import rand01, randint
from dartline.operators.graph import numbered, running_sum

IGNORED = -100


def max_darts(context: int) -> int:
    """Darts of a chunk beside the begin mark; a context below 3 holds none and is a ValueError."""
    if context < 3:
        raise ValueError("the context must hold at least 3 tokens")
    return (context - 1) // 2


def generation_length(context: int, walk_type: str) -> int:
    """Tokens of a generated walk: whole darts after the begin mark, or the context."""
    return max(3, 1 + 2 * ((context - 1) // 2)) if walk_type == "facial" else max(2, context)


def window_starts(length: Column, width: int, stride: int, allow_tail_overlap: bool = False) -> Column:
    """0, stride, ... as long as a window fits; [0] if the whole is no longer; optionally the last window that fits."""
    last = length - F.lit(width)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    if allow_tail_overlap:
        starts = F.array_union(starts, F.array(F.greatest(last, F.lit(0)).cast("long")))
    return F.when(length <= width, F.array(F.lit(0).cast("long"))).otherwise(starts)


def cyclic_slice(tokens: Column, start: Column, length: Column) -> Column:
    """length items from start (modulo the size) on, going round once."""
    size = F.size(tokens)
    return F.when(size > 0, F.slice(F.concat(tokens, tokens), (F.pmod(start, F.greatest(size, F.lit(1))) + 1).cast("int"), F.least(length, size).cast("int"))).otherwise(tokens)


def darts_to_tokens(darts: Column) -> Column:
    return F.flatten(F.transform(darts, lambda d: F.array(d["u"], d["v"])))


def tokens_to_darts(tokens: Column) -> Column:
    """Pairs of tokens as (u, v); an odd number is an error."""
    half = F.sequence(F.lit(0), F.greatest(F.floor(F.size(tokens) / 2).cast("int") - 1, F.lit(0)))
    pairs = F.transform(half, lambda i: F.struct(F.get(tokens, 2 * i).alias("u"), F.get(tokens, 2 * i + 1).alias("v")))
    pairs = F.filter(pairs, lambda d: d["v"].isNotNull())
    return F.when(F.size(tokens) % 2 == 0, pairs).otherwise(F.raise_error(F.lit("a dart sequence has an even number of tokens")))


def exact_chunks(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Full chunks of `size` rows of (key, pos, ...): the rows with their chunk; a tail that isn't full is dropped."""
    w = Window.partitionBy(*key)
    return rows.withColumn("_n", F.count("*").over(w)).where(F.col("pos") < size * F.floor(F.col("_n") / size)).withColumn("chunk", F.floor(F.col("pos") / size)).drop("_n")


def face_chunks(sequences: DataFrame, *, context: int, seed: int, bos: int, epoch: int = 0, eos: int | None = None, online: bool = False) -> DataFrame:
    """Chunk records of faces (config, face, seq_id, tokens): an epoch's windows over faces turned by a random offset.

    A face of 1 dart isn't turned. A face that fits one chunk ends with `eos` (bos + 1) unless online; a longer one
    loses the darts after its last full window. Online chunks carry no end marks and accept a context of 2.
    """
    width = max((context - 1) // 2, 1) if online else max_darts(context)
    end = F.lit(bos + 1 if eos is None else eos).cast("long")
    size = (F.size("tokens") / 2).cast("int")
    offset = F.when(size <= 1, F.lit(0)).otherwise(randint(size, seed, epoch, F.col("seq_id")))
    rows = sequences.withColumn("_n", size).withColumn("_o", offset)
    rows = rows.withColumn("_starts", window_starts(F.col("_n"), width, width))
    rows = rows.select("*", F.posexplode("_starts").alias("chunk_index", "_start"))
    length = F.least(F.col("_n") - F.col("_start"), F.lit(width)).cast("int")
    own = cyclic_slice(F.col("tokens"), 2 * (F.col("_o") + F.col("_start")), 2 * length)
    whole = (F.col("_n") <= width) & F.lit(not online)
    tokens = F.concat(F.array(F.lit(bos).cast("long")), own, F.when(whole, F.array(end)).otherwise(F.slice(F.array(end), 1, 0)))
    return rows.select(
        tokens.alias("tokens"), F.col("seq_id").alias("face_index"), "chunk_index", F.col("_start").cast("int").alias("chunk_start"), length.alias("dart_length"),
        (F.col("chunk_index") == F.size("_starts") - 1).alias("is_terminal"), whole.alias("has_eos"), F.size("_starts").alias("num_chunks_for_face"),
        F.col("config").cast("int").alias("sign_config_index"), F.col("face").cast("int").alias("face_index_within_config"), F.lit(width).alias("dart_stride"), F.lit(2 * width).alias("stride"),
    )


def batches(rows: DataFrame, size: int, *, order: list[str], shuffle: bool = False, seed: int = 0, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """rows with batch and place in it, in the order given or in one of hashes of it."""
    by = [rand01(seed, epoch, *[F.col(c) for c in order]), *order] if shuffle else order
    out = numbered(rows, *by, name="_at").withColumns({"batch": F.floor(F.col("_at") / size), "place": (F.col("_at") % size).cast("int")}).drop("_at")
    if drop_last:
        full = out.groupBy("batch").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out


def collate(rows: DataFrame, pad: int) -> DataFrame:
    """rows (batch, tokens, ...) with input_ids padded to the batch's longest, attention_mask and labels (pads: -100)."""
    most = F.max(F.size("tokens")).over(Window.partitionBy("batch"))
    gap = (most - F.size("tokens")).cast("int")
    fill = lambda value, n: F.array_repeat(F.lit(value).cast("long"), n)
    return rows.withColumns(
        {
            "input_ids": F.concat("tokens", fill(pad, gap)),
            "attention_mask": F.concat(fill(1, F.size("tokens")), fill(0, gap)),
            "labels": F.concat("tokens", fill(IGNORED, gap)),
        }
    )


def chunk_length_summary(chunks: DataFrame) -> DataFrame:
    n = F.size("tokens")
    return chunks.agg(F.min(n).alias("min"), F.percentile(n, F.lit(0.5)).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("max"), F.count("*").alias("count"), F.count_if("has_eos").alias("eos"))


def unique_chunk_ratio(chunks: DataFrame) -> DataFrame:
    """Distinct / all chunks that aren't empty; null if there are none."""
    own = chunks.where(F.size("tokens") > 0)
    return own.agg(F.try_divide(F.countDistinct("tokens").cast("double"), F.count("*")).alias("ratio"))


def dart_coverage(rows: DataFrame) -> DataFrame:
    """walk, covered: distinct darts of (walk, u, v) up to each walk that brings new ones."""
    first = rows.groupBy("u", "v").agg(F.min("walk").alias("walk")).groupBy("walk").agg(F.count("*").alias("new"))
    return running_sum(first, "new", "walk", name="covered").select("walk", "covered")


def full_coverage_walk(coverage: DataFrame, darts: int) -> DataFrame:
    """One row, first_full: the first walk with which all darts are covered; null if none."""
    return coverage.where(F.col("covered") >= darts).agg(F.min("walk").alias("first_full"))


def coverage_summary(firsts: DataFrame) -> DataFrame:
    """Over trials (first_full): mean, population std, median, min and max."""
    c = F.col("first_full")
    return firsts.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))


def full_coverage_budget(darts: int, darts_each: int) -> int:
    return -(-darts // darts_each)


def hamming(a: Column, b: Column) -> Column:
    """Places where two arrays differ; a missing place differs. Our own definition."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def position_entropy(rows: DataFrame) -> DataFrame:
    """pos, entropy of the tokens of (pos, token) at each place, in nats. Our own definition."""
    n = rows.groupBy("pos", "token").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    return n.withColumn("p", p).groupBy("pos").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))
