"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

Each class has an interpolated bigram model. Its bigram counts back off to the class's continuation
counts (how many different words precede a word) and those to counts that the classes share (in how
many classes a word is known at all), so a rare expression speaks for neither class. A text is compared by
length-normalised log-likelihood, toxic minus ordinary: over all its words, and over its most toxic
passage of 1, 4 and 16 words, since a long text can be toxic in one place. The same is taken from the
models' lower order alone, which a passage copied from one sampled text can't sway. A logistic curve
turns these into a probability; it is fitted on scores by models that haven't seen the text (FOLDS parts).

Labels are learned from a sample of at most `sample` documents of each class, the ones with the
smallest hash of doc_id, and of those as many as hold `sample_bytes` bytes of text together (one at least): the
bound that keeps the model in memory and what is sent the same, however long the texts. The classes' frequencies
come from all labelled rows. Scoring needs no shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.llm.common import WordHashes, crc_fold, deltas, grouped, hash_texts, mix, pack, plain_words, row_slices, segment_ids, table, undeltas, unpack

#: Documents of a class, and bytes of their texts together, that are learned at most.
SAMPLE = 2000
SAMPLE_BYTES = 64 << 20
DISCOUNT = 0.75
PASSAGES = (1, 4, 16)
#: Two orders, each over the whole text and its best passages; length; 1.
FEATURES = 2 * (len(PASSAGES) + 1) + 2
THRESHOLD = 0.3
FOLDS = 6
START = np.uint64(0x9E3779B97F4A7C15)


def pairs(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (START before a text's first) and the hash of the two."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = START
    with np.errstate(over="ignore"):
        return before, mix(mix(before) + flat)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class TwoModels:
    """Both classes' models over one table of words and one of bigrams."""

    def __init__(self, words: np.ndarray, bigrams: np.ndarray, before: np.ndarray, word: np.ndarray, counts: list[np.ndarray]):
        """before, word: places in words of each bigram's two; counts: of each bigram in either class."""
        self.words, self.bigrams, size = words, bigrams, len(words)
        conts = [np.bincount(word[c > 0], minlength=size) for c in counts]
        types = sum((c > 0).astype(np.int64) for c in conts)  # in how many classes a word is known
        shared = (types + 0.5) / (types.sum() + 0.5 * (size + 1))
        self.held, self.rest, self.lower, self.unseen = [], [], [], []
        for count, cont in zip(counts, conts, strict=True):
            total = np.bincount(before, weights=count, minlength=size)
            follow = np.bincount(before[count > 0], minlength=size)
            kinds = max(int(cont.sum()), 1)
            free = DISCOUNT * int((cont > 0).sum()) / kinds if cont.sum() else 1.0
            self.lower.append((np.maximum(cont - DISCOUNT, 0) / kinds + free * shared).astype(np.float32))
            self.unseen.append(free * 0.5 / (types.sum() + 0.5 * (size + 1)))
            self.held.append((np.maximum(count - DISCOUNT, 0) / np.maximum(total[before], 1)).astype(np.float32))
            self.rest.append(np.where(total > 0, DISCOUNT * follow / np.maximum(total, 1), 1.0).astype(np.float32))

    def packed(self) -> dict:
        return {"unseen": self.unseen, "tables": pack(deltas(self.words), deltas(self.bigrams), *self.held, *self.rest, *self.lower)}

    @classmethod
    def unpacked(cls, state: dict) -> TwoModels:
        out = cls.__new__(cls)
        words, bigrams, *rows = unpack(state["tables"])
        out.words, out.bigrams, out.unseen = undeltas(words), undeltas(bigrams), state["unseen"]
        out.held, out.rest, out.lower = rows[:2], rows[2:4], rows[4:]
        return out

    def ratios(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | before, toxic) - log p(word | before, ordinary) of each word; the same without `before`."""
        _, pair = pairs(flat, lengths)
        at_w, in_w = find(self.words, flat)
        at_b = np.empty_like(at_w)
        in_b = np.empty_like(in_w)
        at_b[1:], in_b[1:] = at_w[:-1], in_w[:-1]
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        at_b[starts], in_b[starts] = [x[0] for x in find(self.words, np.array([START]))]
        both = np.flatnonzero(in_w & in_b)
        at_p, in_p = find(self.bigrams, pair[both])
        at_p, both = at_p[in_p], both[in_p]
        logs, lows = [], []
        for k in (0, 1):
            lower = np.where(in_w, self.lower[k][at_w], np.float32(self.unseen[k]))
            p = np.where(in_b, self.rest[k][at_b], np.float32(1)) * lower
            p[both] += self.held[k][at_p]
            logs.append(np.log(p, dtype=np.float64))
            lows.append(np.log(lower, dtype=np.float64))
        return logs[1] - logs[0], lows[1] - lows[0]

    def features(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each text and order: mean ratio, the best mean over a passage of each length; log of its length, and 1."""
        width = len(PASSAGES) + 1
        out = np.zeros((len(lengths), FEATURES))
        out[:, -1] = 1
        out[:, -2] = np.log1p(lengths) / 5
        has = lengths > 0
        if not has.any():
            return out
        n, starts = lengths[has], (np.cumsum(lengths) - lengths)[has]
        ends, at = np.repeat(starts + n, n), np.arange(len(flat))
        for order, r in enumerate(self.ratios(flat, lengths)):
            out[has, order * width] = np.add.reduceat(r, starts) / n
            sums = np.concatenate([[0.0], np.cumsum(r)])
            for j, k in enumerate(PASSAGES):
                # a passage that the text's end cuts short is divided by its full length
                out[has, order * width + 1 + j] = np.maximum.reduceat((sums[np.minimum(at + k, ends)] - sums[at]) / k, starts)
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit(rows: list[dict], counts: tuple[int, int]) -> dict:
    """The scorer of sampled rows (doc_id, text, toxic); counts: ordinary and toxic rows in all."""
    rows = sorted(rows, key=lambda r: (r["order"], r["text"] or ""))
    label = np.array([r["toxic"] for r in rows])
    base = counts[1] / max(sum(counts), 1)
    if not len(rows) or label.min() == label.max():
        return {"base": base}
    flat, lengths = hash_texts([r["text"] for r in rows], WordHashes(), plain_words)
    if not len(flat):
        return {"base": base}
    before, pair = pairs(flat, lengths)
    bigrams, first, ids = np.unique(pair, return_index=True, return_inverse=True)
    words = np.unique(np.concatenate([flat, [START]]))
    place = np.searchsorted(words, before[first]), np.searchsorted(words, flat[first])
    del before, pair, first
    of_token = segment_ids(lengths)

    def train(keep):
        return TwoModels(words, bigrams, *place, [np.bincount(ids[(keep & (label == k))[of_token]], minlength=len(bigrams)) for k in (0, 1)])

    rank = np.empty(len(rows), np.int64)
    for k in (0, 1):
        rank[label == k] = np.arange((label == k).sum())
    x = np.zeros((len(rows), FEATURES))
    for k in range(FOLDS):
        own = rank % FOLDS == k
        if own.any():
            x[own] = train(~own).features(flat[own[of_token]], lengths[own])
    weight = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    beta = logistic(x / scale, label, weight * len(rows) / weight.sum()) / scale
    return {"base": base, "models": train(np.ones(len(rows), bool)).packed(), "beta": beta}


class Scorer:
    """Scores texts by a pickled result of fit()."""

    def __init__(self, fitted: bytes):
        self.fitted = pickle.loads(fitted)
        self.models = TwoModels.unpacked(self.fitted["models"]) if "models" in self.fitted else None
        self.hashes = WordHashes()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.fitted["base"])
        x = self.models.features(*hash_texts(texts, self.hashes, plain_words))
        return 1 / (1 + np.exp(-np.clip(x @ self.fitted["beta"], -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, fold: int | None = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """A broadcast scorer from labelled rows whose crc32(doc_id as text) mod 4 is not `fold`.

    A doc_id with several labels is toxic if one says so; null labels and ids are left out. A doc_id
    that repeats in docs gives all its texts.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if fold is not None:
        known = known.where(crc_fold("doc_id", 4) != fold)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("toxic") == k).withColumn("order", order).orderBy("order", "doc_id").limit(sample) for k in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * sample rows at most
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    place = Window.partitionBy("toxic").orderBy("order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(place), F.lit(0))).where(F.col("before") < sample_bytes).drop("before")
    totals = (counts.get(0, 0), counts.get(1, 0))
    model = grouped(texts.select(F.lit(0).alias("one"), "order", "toxic", "text"), ["one"], lambda _, rows: [{"model": pickle.dumps(fit(rows, totals), 5)}], "model binary").toArrow().column("model")  # fewer copies in the driver than collect() makes
    return spark.sparkContext.broadcast(model[0].as_py() if len(model) else pickle.dumps({"base": totals[1] / max(sum(totals), 1)}))


def score(docs: DataFrame, scorer) -> DataFrame:
    """doc_id and score of every row; a null or empty text is scored as a text without words."""

    def run(batches):
        import pyarrow as pa

        own = Scorer(scorer.value)
        for rows in row_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(own(rows["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold, all columns as they were. No shuffle.

    The text travels with its row, so rows that repeat a doc_id, or have none, are judged one by one.
    """
    scorer = learn(docs, labels)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        import pyarrow as pa

        own = Scorer(scorer.value)
        for rows in row_slices(batches):
            keep = pa.array(own(rows["text"]) < threshold)
            yield pa.RecordBatch.from_pydict(rows, schema=arrow).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
