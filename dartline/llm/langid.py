"""Language identification, word first.

A word seen in training scores by its log frequency in each language. A word never seen falls back to
its character n-grams, of LONGEST characters at first and shorter until one is known; it scores the mean
log frequency of those that are. A text's language is the one with the highest sum over its words.

Every language is learned. Each is learned from a sample, its documents with the smallest hashes of doc_id, up to
`sample` documents, or `sample_bytes` bytes of text in all languages together over their number, whichever is
first (one document at least): the bound that keeps the model in memory. Words are counted a language a task, and
the counts become the model in one. Identification needs no shuffle.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dartline.llm.common import Work, crc_fold, grouped, row_slices, table

#: Documents of a language that are learned at most, and bytes of text of all languages together.
SAMPLE = 3000
SAMPLE_BYTES = 256 << 20
#: Languages whose counts are broadcast; of more, rows are shuffled to their language's.
BROADCAST = 100_000
LONGEST = 5
#: A word that training has seen less often is left to its n-grams.
SEEN = 2
REMEMBERED = 300_000
#: Words are lower-case runs of ASCII letters and all bytes beyond ASCII.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def grams(word: bytes, n: int) -> list[str]:
    padded = f"<{word.decode('utf-8', 'replace')}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def rows_of(counts: list[Counter], least: int) -> dict:
    """Keys seen `least` times, and their log frequencies by language, less the mean over languages."""
    total = Counter()
    for c in counts:
        total.update(c)
    keys = sorted(k for k, n in total.items() if n >= least)
    table = np.array([[c[k] for c in counts] for k in keys], np.float64).reshape(len(keys), len(counts)) + 0.5
    table = np.log(table / (np.array([c.total() for c in counts]) + 0.5 * (len(total) + 1)))
    return {"keys": keys, "table": (table - table.mean(1, keepdims=True)).astype(np.float32)}


def count_words(texts: Iterable[str]) -> Counter:
    out = Counter()
    for text in texts:
        out.update(letter_words(text))
    return out


def fit(words: dict[str, Counter]) -> dict:
    """The model of the languages' word counts."""
    langs = sorted(words)
    words = [words[lang] for lang in langs]
    by_length = []
    for n in range(1, LONGEST + 1):
        counts = [Counter() for _ in langs]
        for c, own in zip(counts, words, strict=True):
            for word, k in own.items():
                for g in grams(word, n):
                    c[g] += k
        by_length.append(rows_of(counts, 1))
    return {"langs": langs, "words": rows_of(words, SEEN), "grams": by_length}


class Scorer:
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.known = {k: i for i, k in enumerate(model["words"]["keys"])}
        self.grams = [({k: i for i, k in enumerate(g["keys"])}, g["table"]) for g in model["grams"]]
        self.base = len(self.known)
        # rows of known words first, then of the unseen words met so far
        self.table = np.concatenate([model["words"]["table"], np.zeros((REMEMBERED, len(self.langs)), np.float32)])
        self.met: dict[bytes, int] = {}

    def vector(self, word: bytes) -> np.ndarray:
        """An unseen word's scores."""
        for n in range(LONGEST, 0, -1):
            index, table = self.grams[n - 1]
            known = [index[g] for g in grams(word, n) if g in index]
            if known:
                return table[known].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def at(self, word: bytes) -> int:
        i = self.known.get(word)
        if i is None and (i := self.met.get(word)) is None:
            i = self.met[word] = self.base + len(self.met)
            self.table[i] = self.vector(word)
        return i

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            words = letter_words(text)
            if not self.langs or not text or not any(c.isalpha() for c in text):
                langs.append("und")
                scores.append(0.0)
                continue
            sums = np.zeros(len(self.langs))
            for start in range(0, len(words), 100_000):  # a very long text, part by part
                part = words[start : start + 100_000]
                if len(self.met) + len(part) > REMEMBERED:
                    self.met.clear()
                sums += self.table[np.fromiter(map(self.at, part), np.int64, len(part))].sum(0, dtype=np.float64)
            sums /= max(len(words), 1) ** 0.5
            best = int(sums.argmax())  # a tie goes to the first language by code point
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return langs, scores


def learn(docs: DataFrame, fold: int | None = 1, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """A broadcast model from rows with text and lang whose crc32(doc_id as text) mod 3 is not `fold`.

    Rows that repeat are learned as often as they are sampled; which ones are doesn't depend on their order.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    if fold is not None:
        rows = rows.where(crc_fold("doc_id", 3) != fold)
    order = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 11) / F.lit(2.0**53)
    counts = Work(spark).keep(rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    n = counts.count()
    share = max(sample_bytes // max(n, 1), 1)
    small = F.broadcast(counts) if n <= BROADCAST else counts
    # hashes below the share that holds the sample, with room to spare; then the smallest of those
    likely = (F.col("order") * F.col("n") < 1.3 * sample + 100) & (F.col("order") * F.col("bytes") < 1.3 * share + (4 << 20))
    few = rows.withColumn("order", order).join(small, "lang").where(likely | (F.col("order") * F.col("n") < 30))
    place = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    before = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumns({"place": F.row_number().over(place), "before": before}).where((F.col("place") <= sample) & (F.col("before") < share))

    def counted(_, own):
        yield {"lang": own[0]["lang"], "words": pickle.dumps(count_words(r["text"] for r in own), 5)}

    def fitted(_, own):
        yield {"model": pickle.dumps(fit({r["lang"]: pickle.loads(r["words"]) for r in own}), 5)}

    words = grouped(few.select("lang", "text"), ["lang"], counted, "lang string, words binary", size=1)
    model = grouped(words.select(F.lit(0).alias("one"), "lang", "words"), ["one"], fitted, "model binary").collect()  # one row of bounded size
    return spark.sparkContext.broadcast(pickle.loads(model[0]["model"]) if model else {"langs": [], "words": {"keys": [], "table": np.zeros((0, 0), np.float32)}, "grams": []})


def identify(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, the winner's share) of every row, extra columns ignored.

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned.
    """

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model.value)
        for rows in row_slices(batches):
            langs, scores = scorer(rows["text"])
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
