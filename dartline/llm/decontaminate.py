"""Benchmark decontamination by spaced-seed hashing.

A mask is a pattern of token positions; a seed is the hash of the tokens at its ones, so a substitution
at a zero doesn't change it. Seeds of all masks are taken at every place of the benchmark's items and of
the documents, and joined. A hit says which item may stand where in a document; the words around it are
then compared place by place, and a document is contaminated if WINDOW neighbouring words of an item (the
whole item, if shorter) stand in it with at least `share` of them equal.

With MASKS, every pattern of 2 substitutions in 13 words, or of 4 in 20, leaves a hit. An item shorter than
WINDOW is cut into one piece more than it may have substitutions: one of them is whole wherever the item
stands, so the pieces' hashes are its seeds and nothing is missed, whatever its length: recall is 1 from one
word on. Words: A-Z and other letters lower-cased, ASCII punctuation left out. Items without item_id are
searched, too; items without words stand nowhere. Items go to every task in slices of about ITEM_WORDS
words, an item longer than that in pieces that overlap by a window: a larger benchmark takes more passes, never
more memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import Work, WordHashes, fresh, hash_texts, mapped, mix, plain_words, row_slices, segment_ids, table

MASKS = ("111111", "11101011", "101000011011")
WINDOW = 13
SHARE = 0.8
ITEM_WORDS = 500_000
#: Places of short items that are compared at a time.
COMPARED = 1 << 18
#: Bits of the table that sorts out most places before the exact lookup.
SIEVE = 24
HITS = "array<struct<item_id long, doc_word long, item_word long, words int, equal int>>"


def item_words(text: str | None) -> list[bytes]:
    return plain_words(text.lower()) if text else []


def seeds(flat: np.ndarray, segment: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one mask at every place where it fits in a segment, and those places."""
    span = len(mask)
    n = len(flat) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(segment[:n] == segment[span - 1 :])
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, one in enumerate(mask):
            if one == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + n]
        return mix(h[at]), at


class Seeds:
    """Hashes of the items' seeds of one mask, and where they stand in the items' words."""

    def __init__(self, mask: str, h: np.ndarray, at: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.mask, self.keys, self.places = mask, h[order], at[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)] = True

    def found(self, flat: np.ndarray, segment: np.ndarray, most: int | None = None):
        """Pairs (document places, item places) of equal seeds, `most` at a time."""
        h, at = seeds(flat, segment, self.mask)
        likely = np.flatnonzero(self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)])
        h, at = h[likely], at[likely]
        low, high = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
        ends = np.cumsum(high - low)
        total = int(ends[-1]) if len(ends) else 0
        for start in range(0, total, most or max(total, 1)):
            k = np.arange(start, min(total, start + (most or total)))
            i = np.searchsorted(ends, k, side="right")
            yield at[i], self.places[high[i] - (ends[i] - k)]


class Items:
    """The seeds of some items, ready to be looked up."""

    def __init__(self, items: list[tuple], masks=MASKS, window: int = WINDOW, share: float = SHARE):
        """items: id, text and, for a piece of a long item, its first word's place in it."""
        self.window, self.share = window, share
        hashes = WordHashes()
        inorder = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", *x[2:]))
        own = [(i, at, np.array([hashes[w] for w in ws], np.uint64)) for i, t, *at in inorder if (ws := item_words(t))]
        self.ids, self.offsets = [i for i, _, _ in own], [sum(at) for _, at, _ in own]
        lengths = np.array([len(w) for _, _, w in own], np.int64)
        self.words = np.concatenate([w for _, _, w in own]) if own else np.zeros(0, np.uint64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths, self.of = lengths, segment_ids(lengths)
        self.masks, self.pieces = [], []
        for m in masks:
            h, at = seeds(self.words, self.of, m)
            whole = lengths[self.of[at]] >= window
            self.masks.append(Seeds(m, h[whole], at[whole]))
        places: dict[int, list[int]] = {}
        for first, n in zip(self.starts.tolist(), lengths.tolist(), strict=True):
            if n < window:
                parts = min(n, n - self.needed(n) + 1)
                cuts = [n * k // parts for k in range(parts + 1)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    places.setdefault(b - a, []).append(first + a)
        for n, own_places in places.items():
            h, at = seeds(self.words, self.of, "1" * n)
            piece = np.isin(at, own_places)
            self.pieces.append(Seeds("1" * n, h[piece], at[piece]))

    def needed(self, n: int) -> int:
        """Equal words that a window of n must have."""
        return math.ceil(self.share * n - 1e-9)

    def enough(self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Those of the alignments of short items with enough equal words."""
        at, item, d = rows.T
        n, equal = self.lengths[item], np.zeros(len(rows), np.int64)
        for j in range(int(n.max())):
            place = at + j
            inside = (j < n) & (place >= starts[d]) & (place < ends[d])
            equal[inside] += flat[place[inside]] == self.words[self.starts[item[inside]] + j]
        return rows[equal >= np.ceil(self.share * n - 1e-9)]

    def alignments(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distinct (document word - item word), item and document of all hits, as rows."""
        segment, ends, out = segment_ids(lengths), np.cumsum(lengths), []
        for own, most in [*((m, None) for m in self.masks), *((p, COMPARED) for p in self.pieces)]:
            for at, place in own.found(flat, segment, most):
                item = self.of[place]
                rows = np.stack([at - (place - self.starts[item]), item, segment[at]], 1)
                out.append(rows if most is None else self.enough(rows, flat, ends - lengths, ends))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def hits(self, flat: np.ndarray, lengths: np.ndarray) -> dict[int, list[dict]]:
        """By document (its number in lengths), the alignments that hold a window with enough equal words."""
        starts = np.cumsum(lengths) - lengths
        out: dict[int, list[dict]] = {}
        for at, item, d in self.alignments(flat, lengths).tolist():
            n, first = int(self.lengths[item]), int(self.starts[item])
            low, high = max(0, int(starts[d]) - at), min(n, int(starts[d] + lengths[d]) - at)
            k = min(self.window, n)
            need = self.needed(k)
            if high - low < need:
                continue
            equal = np.zeros(n, np.int64)
            equal[low:high] = flat[at + low : at + high] == self.words[first + low : first + high]
            sums = np.concatenate([[0], np.cumsum(equal)])
            if (sums[k:] - sums[:-k]).max() >= need:
                out.setdefault(d, []).append({"item_id": self.ids[item], "doc_word": at + low - int(starts[d]), "item_word": self.offsets[item] + low, "words": high - low, "equal": int(equal.sum())})
        return out


def item_pieces(rows, words: int, window: int):
    """Items as pieces of at most words + window - 1 words: a window of an item is whole in one of them."""
    for r in rows:
        own = item_words(r["text"])
        for at in range(0, max(len(own) - window, 0) + 1, words):
            yield {"item_id": r["item_id"], "at": at, "words": min(len(own) - at, words + window - 1), "text": b" ".join(own[at : at + words + window - 1]).decode("utf-8", "surrogatepass")}


def slices(benchmark: DataFrame, words: int, window: int = WINDOW) -> Iterator[list[tuple]]:
    """The items' pieces in lists of about `words` words each, read one list at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    pieces = Work(benchmark.sparkSession).keep(mapped(items, lambda rows: item_pieces(rows, max(words, window), window), "item_id long, at long, words long, text string", size=64))
    n = max(1, math.ceil((pieces.agg(F.sum("words").alias("n")).first()["n"] or 0) / words))
    for k in range(n):
        part = pieces.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "at", "text"), F.lit(n)) == k) if n > 1 else pieces
        yield [(r["item_id"], r["text"], r["at"]) for r in part.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, share: float = SHARE, item_words_at_once: int = ITEM_WORDS, into: str = "hits") -> DataFrame:
    """docs, all columns, with a last column `into`: where items stand in the row's text.

    A null or empty text has no hits, nor has any text if the benchmark is empty. Rows that repeat are
    searched one by one; so are the items that repeat. Hits of items without id have no item_id. A passage that runs
    over two pieces of a very long item is one hit in each. A column of docs of that name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    out = docs.drop(into).withColumn(into, F.expr(f"cast(array() as {HITS})"))
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema))
    arrow = to_arrow_schema(schema)
    work, held = Work(spark), None
    for items in slices(benchmark, item_words_at_once, window):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            import pyarrow as pa

            index, hashes = Items(sent.value, masks, window, share), WordHashes()
            for rows in row_slices(batches):
                flat, lengths = hash_texts(rows["text"], hashes, item_words)
                for d, found in index.hits(flat, lengths).items():
                    rows[into][d] = [*rows[into][d], *found]
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)

        if held is not None:  # one slice is in a task's memory at a time
            out = work.keep(out)
        out = held = out.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they were. No shuffle."""
    into = fresh(docs.columns, "hits")
    return find_hits(docs, benchmark, into=into).where(F.size(into) == 0).drop(into)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).alias("n_items"), items.alias("items"))
