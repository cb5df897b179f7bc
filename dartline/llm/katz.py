"""Scores of texts under a Katz backoff model, learned from the same table.

p(w | h) = d(r) r / D(h)             if w was seen r > 0 times after the context h
         = a(h) p(w | h')            otherwise; h' is h without its first word, and a(h) makes the sum over all words 1
p(w)     = d(c) c / N, or what that leaves over for the one class of all unknown words
h has order - 1 words at most, fewer near a text's begin, which is a word of its own kind. d are Katz's Good-Turing
discounts of each length of n-grams for counts up to LARGE. D(h) counts all that follows h; a context whose counts
are all larger has nothing discounted and counts one more, unseen, so that a(h) is above 0. Every context that was
seen in training is part of the model, those seen once, too (LEAST); unknown ones back off at once, with a(h) = 1.

The counts stay in tables partitioned by a hash; no table of words or n-grams is ever in one place.
1. A chunk of documents keeps its texts as numbers of its distinct words and asks the words' buckets,
   once for each distinct word, for its count in all of training; known words get an id by frequency.
2. For n = 2, ..., order it asks the buckets of the contexts, once for each distinct n-gram, for its count and for
   D(h); where the n-gram was never seen, also for how many followers of the context were seen once, twice, ... and
   the sum of their p(w | h'), from which a(h) follows. A bucket works that out from the count and D of the
   shorter n-gram, which come with the question and were answered the round before: an n-gram that was seen has
   an end that was seen. Only contexts of the model are asked about. From n = 3 on a round goes in PASSES over the
   buckets, so a share of its questions is on disk at a time; all are asked.
3. When all is answered each token is evaluated by the same recursion, from short contexts to long ones. A round
   of questions needs counts and D only.
Training and scoring share the questions, so a word or n-gram is sent once a chunk. A context with more
than a bucket's share of all tokens is spread over all buckets by n-gram; there are fewer such contexts
of each length than buckets, and their sums go to every task.

Contexts of two words or more are compared by hashes of 44 bits and the bucket. Chunks are numbered by scan task, but are written
to a table before anything is asked.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import Work, deltas, grouped, mix, ordered, pack, table, text_slices, undeltas, unpack

ORDER = 3
CHUNK = 6 << 20
LARGE = 5
#: Times that a context of two words or more must have been seen.
LEAST = 1
#: Parts of the buckets that are asked one after the other about n-grams of three words or more.
PASSES = 2
LOW = 40
#: The bits of a context's hash that are sent; which bucket it has is told by all of them.
BITS = 44
SENT = np.uint64((1 << BITS) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0xE220A8397B1DCDAF)
UNKNOWN, BEGIN, FIRST = 0, 1, 2
WIRE = "kind int, to long, chunk long, body binary"
#: kinds of rows: a chunk's texts, questions or answers, sums over a bucket, parts of spread contexts
TEXTS, CELLS, SUMS, PARTS = range(4)
#: answers about n-grams are of kind ANSWERS + n
ANSWERS = 10


def trains(doc_id: int | None, folds: int = 5, held: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != held


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1), ..., d(LARGE) from n[r - 1], the number of things seen r times, r = 1, ..., LARGE + 1.

    Where the counts give no discount between 0 and 1, (r - 0.5) / r.
    """
    out = []
    cut = (LARGE + 1) * n[LARGE] / n[0] if n[0] else 1.0
    for r in range(1, LARGE + 1):
        d = (((r + 1) * n[r] / n[r - 1]) / r - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r of each count r; 0 stays 0."""
    return count * np.concatenate([[0.0], d, [1.0]])[np.minimum(count, LARGE + 1).astype(np.int64)]


class Words:
    """p(w) by a word's count."""

    def __init__(self, n: np.ndarray, tokens: int):
        self.d, self.tokens = discounts(n), tokens
        left = float(((1 - self.d) * np.arange(1, LARGE + 1) * n[:LARGE]).sum())
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1.0) / self.total

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / self.total, self.unknown)


class Level:
    """What all buckets say of n-grams of one length: discounts d, and the sums of spread contexts (ids, D, seen, p)."""

    def __init__(self, d: np.ndarray, spread: list[np.ndarray]):
        self.d, self.spread = d, spread


def buckets_of(values: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def numbered_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place in them; only the distinct ones are sorted."""
    import pyarrow as pa

    coded = pa.array(values).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[coded.indices.to_numpy()]


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of texts the hashes of distinct words, the END among them; each token's place there; each text's number of tokens.

    A text is its words, A-Z lower-cased, and its end. Only distinct words become Python objects.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    # Arrow's white space are the six ASCII spaces; next to a text's begin or end they leave empty words
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    filled = pc.binary_length(flat).to_numpy() > 0
    words = flat.filter(pa.array(filled)).dictionary_encode()
    distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    up_to = np.concatenate([[0], np.cumsum(filled)])
    ends = up_to[np.cumsum(pc.list_value_length(split).to_numpy())]
    token = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(hashes))
    return np.append(hashes, END), token, np.diff(ends, prepend=0) + 1


def chunk_rows(rows, chunk: int, buckets: int):
    """A chunk's texts (doc_id and text of an Arrow batch), and its words with their training counts as questions to their buckets."""
    ids = rows.column("doc_id").to_pylist()
    hashes, token, lengths = token_hashes(rows.column("text"))
    train = np.array([trains(i) for i in ids])
    value = ((hashes >> np.uint64(LOW)) % np.uint64(buckets)) << np.uint64(LOW) | (hashes & np.uint64((1 << LOW) - 1))
    distinct, number = numbered_values(value)
    number = number[token]
    count = np.bincount(number, minlength=len(distinct))
    learned = np.bincount(number[np.repeat(train, lengths)], minlength=len(distinct)).astype(np.uint64)
    # texts hold ranks by frequency in the chunk, which are small numbers
    rank = np.empty(len(distinct), np.uint32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(distinct), dtype=np.uint32)
    bucket = (distinct >> np.uint64(LOW)).astype(np.int64)
    cells = np.bincount(bucket, minlength=buckets)
    missing = np.array([i is None for i in ids], np.uint8)
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    yield {"kind": TEXTS, "to": chunk, "chunk": chunk, "body": pack(numbers, missing, lengths, cells.astype(np.uint32), rank, rank[number])}
    low, at = distinct & np.uint64((1 << LOW) - 1), 0
    for b in np.flatnonzero(cells).tolist():
        n = int(cells[b])
        yield {"kind": CELLS, "to": b, "chunk": chunk, "body": pack(deltas(low[at : at + n]), learned[at : at + n])}
        at += n


def answer_words(bucket: int, rows: list[dict], buckets: int):
    """Of each chunk's words the count and id (0: unknown); the bucket's counts of counts, tokens and words."""
    cells = [unpack(r["body"]) for r in rows]
    lows = [undeltas(c[0]) for c in cells]
    distinct, number = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, number, np.concatenate([c[1] for c in cells]))
    ids = np.empty(len(distinct), np.uint64)
    ids[np.lexsort((distinct, -total.astype(np.int64)))] = FIRST + np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    ids[total == 0] = UNKNOWN
    at = 0
    for r, low in zip(rows, lows, strict=True):
        own = number[at : at + len(low)]
        at += len(low)
        yield {"kind": CELLS, "to": bucket, "chunk": r["chunk"], "body": pack(total[own], ids[own])}
    yield sums_row(bucket, total)


def sums_row(bucket: int, total: np.ndarray) -> dict:
    n = np.bincount(np.minimum(total, LARGE + 2).astype(np.int64), minlength=LARGE + 3)[1 : LARGE + 2]
    return {"kind": SUMS, "to": bucket, "chunk": None, "body": pack(np.concatenate([n, [int(total.sum()), int((total > 0).sum())]]).astype(np.int64))}


class Chunk:
    """A chunk's texts, and what is known of its tokens' n-grams of growing length; if scored, the tokens' probabilities, too."""

    def __init__(self, rows: list[dict], buckets: int, words: Words, scored: bool = False):
        own = next(r for r in rows if r["kind"] == TEXTS)
        self.ids, self.missing, self.lengths, cells, rank, text = unpack(own["body"])
        self.buckets, self.words, self.scored, self.n, n = buckets, words, scored, 1, len(rank)
        starts = np.concatenate([[0], np.cumsum(cells.astype(np.int64))])
        count, ids = np.zeros(starts[-1], np.uint64), np.zeros(starts[-1], np.uint64)
        for r in rows:
            if r["kind"] == CELLS:
                c, i = unpack(r["body"])
                count[starts[r["to"]] : starts[r["to"] + 1]], ids[starts[r["to"]] : starts[r["to"] + 1]] = c, i
        # words are numbered by id: UNKNOWN, BEGIN, then the known ones
        order = np.flatnonzero(ids != UNKNOWN)
        order = order[np.argsort(ids[order])]
        self.word_id = np.concatenate([np.array([UNKNOWN, BEGIN], np.uint64), ids[order]])
        number = np.full(n, UNKNOWN, np.int64)
        number[rank[order]] = FIRST + np.arange(len(order))
        self.word = number[text]
        self.starts = np.cumsum(self.lengths) - self.lengths
        # of the n-grams of this length: each token's (-1: none that was asked about), their counts, and D of their contexts
        self.place = self.word
        self.total = np.concatenate([np.zeros(FIRST, np.uint64), count[order]])
        self.divisor = np.full(len(self.total), words.total, np.uint64)
        if scored:
            self.word_count, self.p = self.total, words(self.total)[self.word]

    def ask(self, part: int = 0, parts: int = 1) -> None:
        """The distinct n-grams, one longer than before, in contexts of the model, by bucket, context and word.

        With parts, only those that buckets with number `part` modulo `parts` are asked about.
        """
        self.n += 1
        context = np.empty(len(self.word), np.int64)  # of every token: the n-gram before
        context[1:] = self.place[:-1]
        if self.n == 2:
            context[self.starts] = BEGIN
            own = np.arange(BEGIN, len(self.word_id))
            hashes, count = self.word_id[own], self.total[own]
            count[0] = self.words.tokens  # the begin is always spread
        else:
            context[self.starts] = -1
            own = np.flatnonzero(self.total >= LEAST)
            with np.errstate(over="ignore"):
                hashes, count = mix(self.context[own] * STEP + self.w[own]), self.total[own]
        bucket = buckets_of(hashes, self.buckets)
        spread = count.astype(np.float64) * self.buckets > self.words.tokens
        whole = ~spread if parts == 1 else ~spread & (bucket % parts == part)
        # of each context, by the bits that are sent: its number; -1: not asked about; -2, -3, ...: spread
        number = np.full(len(self.total) + 1, -1, np.int64)  # the last one is of no context
        number[own[spread]] = -2 - np.arange(np.count_nonzero(spread))
        entry = bucket[whole].astype(np.uint64) << np.uint64(BITS) | hashes[whole] & SENT
        number[own[whole]] = np.arange(len(entry))
        hashes, apart = hashes[whole], hashes[spread]
        number = number[context]
        # a spread context comes once for each bucket that its n-grams go to
        dealt, at = np.flatnonzero(number < -1), len(entry)
        if len(dealt):
            h = -2 - number[dealt]
            with np.errstate(over="ignore"):
                to = buckets_of(apart[h] * STEP + self.word_id[self.word[dealt]], self.buckets)
            number[dealt] = -1
            if parts > 1:
                own = to % parts == part
                dealt, h, to = dealt[own], h[own], to[own]
            distinct, place = numbered_values(to.astype(np.uint64) << np.uint64(BITS) | apart[h] & SENT)
            number[dealt] = at + place
            full = np.empty(len(distinct), np.uint64)
            full[place] = apart[h]
            entry, hashes = np.concatenate([entry, distinct]), np.concatenate([hashes, full])
        order = np.argsort(entry)
        rank = np.empty(len(entry) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(entry)), -1
        entry, hashes = entry[order], hashes[order]
        number = rank[number]
        self.known = np.flatnonzero(number >= 0)
        wide = len(self.word_id).bit_length()
        key, place = ordered(number[self.known] << wide | self.word[self.known])
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.at = np.empty(len(key), np.int64)
        self.at[place] = np.cumsum(new) - 1
        self.first, pair = self.known[place[new]], key[new]  # a token of each
        number = pair >> wide
        self.context, self.w = hashes[number], self.word_id[pair & ((1 << wide) - 1)]
        # of contexts: where their n-grams begin, and how many they have
        self.begin = np.flatnonzero(np.diff(number, prepend=-1))
        self.size = np.diff(self.begin, append=len(number))
        own = number[self.begin]
        self.h, self.spread = entry[own] & SENT, order[own] >= at
        # where the buckets' contexts begin, and their n-grams
        self.rows = np.searchsorted(entry[own], np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(BITS))
        self.cells = np.append(self.begin, len(number))[self.rows]

    def questions(self, chunk: int):
        """The questions to the buckets."""
        train = np.array([not m and trains(i) for i, m in zip(self.ids.tolist(), self.missing.tolist(), strict=True)], bool)
        learned = np.bincount(self.at[np.repeat(train, self.lengths)[self.known]], minlength=len(self.first)).astype(np.uint64)
        shorter = self.place[self.first]
        count, divisor = self.total[shorter], self.divisor[shorter[self.begin]]
        step = np.diff(self.w, prepend=np.uint64(0))
        step[self.begin] = self.w[self.begin]
        size, spread = self.size.astype(np.uint32), self.spread.astype(np.uint8)
        for b in np.flatnonzero(np.diff(self.cells)).tolist():
            own, all_of = slice(*self.rows[b : b + 2].tolist()), slice(*self.cells[b : b + 2].tolist())
            body = pack(deltas(self.h[own]), size[own], step[all_of], learned[all_of], count[all_of], divisor[own], spread[own])
            yield {"kind": CELLS, "to": b, "chunk": chunk, "body": body}

    def take(self, answers: list[dict], level: Level) -> None:
        """The n-grams' counts and contexts' D by the answers to the last questions; if scored, the tokens' probabilities."""
        total = np.zeros(len(self.first), np.uint64)
        divisor, weight = np.ones(len(self.begin), np.uint64), np.ones(len(self.begin))
        for r in answers:
            (low, high), (start, end) = self.rows[r["to"] : r["to"] + 2].tolist(), self.cells[r["to"] : r["to"] + 2].tolist()
            counts, div, *sums = unpack(r["body"])
            total[start:end] = counts
            whole = ~self.spread[low:high]
            divisor[low:high][whole] = div
            if self.scored:
                needy = low + np.flatnonzero(lacking(counts, self.begin[low:high] - start) & whole)
                weight[needy] = context_weights(divisor[needy], sums[:-1], sums[-1], level.d)
        if self.spread.any():
            ids, div, *sums = level.spread
            own = np.searchsorted(ids, self.h[self.spread])
            divisor[self.spread] = div[own]
            if self.scored:
                weight[self.spread] = context_weights(div, sums[:-1], sums[-1], level.d)[own]
        if self.scored:
            of_seen = discounted(total, level.d) / np.repeat(divisor, self.size)
            p = np.where(total > 0, of_seen, np.repeat(weight, self.size) * self.p[self.first])
            self.p[self.known] = p[self.at]
        self.place = np.full(len(self.word), -1, np.int64)
        self.place[self.known] = self.at
        self.total, self.divisor = total, np.repeat(divisor, self.size)


def lacking(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The contexts (from places first) with an n-gram that was never seen."""
    return np.minimum.reduceat(total, first) == 0


def answered(rows: list[dict], buckets: int, words: Words, levels: list[Level], scored: bool = False) -> Chunk:
    """A chunk with all that is known so far."""
    c = Chunk(rows, buckets, words, scored)
    for level in levels:
        c.ask()
        c.take([r for r in rows if r["kind"] == ANSWERS + c.n], level)
    return c


def ngram_questions(rows: list[dict], buckets: int, words: Words, levels: list[Level], part: int = 0, parts: int = 1):
    c = answered(rows, buckets, words, levels)
    c.ask(part, parts)
    yield from c.questions(rows[0]["chunk"])


def answer_ngrams(bucket: int, rows: list[dict], shorter: np.ndarray):
    """Of each chunk's n-grams the counts, of its contexts D and, where an n-gram is unseen, the sums over what follows.

    shorter: the discounts of n-grams one shorter.
    """
    asked = []
    for r in rows:
        h, n, step, learned, count, divisor, spread = unpack(r["body"])
        h, n = undeltas(h), n.astype(np.int64)
        # differences start anew at each context
        run = np.cumsum(step, dtype=np.uint64)
        first = np.cumsum(n) - n
        w = run - np.repeat(run[first] - step[first], n)
        asked.append((h, n, w, learned, count, divisor, spread, first))
    h, n, w, learned, count, divisor = (np.concatenate([a[k] for a in asked]) for k in range(6))
    context, of = numbered_values(h)
    number = np.repeat(of, n)
    wide = int(w.max()).bit_length()
    if wide + len(context).bit_length() < 64:
        key, order = sorted_places(number << wide | w.astype(np.int64))
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((w, number))
        new = np.concatenate([[True], (np.diff(number[order]) != 0) | (np.diff(w[order]) != 0)])
    first = np.flatnonzero(new)
    total = np.add.reduceat(learned[order], first)
    one = order[first]  # a question about each
    p = np.where(total > 0, discounted(count[one], shorter) / np.repeat(divisor, n)[one], 0.0)
    begin = np.flatnonzero(np.diff(number[one], prepend=-1))
    of_all = np.empty(len(order), np.uint64)
    of_all[order] = total[np.cumsum(new) - 1]
    seen = [np.add.reduceat((total == r).astype(np.uint64), begin) for r in range(1, LARGE + 1)]
    div = np.add.reduceat(total, begin)
    sums = [*seen, np.add.reduceat(p, begin)]
    spread, at, row = set(), 0, 0
    more = ~np.logical_or.reduce([s > 0 for s in seen])  # nothing is discounted: one more, unseen
    divisor = div + more
    for r, a in zip(rows, asked, strict=True):
        counts, own = of_all[at : at + len(a[2])], of[row : row + len(a[0])]
        at, row = at + len(a[2]), row + len(a[0])
        whole = a[6] == 0
        needy = own[lacking(counts, a[7]) & whole]
        spread.update(a[0][~whole].tolist())
        yield {"kind": CELLS, "to": bucket, "chunk": r["chunk"], "body": pack(counts, divisor[own[whole]], *[s[needy] for s in sums])}
    yield sums_row(bucket, total)
    if spread:
        ids = np.array(sorted(spread), np.uint64)
        own = np.searchsorted(context, ids)
        yield {"kind": PARTS, "to": bucket, "chunk": None, "body": pack(ids, div[own], *[s[own] for s in sums])}


def sorted_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ordered(), but equal numbers that are too large for it come in any order."""
    if int(values.max()).bit_length() + len(values).bit_length() < 64:
        return ordered(values)
    order = np.argsort(values)
    return values[order], order


def context_weights(divisor: np.ndarray, seen: list[np.ndarray], p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """a(h) of contexts, from D(h), how many followers were seen 1..LARGE times, and their sum of p(w | h')."""
    left = sum((1 - d[r - 1]) * r * s.astype(np.float64) for r, s in enumerate(seen, 1))
    return np.where(left > 0, left, 1.0) / divisor / (1 - p)


def spread_sums(pairs: DataFrame) -> list[np.ndarray]:
    """The spread contexts (fewer than buckets, a row of numbers each) with D and sums over all buckets."""
    parts = [unpack(r["body"]) for r in pairs.where(f"kind = {PARTS}").select("to", "body").orderBy("to").toLocalIterator()]
    if not parts:
        return []
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
    ids, number = np.unique(joined[0], return_inverse=True)
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange(len(ids)))
    div, *sums = [np.add.reduceat(x[order], begin) for x in joined[1:]]
    more = ~np.logical_or.reduce([s > 0 for s in sums[:-1]])
    return [ids, div + more, *sums]


def score_chunk(rows: list[dict], buckets: int, words: Words, vocabulary: int, levels: list[Level]):
    """One row a document: its tokens, base score and score."""
    c = answered(rows, buckets, words, levels, scored=True)
    base = np.log10((c.word_count.astype(np.float64) + 0.5) / (words.tokens + 0.5 * (vocabulary + 1)))
    known = (c.word_count > 0).astype(np.int64)
    columns = (c.lengths, *[np.add.reduceat(x, c.starts) for x in (known[c.word], base[c.word], np.log10(c.p))])
    for i, missing, n, known, b, s in zip(c.ids.tolist(), c.missing.tolist(), *[x.tolist() for x in columns], strict=True):
        held = not missing and not trains(i)
        yield {"doc_id": None if missing else i, "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": words.tokens, "base_score": b, "score": s}


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def added(rows: DataFrame) -> np.ndarray:
    """Sums of all buckets' sums: one short row a bucket."""
    return sum((unpack(r["body"])[0] for r in rows.where(f"kind = {SUMS}").select("body").toLocalIterator()), np.zeros(LARGE + 3, np.int64))


def score_texts(docs: DataFrame, buckets: int | None = None, order: int = ORDER) -> DataFrame:
    """SCORES of every row of docs; extra columns are ignored.

    Learned from rows whose crc32(doc_id as text) mod 5 is not 1. Rows without doc_id are scored, not
    learned from. A null or empty text is its end alone. With nothing learned all words are unknown and
    have probability 1. Rows that repeat are learned and scored as often as they come. Empty docs: no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = Work(spark)

    def split(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 24
        schema = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
        for rows in text_slices(batches, CHUNK):
            yield pa.RecordBatch.from_pylist(list(chunk_rows(rows, at, buckets)), schema=schema)
            at += 1

    written = work.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, WIRE), by="kind", compression="none")
    chunks = written.select("kind", "to", "chunk", "body")
    texts, cells = chunks.where(f"kind = {TEXTS}"), chunks.where(f"kind = {CELLS}")
    counts = work.keep(grouped(cells, ["to"], lambda key, rows: answer_words(key[0], rows, buckets), WIRE, size=64), compression="none")
    work.drop(written, part=f"kind={CELLS}")
    n = added(counts)
    words, vocabulary = Words(n[: LARGE + 1], int(n[-2])), int(n[-1])

    known, levels = texts.unionByName(counts.where(f"kind = {CELLS}")), []
    for n in range(2, order + 1):
        so_far, shorter = list(levels), levels[-1].d if levels else words.d
        parts, pairs = PASSES if n > 2 else 1, None
        for part in range(parts):
            asked = grouped(known, ["chunk"], lambda _, rows, so_far=so_far, part=part, parts=parts: ngram_questions(rows, buckets, words, so_far, part, parts), WIRE, size=64)
            own = work.keep(grouped(asked, ["to"], lambda key, rows, shorter=shorter: answer_ngrams(key[0], rows, shorter), WIRE, size=64), compression="none")
            pairs = own if pairs is None else pairs.unionByName(own)
        levels.append(Level(discounts(added(pairs)[: LARGE + 1]), spread_sums(pairs)))
        known = known.unionByName(pairs.where(f"kind = {CELLS}").withColumn("kind", F.lit(ANSWERS + n)))
    return grouped(known, ["chunk"], lambda _, rows: score_chunk(rows, buckets, words, vocabulary, levels), SCORES, size=10_000)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
