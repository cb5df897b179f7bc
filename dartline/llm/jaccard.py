"""N-gram Jaccard join: every link between texts whose shingle sets are alike enough, exactly.

1. Texts become sets of hashed shingles. A chunk of documents keeps its sets as numbers of the chunk's
   distinct shingles and sends those, once each, to buckets by hash; a bucket adds up in how many sets
   a shingle occurs and answers for those of two or more. Nothing is sent per occurrence, so a shingle
   of a third of all documents costs a bucket one entry a chunk.
2. A set that can link holds a share `alike` of shingles that others have too; the rest drop out. Equal
   sets are one class from here on.
3. Shingles are ordered by frequency, rarest first. Sets that link share one of the first
   n - ceil(alike * n) + 1 shingles of either (its prefix). Components over shared prefixes are blocks:
   all links lie inside blocks. In a block of more than BLOCK shingles, each set is first compared with the
   smallest set of each prefix list that it is in; most of a large group of near copies is one component
   then. That component's sets need no comparison with each other: they are cut into parts by hash, the
   block's other sets too, and every part of the others is searched with every part.
4. Inside a block each set asks for the earlier sets that share at least T = ceil(alike * n) shingles
   with it (T-occurrence, DivideSkip): the longest inverted lists are put aside, the short ones merged by a
   heap of their heads that jumps over members with too few lists, and sets that reach T less the number of
   long lists are looked up in those by binary search. The merge goes from the largest candidate down; with
   the first link to a group, all of that group's members leave the lists, so what is known to be in one
   component isn't compared again, and most of a group of near copies is never merged.
5. Each search names the groups it found; components over those are the result.

Shingles are compared by hashes of 40 bits and the bucket, set sizes and classes by 64 and 128 bits: exact but for
collisions of those between the sets of one block.
Chunks are numbered by scan task, so `docs` must be readable again in the same order, as tables are.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import Work, WordHashes, deltas, grouped, hash_texts, mapped, mix, pack, row_slices, segment_ids, table, undeltas, unpack
from dartline.operators.connectivity import components

WORDS = 5
#: Alike enough: 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
CHUNK = 4 << 20
BLOCK = 200_000
LOW = 40
#: The share of a skipped list's cost in DivideSkip's choice of the long lists.
MU = 0.01


def need(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def shingles(flat: np.ndarray, lengths: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted in each; and how many. Fewer words than that: one of all."""
    doc = segment_ids(lengths)
    parts, owners = [], []
    n = len(flat) - words + 1
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        if n > 0:
            h = np.zeros(n, np.uint64)
            for i in range(words):
                h = h * step + flat[i : i + n]
            inside = doc[:n] == doc[words - 1 :]
            parts.append(mix(h[inside]))
            owners.append(doc[:n][inside])
        starts = np.cumsum(lengths) - lengths
        for d in np.flatnonzero((lengths > 0) & (lengths < words)):
            h = np.uint64(lengths[d])
            for w in flat[starts[d] : starts[d] + lengths[d]]:
                h = h * step + w
            parts.append(mix(np.array([h ^ np.uint64(0xD1B54A32D192ED03)])))
            owners.append(np.array([d]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.min_scalar_type(len(lengths))), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(lengths))


def chunk_rows(ids: list, texts: list, marks: list[list], chunk: int, buckets: int, hashes: WordHashes, words: int):
    """A chunk's own row (kind 0) and its questions to the buckets (kind 1); marks: two hashes of each text."""
    import xxhash

    flat, lengths = hash_texts(texts, hashes)
    h, sizes = shingles(flat, lengths, words)
    ends = np.cumsum(sizes)
    prints = np.zeros((len(texts), 2), np.uint64)
    first, of = {}, np.full(len(texts), -1, np.int64)  # the chunk's distinct sets, by first document
    keep = np.zeros(len(h), bool)
    for d, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        if n:
            key = xxhash.xxh3_128_digest(h[end - n : end].tobytes())
            prints[d] = np.frombuffer(key, np.uint64)
            if (key, n) not in first:
                first[key, n] = d
                of[d] = len(first) - 1
                keep[end - n : end] = True
    h = h[keep]
    owner = segment_ids(sizes)[keep]
    value = ((h >> np.uint64(LOW)) % np.uint64(buckets)) << np.uint64(LOW) | (h & np.uint64((1 << LOW) - 1))
    distinct, number, count = np.unique(value, return_inverse=True, return_counts=True)
    wide = len(distinct).bit_length()
    both = np.sort(owner << wide | number)
    number, owner = (both & ((1 << wide) - 1)).astype(np.uint32), both >> wide
    step = number.copy()
    step[1:] = np.where(owner[1:] == owner[:-1], number[1:] - number[:-1], number[1:])
    bucket = (distinct >> np.uint64(LOW)).astype(np.int64)
    cells = np.bincount(bucket, minlength=buckets)
    missing = np.array([i is None for i in ids], np.uint8)
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    yield {"kind": 0, "to": chunk, "chunk": chunk, "body": pack(numbers, missing, *(np.array(m, np.int64) for m in marks), sizes, prints.reshape(-1), of, cells.astype(np.uint32), step)}
    low, at = distinct & np.uint64((1 << LOW) - 1), 0
    for b in np.flatnonzero(cells).tolist():
        n = int(cells[b])
        yield {"kind": 1, "to": b, "chunk": chunk, "body": pack(deltas(low[at : at + n]), np.minimum(count[at : at + n], 65535).astype(np.uint16))}
        at += n


def answer(rows: list[dict]):
    """A bucket's answers: of each chunk's shingles, those of two or more sets and their frequency up to 255."""
    cells = [unpack(r["body"]) for r in rows]
    lows = [undeltas(c[0]) for c in cells]
    _, number = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([c[1] for c in cells]))[number]
    at = 0
    for r, low in zip(rows, lows, strict=True):
        f = total[at : at + len(low)]
        at += len(low)
        shared = f >= 2
        if shared.any():
            yield {"kind": 1, "to": r["to"], "chunk": r["chunk"], "body": pack(np.packbits(shared), deltas(low[shared]), np.minimum(f[shared], 255).astype(np.uint8))}


def documents_of(rows: list[dict], percent: int):
    """A chunk's documents with size and class; a set that may link comes with its shared shingles once."""
    own = next(r for r in rows if r["kind"] == 0)
    ids, missing, t0, t1, sizes, prints, of, cells, step = unpack(own["body"])
    starts = np.concatenate([[0], np.cumsum(cells.astype(np.int64))])
    frequency = np.ones(starts[-1], np.uint8)
    value = np.zeros(starts[-1], np.uint64)
    for r in rows:
        if r["kind"] == 1:
            bits, low, f = unpack(r["body"])
            b = r["to"]
            at = starts[b] + np.flatnonzero(np.unpackbits(bits, count=int(cells[b])))
            frequency[at] = f
            value[at] = np.uint64(b) << np.uint64(LOW) | undeltas(low)
    prints = prints.reshape(-1, 2).view(np.int64)
    at = 0
    for d, n in enumerate(sizes.tolist()):
        body = None
        if of[d] >= 0:
            number = np.cumsum(step[at : at + n], dtype=np.int64)
            at += n
            f = frequency[number]
            shared = f >= 2
            if int(shared.sum()) >= need(n, percent):
                body = pack(deltas(value[number[shared]]), f[shared])
        yield {"doc_id": None if missing[d] else int(ids[d]), "t0": int(t0[d]), "t1": int(t1[d]), "n": n, "p0": int(prints[d, 0]), "p1": int(prints[d, 1]), "shared": body}


def prefix(n: int, body: bytes, percent: int) -> np.ndarray:
    value, f = unpack(body)
    value = undeltas(value)
    alone = n - len(value)  # those that no other set has come first
    return value[np.lexsort((value, f))][: max(0, n - need(n, percent) + 1 - alone)]


class Merge:
    """Members of at least `least` of the ascending lists, from the largest down, by a heap of the lists' heads.

    A list's entries are its members with the list's number in the low bits, so a heap of numbers tells both.
    """

    def __init__(self, lists: list[np.ndarray], least: int):
        self.least, self.bits = least, len(lists).bit_length()
        self.heap, self.at = [], [-1] * len(lists)
        self.lists = [x << self.bits | k for k, x in enumerate(lists)]
        self.views = [memoryview(x) for x in self.lists]  # single entries of a view are cheap
        self.begin([len(x) - 1 for x in lists])

    def begin(self, at: list[int]) -> None:
        self.at[:] = at
        self.heap[:] = [-self.views[k][i] for k, i in enumerate(at) if i >= 0]
        heapq.heapify(self.heap)

    def __iter__(self):
        heap, views, at, bits, least = self.heap, self.views, self.at, self.bits, self.least
        mask, pop, push, replace = (1 << bits) - 1, heapq.heappop, heapq.heappush, heapq.heapreplace
        while len(heap) >= least:
            top, found = -heap[0] >> bits, 0
            last = -(top << bits)
            while heap and heap[0] <= last:
                k = -heap[0] & mask
                i = at[k] = at[k] - 1
                if i >= 0:
                    replace(heap, -views[k][i])
                else:
                    pop(heap)
                found += 1
            if found >= least:
                yield top, found
            elif len(heap) >= least:  # nothing above the least-th largest head can be in `least` lists
                popped = [pop(heap) for _ in range(least - 1)]
                jump = -heap[0] | mask
                for e in popped:
                    if -e > jump:
                        k = -e & mask
                        i = at[k] = bisect.bisect_right(views[k], jump, 0, at[k] + 1) - 1
                        if i < 0:
                            continue
                        e = -views[k][i]
                    push(heap, e)

    def without(self, wanted: np.ndarray) -> None:
        """Takes the members whose place in wanted is False out of what is left of the lists."""
        for k, i in enumerate(self.at):
            x = self.lists[k][: i + 1]
            self.lists[k] = x[wanted[x >> self.bits]]
            self.views[k] = memoryview(self.lists[k])
        self.begin([len(x) - 1 for x in self.lists])


class Groups:
    """Disjoint sets of 0..k-1 by a label each; a union relabels the smaller one."""

    def __init__(self, known: list):
        _, self.label = np.unique(known, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(self.label))[:-1]) if len(order) else []

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x], self.members[y] = np.concatenate([self.members[x], self.members[y]]), None

    def is_one(self, a: int) -> bool:
        return len(self.members[self.label[a]]) == len(self.label)


def search(rows: list[dict], percent: int = PERCENT):
    """Pairs (u, v) that join a block's sets as all their links do; with two parts, all links between those.

    Sets whose `known` is the same are in one component from the start.
    """
    rows.sort(key=lambda r: (r["n"], r["cid"]))
    k = len(rows)
    sizes = np.array([r["n"] for r in rows], np.int64)
    parts = np.array([r["part"] for r in rows])
    crossing = parts.min() != parts.max()
    values = [undeltas(unpack(r["shared"])[0]) for r in rows]
    lengths = np.array([len(v) for v in values], np.int64)
    _, token = np.unique(np.concatenate(values), return_inverse=True)
    # postings: token * k + set, sorted, and an end; an inverted list is a range of it
    postings = np.append(np.sort(token * k + segment_ids(lengths)), np.iinfo(np.int64).max)
    ends = np.cumsum(lengths)
    groups = Groups([r["known"] for r in rows])
    label = groups.label
    for q in range(1, k):
        n = int(sizes[q])
        least = need(n, percent)
        start = int(np.searchsorted(sizes, least))  # smaller sets are too small
        if groups.is_one(q):
            break
        if start >= q:
            continue
        keys = token[ends[q] - lengths[q] : ends[q]] * k
        low, high = np.searchsorted(postings, keys + start), np.searchsorted(postings, keys + q)
        size = high - low
        has = size > 0
        if int(has.sum()) < least:
            continue
        keys, low, high, size = keys[has], low[has], high[has], size[has]
        order = np.argsort(size, kind="stable")
        longest = int(size[order[-1]])
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)), len(order) - 1)
        short, rest = order[: len(order) - long], order[len(order) - long :]
        wanted = label != label[q]
        if crossing:
            wanted &= parts != parts[q]
        lists = [postings[a:b] - c for a, b, c in zip(low[short].tolist(), high[short].tolist(), keys[short].tolist(), strict=True)]
        merge = Merge([x[wanted[x]] for x in lists], least - long)
        probes = np.sort(keys[rest])  # in the order of the postings
        for c, have in merge:
            asked = probes + c
            common = have + int(np.count_nonzero(postings[postings.searchsorted(asked)] == asked))
            if 100 * common >= percent * (n + int(sizes[c]) - common):
                wanted &= label != label[c]
                groups.join(c, q)
                merge.without(wanted)
    # every set by the smallest of its group: components of such stars take one round
    cids = np.array([r["cid"] for r in rows], np.int64)
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, label, cids)
    for cid, own in zip(cids.tolist(), least[label].tolist(), strict=True):
        if cid != own:
            yield {"u": own, "v": cid}


def compared(rows: list[dict], percent: int):
    """Those of the pairs (u, v) with their sets (n, a; m, b) that link."""
    for r in rows:
        a, b = undeltas(unpack(r["a"])[0]), undeltas(unpack(r["b"])[0])
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (r["n"] + r["m"] - common):
            yield {"u": r["u"], "v": r["v"]}


def large_blocks(members: DataFrame, stars: DataFrame, large: DataFrame, percent: int, block: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """Links to the smallest sets of prefix lists, and what is left to search, for the blocks in `large`."""
    own = members.join(large.select("block"), "block", "left_semi")
    left = own.select(F.col("cid").alias("u"), "n", F.col("shared").alias("a"))
    right = own.select(F.col("cid").alias("v"), F.col("n").alias("m"), F.col("shared").alias("b"))
    both = stars.select(F.col("cid").alias("u"), F.col("least").alias("v")).join(left, "u").join(right, "v")
    pairs = work.keep(mapped(both, lambda rows: compared(rows, percent), "u long, v long"))
    known = components(pairs).select(F.col("node").alias("cid"), F.col("component").alias("known"))
    rows = own.join(known, "cid", "left").withColumn("known", F.coalesce("known", "cid"))
    rows = work.keep(rows)
    sizes = rows.groupBy("block", "known").agg(F.sum("n").alias("w"))
    main = sizes.groupBy("block").agg(F.max(F.struct("w", "known")).alias("m"), F.sum("w").alias("w"))
    cuts = lambda w: F.ceil(w / F.lit(block)).cast("int")
    main = main.select("block", F.col("m.known").alias("main"), cuts(F.col("m.w")).alias("mains"), cuts(F.col("w") - F.col("m.w")).alias("others"))
    rows = rows.join(main, "block").withColumn("is_main", F.col("known") == F.col("main"))
    # parts 0..others-1 hold the others, the next ones the main component's sets
    parts = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("cid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("cid"), F.greatest("others", F.lit(1)))).cast("int")
    rows = rows.where("not is_main or others > 0").withColumn("part", parts)
    last = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return pairs, rows.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cid", "n", "part", "shared", "known")


def marks(text):
    """Two independent hashes of a text: with doc_id, they name a row and its exact repetitions."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; extra columns are ignored.

    component_id is the smallest doc_id reachable by links, itself included. Texts without words (or
    null) link with nothing: their component is their doc_id. Rows without doc_id have no component and
    don't pass links on; rows that share a doc_id are sets of their own, each in its own component.
    Empty docs: no rows.
    """
    return marked_groups(docs, words, percent, buckets, block).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def marked_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, t0 and t1 (its marks), n and first of every row of docs; first is the group's row of the
    smallest (doc_id, t0, t1), as a struct of those. A row in no group is its own first.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = Work(spark)

    def split(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hashes, at = WordHashes(), TaskContext.get().partitionId() << 24
        schema = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
        for rows in row_slices(batches, CHUNK):
            out = list(chunk_rows(rows["doc_id"], rows["text"], [rows["t0"], rows["t1"]], at, buckets, hashes, words))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            at += 1

    wire = "kind int, to long, chunk long, body binary"
    t0, t1 = marks(F.col("text"))
    sent = docs.select(F.col("doc_id").cast("long"), "text", t0.alias("t0"), t1.alias("t1")).mapInArrow(split, wire)
    answered = grouped(sent, ["kind", "to"], lambda key, rows: answer(rows) if key[0] else rows, wire, size=64)
    found = work.keep(grouped(answered, ["chunk"], lambda _, rows: documents_of(rows, percent), "doc_id long, t0 long, t1 long, n int, p0 long, p1 long, shared binary"))

    rows = found.select("doc_id", "t0", "t1", "n", "p0", "p1")
    own = F.struct("doc_id", "t0", "t1")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("p0", "p1", "n").agg(F.min(own).alias("first"))
    # a number of its own for every set: sets may share their smallest doc_id
    classes = work.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    sets = found.where("shared is not null").groupBy("p0", "p1", "n").agg(F.first("shared").alias("shared"))
    sets = work.keep(sets.join(classes, ["p0", "p1", "n"]).select("cid", "n", "shared"))

    def prefixes(rows):
        for r in rows:
            for v in prefix(r["n"], r["shared"], percent).tolist():
                yield {"token": v, "cid": r["cid"]}

    tokens = mapped(sets, prefixes, "token long, cid long", size=50_000)
    least = tokens.groupBy("token").agg(F.min("cid").alias("least"), F.count("*").alias("sets")).where("sets > 1")
    stars = work.keep(tokens.join(least, "token").where("cid <> least").select("cid", "least").distinct())
    blocks = components(stars, "cid", "least").withColumnRenamed("component", "block")

    members = work.keep(sets.join(blocks, sets.cid == blocks.node).select("block", "cid", "n", "shared"))
    work.drop(sets)
    weights = members.groupBy("block").agg(F.sum("n").alias("w")).select("block", F.ceil(F.col("w") / F.lit(block)).cast("int").alias("cuts"))
    whole = members.join(weights.where("cuts = 1"), "block").withColumn("known", F.col("cid"))
    tasks = whole.select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), "cid", "n", F.lit(0).alias("part"), "shared", "known")
    pairs = None
    large = weights.where("cuts > 1")
    if not large.isEmpty():
        pairs, cut = large_blocks(members, stars, large, percent, block, work)
        tasks = tasks.unionByName(cut)
    links = grouped(tasks, ["block", "i", "j"], lambda _, own: search(own, percent), "u long, v long")
    links = links if pairs is None else links.unionByName(pairs)
    joined = components(links)
    work.drop(members)

    joined = work.keep(joined.join(classes, joined.node == classes.cid).select("node", "component", "first"))
    firsts = joined.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(firsts, "component").select("node", "least")
    named = classes.join(joined, classes.cid == joined.node, "left").select("p0", "p1", "n", F.coalesce("least", "first").alias("first"))
    linked = rows.where("n > 0 and doc_id is not null").join(named, ["p0", "p1", "n"])
    alone = rows.where("n = 0 or doc_id is null").withColumn("first", own)
    return linked.unionByName(alone).select("doc_id", "t0", "t1", "n", "first")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the document of the smallest doc_id of each group; all columns as they were.

    Rows without doc_id stay. Rows that repeat both doc_id and text stay once. Of a group's different texts
    under its smallest doc_id one stays. What else a doc_id holds is judged by itself.
    """
    others = marked_groups(docs).where(F.struct("doc_id", "t0", "t1") != F.col("first")).where("doc_id is not null")
    others = others.select(F.col("doc_id").alias("other"), F.col("t0").alias("other0"), F.col("t1").alias("other1")).distinct()
    t0, t1 = marks(docs["text"])
    left = docs.join(others, (docs["doc_id"] == others["other"]) & (t0 == others["other0"]) & (t1 == others["other1"]), "left_anti")
    ids = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] > ids["d"]:
        known = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        left = known.unionByName(left.where("doc_id is null"))
    return left


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: The same by joining all sets on their shingles, as words.
OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS k FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(k) = 0 THEN [] WHEN len(k) < {WORDS} THEN [array_to_string(k, ' ')]
    ELSE list_transform(range(1, len(k) - {WORDS - 2}), lambda i: array_to_string(k[i:i + {WORDS - 1}], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
d AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.id WHERE r.c < d.b)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
