"""Language identification, media columns, token counts, decontamination, license scans, toxicity, pipeline."""

import hashlib
import io
import itertools
import random
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dartline.llm import decontaminate, jaccard, langid, licenses, media, mixing, sharding, tokencount, toxicity
from dartline.llm.common import WordHashes, hash_texts, plain_words
from tests.llm.fixtures import awkward, empty


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# language identification


def test_language_of_held_out_documents(spark, sf):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = langid.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = langid.identify(docs, langid.learn(docs, fold=None)).collect()
    assert len(rows) == docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {3, 4, 5, 11} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "und"}
    assert langid.identify(empty(spark), langid.learn(docs, fold=None)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty(spark))).collect()} == {"und"}


def test_known_words_come_before_grams():
    model = langid.fit({"x": langid.count_words(["abc abc abd"]), "y": langid.count_words(["zzz zzz zzy"])})
    scorer = langid.Scorer(model)
    assert b"abc" in scorer.known and b"abd" not in scorer.known  # seen once only
    assert scorer(["abc", "zzzz", "abzzzz"])[0] == ["x", "y", "y"]
    index, table = scorer.grams[4]
    assert np.allclose(scorer.vector(b"abc"), table[[index["<abc>"]]].mean(0))
    assert not scorer.vector("ß".encode()).any() or scorer.vector("ß".encode()).shape == (2,)


# media columns


def plain_feature(x):
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
    return f"mean={sum(x) // len(x)};peak={max(x)};crossings={crossings}"


@pytest.mark.parametrize("size", [50_000, media.SHARD])
def test_media_columns_of_awkward_rows(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(media, "SLICE", 10_000)
    docs, folder = awkward(spark).withColumn("digest", F.lit("x")), f"{tmp_path}/shards"
    packed = media.pack_shards(docs.repartition(3), folder, size=size)
    places = media.catalog(packed)
    rows = media.media_rows(packed, media.read_media(places, folder)).collect()
    want = Counter()
    for d in docs.collect():
        body = (d["text"] or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        want[d["doc_id"], len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), plain_feature(payload)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows) == want
    # a digest has one place over all shards; shards are tar files, and the places point into them
    where = {(r.digest, r.shard, r.offset, r.length): r.media_sha256 for r in rows}
    assert len(where) == len({r.digest for r in rows}) and len({r.shard for r in rows}) > 1
    for (digest, shard, offset, length), sha in where.items():
        body = open(f"{folder}/{shard}", "rb").read()
        with tarfile.open(fileobj=io.BytesIO(body)) as f:
            assert (f"{digest}.png", offset, length) in {(m.name, m.offset_data, m.size) for m in f.getmembers()}
        own = body[offset : offset + length]
        assert hashlib.sha256(own).hexdigest() == sha and hashlib.sha256(media.read_samples(own)).hexdigest() == digest
    for r in rows:
        assert r.digest == r.payload_sha256 and r.samples == r.payload_bytes == r.width * r.height and (r.width, r.bits) == (64, 8) and r.media_bytes == r.length
    assert {(r.digest.hex(), r.height) for r in media.read_metadata(places, folder).collect()} == {(r.digest, r.height) for r in rows}
    none = media.pack_shards(empty(spark), folder)
    assert media.media_rows(none, media.read_media(media.catalog(none), folder)).collect() == []


def test_metadata_needs_the_header_only(spark, tmp_path):
    """With all bytes but the headers overwritten, the metadata columns are the same; the payload is not read."""
    folder = f"{tmp_path}/shards"
    places = media.catalog(media.pack_shards(awkward(spark).coalesce(1), folder))
    want = sorted(map(tuple, media.read_metadata(places, folder).collect()))
    for p in places.collect():
        with open(f"{folder}/{p.shard}", "r+b") as f:
            f.seek(p.offset + media.HEAD)
            f.write(bytes(p.length - media.HEAD))
    assert sorted(map(tuple, media.read_metadata(places, folder).collect())) == want
    with pytest.raises(Exception, match="damaged"):
        media.read_media(places, folder).collect()


def test_pictures_are_read_back():
    for n in (64, 128, 6400):
        samples = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert media.read_samples(media.png(samples)) == samples
    with pytest.raises(ValueError):
        media.read_header(b"x" * media.HEAD)


def test_media_query(spark, sf):
    rows = media.op3_media_columns(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in documents(spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in rows:
        payload = docs[r.doc_id] + bytes(-len(docs[r.doc_id]) % 64 or (0 if docs[r.doc_id] else 64))
        assert (r.n_bytes, r.payload_sha256, r.feature) == (len(docs[r.doc_id]), hashlib.sha256(payload).hexdigest(), plain_feature(payload))


# token counts


def best_count(word, scores, byte):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(end) if word[k:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_equal_brute_force(spark, sf):
    pieces = tokencount.load_pieces()
    scores = tokencount.piece_scores(pieces)
    byte = tokencount.Counter(scores).byte
    for docs in (awkward(spark).where("doc_id <> 6 and doc_id <> 7 or doc_id is null"), documents(spark, sf).where("doc_id < 60")):
        rows = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_pretokens) for r in tokencount.count_tokens(docs, pieces).collect()), key=repr)
        want = []
        for r in docs.collect():
            words = (r["text"] or "").split()
            want.append((r["doc_id"] is None, r["doc_id"], sum(best_count("▁" + w, scores, byte) for w in words), len(words)))
        assert rows == sorted(want, key=repr)
    assert tokencount.count_tokens(empty(spark), pieces).collect() == []


def test_small_vocabulary_and_flushes(monkeypatch, spark):
    monkeypatch.setattr(tokencount, "GATHERED", 1)
    pieces = ["▁", "a", "b", "ab", "▁ab", "abab"]
    docs = spark.createDataFrame([(i, "abab ab ba é" * i) for i in range(5)], "doc_id long, text string")
    scores = tokencount.piece_scores(pieces)
    byte = tokencount.Counter(scores).byte
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, pieces).collect()}
    assert got == {i: sum(best_count("▁" + w, scores, byte) for w in ("abab ab ba é" * i).split()) for i in range(5)}


# decontamination


@pytest.mark.parametrize("width, most", [(decontaminate.WINDOW, 2), (20, 4)])
def test_masks_find_every_pattern_of_substitutions(width, most):
    assert most == width - int(np.ceil(decontaminate.SHARE * width))
    for changed in itertools.combinations(range(width), most):
        same = [i not in changed for i in range(width)]
        assert any(all(same[s + i] for i, one in enumerate(m) if one == "1") for m in decontaminate.MASKS for s in range(width - len(m) + 1))


def contaminated(text, items, window=decontaminate.WINDOW, share=decontaminate.SHARE):
    words, found = plain_words(text.lower()) if text else [], set()
    for i, t in items:
        item = plain_words(t.lower())
        k = min(window, len(item))
        if not item:
            continue
        for at in range(-len(item), len(words)):
            equal = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(item)]
            if any(sum(equal[s : s + k]) >= share * k for s in range(len(item) - k + 1)):
                found.add(i)
                break
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(2, 45)))) for i in range(12)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(r.randrange(0, 60))]
        if i % 2:
            own = items[r.randrange(len(items))][1].split()
            own = own[r.randrange(3) :]
            for _ in range(r.randrange(9)):
                own[r.randrange(len(own))] = word()
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in own]
        docs.append((i, " ".join(words)))
    bench = spark.createDataFrame([*items, (None, "a b c d e f g h"), (90, None), (91, "")], "item_id long, text string")
    table = spark.createDataFrame([*docs, (None, items[5][1]), (500, None), (501, "")], "doc_id long, text string")
    for at_once in (10**6, 60):
        got = {(r["doc_id"], r["text"]): {h["item_id"] for h in r["hits"]} for r in decontaminate.find_hits(table, bench, item_words_at_once=at_once).collect()}
        for (doc_id, text), found in got.items():
            want = contaminated(text, items)
            assert found == want
        assert sum(map(bool, got.values())) > 20


def test_short_items_are_found_with_every_pattern_of_substitutions(spark):
    items, docs, want = [], [], {}
    for n in range(1, decontaminate.WINDOW):
        own = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(own)))
        allowed = n - int(np.ceil(decontaminate.SHARE * n))
        for k in range(allowed + 2):  # one more than allowed is no hit
            for changed in itertools.combinations(range(n), k):
                words = [f"x{j}" if j in changed else w for j, w in enumerate(own)]
                for text in (words, ["before", *words, "after"]):
                    want[len(docs)] = [n] if k <= allowed else []
                    docs.append((len(docs), " ".join(text)))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontaminate.find_hits(table, bench).collect()}
    assert got == want


def test_short_items_equal_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "COMPARED", 7)
    r = random.Random(4)
    word = lambda: f"w{r.randrange(6)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 13)))) for i in range(25)]
    texts = [" ".join(word() for _ in range(r.randrange(25))) for _ in range(60)]
    flat, lengths = hash_texts(texts, WordHashes(), decontaminate.item_words)
    hits = decontaminate.Items(items).hits(flat, lengths)
    assert [{h["item_id"] for h in hits.get(d, [])} for d in range(len(texts))] == [contaminated(t, items) for t in texts]


def test_query_of_items_equals_brute_force(spark, sf):
    """n_items, items and contaminated against all items at all places."""
    docs, items = documents(spark, sf), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in decontaminate.op8_decontamination(spark, sf).collect()}
    texts = docs.select("doc_id", "text").collect()
    # items that share no run of two words, or no word if short, can't stand in a text
    grams = lambda words: set(zip(words, words[1:])) if len(words) > 1 else set(words)
    own = [(i, t, grams(plain_words(t.lower()))) for i, t in items]
    assert len(rows) == len(texts)
    for d in texts:
        held = grams(plain_words(d["text"].lower())) if d["text"] else set()
        want = contaminated(d["text"], [(i, t) for i, t, g in own if g & held])
        r = rows[d["doc_id"]]
        assert (r["items"], r["n_items"], r["contaminated"]) == (sorted(want), len(want), bool(want))
    assert any(r["contaminated"] for r in rows.values())


def test_long_items_are_searched_in_pieces(spark):
    own = [f"v{i}" for i in range(100)]
    bench = spark.createDataFrame([(1, " ".join(own)), (2, "v3")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["x", *own[i : i + 13], "y"])) for i in range(88)] + [(99, " ".join(own[5:15])), (100, "v4 v3")], "doc_id long, text string")
    for at_once in (10**6, 20, 13):
        got = {r["doc_id"]: r["hits"] for r in decontaminate.find_hits(docs, bench, item_words_at_once=at_once).collect()}
        for i in range(88):
            hits = [h for h in got[i] if h["item_id"] == 1]
            assert hits and all(h["doc_word"] - 1 == h["item_word"] - i for h in hits) and max(h["equal"] for h in hits) == 13
        assert got[99] == [] and [h["item_id"] for h in got[100]] == [2]


def test_items_without_id_are_searched(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h"), (None, " ".join(f"v{i}" for i in range(20))), (1, "p q r")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "x a b c d e f g h y"), (1, " ".join(f"v{i}" for i in range(20))), (2, "p q r"), (3, "a b p")], "doc_id long, text string")
    for at_once in (10**6, 4):
        got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontaminate.find_hits(docs, bench, item_words_at_once=at_once).collect()}
        assert got == {0: [None], 1: [None], 2: [1], 3: []}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_clean_keeps_columns_and_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (1, None)], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.schema == docs.schema or out.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted(repr(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in (1, 2))
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.clean(empty(spark), bench).collect() == []


# license scans


def test_license_scan_base_columns(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = documents(spark, sf).select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(9001, "MIT\nlicense mit license, GNU general-public  LICENSE apache. License"), (9002, "mitlicense")], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        words = word.findall((r["text"] or "").translate({i: i + 32 for i in range(65, 91)}))
        places, labels = [], set()
        for p, label in licenses.PHRASES:
            p = p.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        want.append((r["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(empty(spark)).collect() == []


def test_license_blocks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.plain(t).split()})
    rows = []
    for i in range(300):
        label, text = r.choice(licenses.TEMPLATES)
        words = [w for w in licenses.plain(text).split() if r.random() < 0.87] + [r.choice(vocabulary) for _ in range(r.randrange(4))]
        words += [b"filler%d" % r.randrange(9) for _ in range(r.choice([0, 0, 100]))]
        r.shuffle(words)
        rows.append((i, b" ".join(words).decode()))
    got = {x.doc_id: x.labels for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        held = [set(b) for line in licenses.plain(text).split(b"\n") for b in licenses.blocks(line.split())]
        words = licenses.plain(text).decode().split()
        want = {label for p, label in licenses.PHRASES if f" {p} " in f" {' '.join(words)} "}
        for label, t in licenses.TEMPLATES:
            own = set(licenses.plain(t).split())
            if any(len(own & b) >= licenses.THRESHOLD * len(own) - 1e-9 for b in held):
                want.add(label)
        assert got[i] == ",".join(sorted(want))


@pytest.mark.parametrize("width", [20, 50, 75])
def test_wrapped_notices_are_found(spark, width):
    import textwrap

    long = " ".join(f"clause{i}" for i in range(150))  # more distinct words than a line's block holds
    given = (*licenses.TEMPLATES, ("long", long))
    rows = []
    for i, (_, text) in enumerate(given):
        wrapped = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
        rows += [(3 * i, "\n".join(wrapped)), (3 * i + 1, "Some code\n\n" + "\n".join(f" * {x}" for x in wrapped) + "\n\nmore code"), (3 * i + 2, text)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), given).collect()}
    for i, text in rows:
        label, template = given[i // 3]
        r, n = got[i], len(licenses.plain(template).split())
        assert label in r.labels.split(",") and r.score == 1 and r.n_words == len(licenses.plain(text).split())
        first = 2 if i % 3 == 1 else 0
        assert any(s.label == label and s.containment == 1 and s.first_word <= first and s.last_word >= first + n - 1 for s in r.spans)
    scattered = spark.createDataFrame([(0, " filler\n".join(licenses.TEMPLATES[10][1].split() * 2))], "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(scattered).collect()] == [""]


# toxicity


def test_two_models_are_distributions():
    r = np.random.default_rng(2)
    flat = r.integers(1, 12, 400).astype(np.uint64)
    lengths = np.full(8, 50)
    before, pair = toxicity.pairs(flat, lengths)
    bigrams, first, ids = np.unique(pair, return_index=True, return_inverse=True)
    words = np.unique(np.concatenate([flat, [toxicity.START]]))
    place = np.searchsorted(words, before[first]), np.searchsorted(words, flat[first])
    half = np.repeat(np.arange(8) % 2, 50)
    m = toxicity.TwoModels(words, bigrams, *place, [np.bincount(ids[half == k], minlength=len(bigrams)) for k in (0, 1)])
    for k in (0, 1):
        assert m.lower[k].sum() + m.unseen[k] == pytest.approx(1, abs=1e-5)  # one class of unseen words
        for b in range(len(words)):
            own = place[0] == b
            assert m.held[k][own].sum() + m.rest[k][b] * (m.lower[k].sum() + m.unseen[k]) == pytest.approx(1, abs=1e-5)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught / sum(r.toxic for r in rows) > 0.85 and caught / sum(r.predicted for r in rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (6, 1, None), (None, 1, 1), (8, 1, 0), (9, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(docs, labels, fold=None)
    rows = toxicity.score(docs, scorer).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for given in (labels.limit(0), labels.where("toxic = 1")):
        assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, given, fold=None)).collect()} <= {0.0, 1.0}
    assert toxicity.score(empty(spark), scorer).collect() == []
    out = toxicity.reject(docs, labels)
    assert out.columns == docs.columns and out.count() <= docs.count()


# the pipeline


def test_pipeline_equals_its_parts(spark, sf):
    """run() against plain Python over the same decisions: scores, components, hits, copies, shards."""
    from tests.llm.test_jaccard import brute as groups
    from tests.llm.test_sharding import brute as shard

    docs = documents(spark, sf)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    kept = {r["doc_id"]: r for r in docs.collect() if scores[r["doc_id"]] < toxicity.THRESHOLD}
    kept = {i: kept[i] for i, _, c in groups([(i, r["text"]) for i, r in kept.items()]) if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not contaminated(r["text"], items)}
    copies = {r["doc_id"]: r["count"] for r in mixing.mixed(spark.createDataFrame(list(kept.values()), docs.schema)).groupBy("doc_id").count().collect()}
    want = sorted((i, shard(i, [1.0] * 8)) for i, n in copies.items() for _ in range(n))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.shard) for r in rows) == want and len(want) > 50
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_stages_handle_awkward_and_empty_tables(spark, sf):
    for first in (awkward(spark), empty(spark)):
        docs = first
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len(rows) == docs.count()


# SQL


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op6_mixing", "op9_license_scan"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from dartline.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, sf)
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = c.sql(ORACLE_SQL[name])
        columns = want.columns
        want = want.fetchall()
    assert sorted(columns) == sorted(got.columns) and len(want) > 100
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
