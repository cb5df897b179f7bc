import functools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dartline.llm import katz
from dartline.llm.common import unpack, words_of
from tests.llm.fixtures import awkward, empty


def brute(rows, order):
    """The model and the scores in plain dictionaries, by recursion."""
    texts = [["<", *(t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split(), None] for _, t in rows]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    follow = [{} for _ in range(order)]  # by context length: context -> followers
    for t, own in zip(texts, learn):
        if own:
            for i in range(1, len(t)):
                for k in range(min(order, i + 1)):
                    follow[k].setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
    for k in range(2, order):
        follow[k] = {h: c for h, c in follow[k].items() if sum(c.values()) >= katz.LEAST}
    uni = follow[0].get((), Counter())

    def d_of(counters):
        n = Counter(c for own in counters for c in own.values())
        cut = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    discount, known = [d_of(f.values()) for f in follow], {}

    def state(h):
        """What is left of a context's mass, and D."""
        d, own = discount[len(h)], follow[len(h)].get(h, {})
        c = sum(own.values())
        free = sum((1 - d[r]) * r for r in own.values() if r <= 5)
        return (free, c) if free else (1, c + 1)

    @functools.cache
    def weight(h):
        free, c = state(h)
        return free / c / (1 - sum(p(x, h[1:]) for x in follow[len(h)][h]))

    divisor = functools.cache(lambda h: state(h)[1])

    def p(w, h):
        if (w, h) in known:
            return known[w, h]
        own = follow[len(h)].get(h)
        if not h:
            out = discount[0].get(uni[w], 1) * uni[w] / divisor(h) if uni[w] else unknown
        elif not own:
            out = p(w, h[1:])
        elif own[w]:
            out = discount[len(h)].get(own[w], 1) * own[w] / divisor(h)
        else:
            out = weight(h) * p(w, h[1:])
        known[w, h] = out
        return out

    unknown = state(())[0] / state(())[1]
    out, total = [], sum(uni.values())
    for (i, _), t, own in zip(rows, texts, learn):
        s = sum(math.log10(p(t[j], tuple(t[max(0, j - order + 1) : j]))) for j in range(1, len(t)))
        b = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in t[1:])
        out.append((i, i is not None and not own, len(t) - 1, sum(uni[w] > 0 for w in t[1:]), total, b, s))
    words = [*uni, "unseen"]
    for f in follow[1:]:
        for h in [*list(f)[:12], *list(f)[-3:]]:
            assert math.isclose(sum(p(w, h) for w in words), 1, rel_tol=1e-9)
    return out


def check(docs, order=katz.ORDER, **options):
    got = sorted(map(tuple, katz.score_texts(docs, order=order, **options).collect()), key=repr)
    want = sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], order), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_awkward_rows_equal_brute_force(spark, order):
    check(awkward(spark), order)


@pytest.mark.parametrize("order", [2, 3])
def test_documents_equal_brute_force(spark, sf, monkeypatch, order):
    monkeypatch.setattr(katz, "CHUNK", 20_000)  # many chunks
    check(spark.read.parquet(f"{sf}/documents.parquet"), order, buckets=40)


def test_empty_table(spark):
    assert katz.score_texts(empty(spark)).collect() == []


def test_nothing_learned(spark):
    held = next(i for i in range(100) if not katz.trains(i))
    rows = katz.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(True, 3, 0, 0, 0.0)]


def test_contexts_seen_once_are_part_of_the_model(spark):
    learned, held = [i for i in range(100) if katz.trains(i)], next(i for i in range(100) if not katz.trains(i))
    # "b c" is followed by "d" once, "x c" by "e" thrice: the pair "c" alone speaks for "e"
    rows = [(learned[0], "b c d"), *[(i, "x c e") for i in learned[1:4]], (held, "b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    katz_score = {r.doc_id: r.score for r in katz.score_texts(docs, order=3).collect()}
    pairs = {r.doc_id: r.score for r in katz.score_texts(docs, order=2).collect()}
    assert katz_score[held] > pairs[held]
    check(docs, 3)


@pytest.mark.parametrize("parts", [1, 3])
def test_passes_ask_everything(spark, monkeypatch, parts):
    monkeypatch.setattr(katz, "PASSES", parts)
    check(awkward(spark), 4, buckets=5)


@pytest.mark.parametrize("parts", [1, 2])
def test_spread_contexts_of_any_length(spark, monkeypatch, parts):
    monkeypatch.setattr(katz, "PASSES", parts)
    texts = ["a b " * 9, "a b " * 5 + "c", "b a b d", "a b c", " ", None, "A B\tA\u00a0B \x1c a"]
    check(spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string"), 4, buckets=7)


def test_only_distinct_words_are_hashed(monkeypatch):
    import xxhash

    texts, made = [None, "", " \t", "A b\x0ba ", "\x1cb\x85 b\u2003b\r\n\x0c\u00c4 \u00e4 a\x00", "b", None], []
    real = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda word: made.append(bytes(word)) or real(word))
    hashes, token, lengths = katz.token_hashes(pa.array(["cut off", *texts], pa.string())[1:])
    words = [words_of(t) for t in texts]
    assert sorted(made) == sorted({w for own in words for w in own})
    assert lengths.tolist() == [len(own) + 1 for own in words]
    assert hashes[token].tolist() == [h for own in words for h in [*map(real, own), int(katz.END)]]
    hashes, token, lengths = katz.token_hashes(pa.array([], pa.string()))
    assert token.tolist() == lengths.tolist() == []


def test_questions_ask_without_probabilities(monkeypatch):
    """Tokens' probabilities and contexts' weights are worked out once, for the scores, not for each round of questions."""
    ids = [i for i in range(40) if katz.trains(i)][:3]
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": ["a b c", "a b d", "e b c a"]})
    rows, asked, buckets = [], {}, 3
    for r in katz.chunk_rows(batch, 0, buckets):
        rows += [r] if r["kind"] == katz.TEXTS else []
        asked |= {r["to"]: [r]} if r["kind"] == katz.CELLS else {}
    answers = [r for b in asked for r in katz.answer_words(b, asked[b], buckets)]
    n = sum(unpack(r["body"])[0] for r in answers if r["kind"] == katz.SUMS)
    words = katz.Words(n[: katz.LARGE + 1], int(n[-2]))
    rows += [r for r in answers if r["kind"] == katz.CELLS]
    answers = [r for q in katz.ngram_questions(rows, buckets, words, []) for r in katz.answer_ngrams(q["to"], [q], words.d)]
    parts = [unpack(r["body"]) for r in answers if r["kind"] == katz.PARTS]
    ids_of = np.unique(np.concatenate([p[0] for p in parts]))
    sums = [sum(np.bincount(np.searchsorted(ids_of, p[0]), weights=p[k], minlength=len(ids_of)) for p in parts) for k in range(1, len(parts[0]))]
    level = katz.Level(words.d, [ids_of, *sums])
    rows += [r | {"kind": katz.ANSWERS + 2} for r in answers if r["kind"] == katz.CELLS]

    def fail(*_):
        raise AssertionError("not needed to ask")

    monkeypatch.setattr(katz, "context_weights", fail)
    monkeypatch.setattr(katz.Words, "__call__", fail)
    assert list(katz.ngram_questions(rows, buckets, words, [level]))
    with pytest.raises(AssertionError, match="not needed"):
        list(katz.score_chunk(rows, buckets, words, 5, [level]))
