"""The models of language identification, toxicity and token counts against plain versions of the same rules."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dartline.llm import langid, tokencount, toxicity
from dartline.llm.common import plain_words
from tests.llm.fixtures import awkward

# language identification


def plain_words_of(text):
    out, now = [], ""
    for c in text.lower():
        if "a" <= c <= "z" or ord(c) > 127:
            now += c
        else:
            out += [now] if now else []
            now = ""
    return out + ([now] if now else [])


def plain_language(learned):
    """The scores of texts by word, else by the longest known n-grams, in dictionaries."""
    langs = sorted({lang for lang, _ in learned})
    words = {lang: Counter(w for x, t in learned if x == lang for w in plain_words_of(t)) for lang in langs}
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    def table(counts, least):
        kinds = set().union(*counts.values())
        total = {lang: sum(c.values()) + 0.5 * (len(kinds) + 1) for lang, c in counts.items()}
        out = {}
        for k in kinds:
            if sum(c[k] for c in counts.values()) >= least:
                logs = {lang: math.log((counts[lang][k] + 0.5) / total[lang]) for lang in langs}
                mean = sum(logs.values()) / len(langs)
                out[k] = {lang: x - mean for lang, x in logs.items()}
        return out

    known = table(words, langid.SEEN)
    by_length = {n: table({lang: Counter({g: sum(k for w, k in words[lang].items() for x in grams(w, n) if x == g) for g in {g for w in words[lang] for g in grams(w, n)}}) for lang in langs}, 1) for n in range(1, langid.LONGEST + 1)}

    def of_word(w):
        if w in known:
            return known[w]
        for n in range(langid.LONGEST, 0, -1):
            own = [by_length[n][g] for g in grams(w, n) if g in by_length[n]]
            if own:
                return {lang: sum(x[lang] for x in own) / len(own) for lang in langs}
        return dict.fromkeys(langs, 0.0)

    def predict(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        own = plain_words_of(text)
        sums = {lang: sum(of_word(w)[lang] for w in own) / max(len(own), 1) ** 0.5 for lang in langs}
        best = max(langs, key=lambda lang: sums[lang])
        return best, 1 / sum(math.exp(sums[lang] - sums[best]) for lang in langs)

    return predict


def test_languages_equal_plain_scores(spark):
    r = random.Random(8)
    letters = {"aa": "abcdeé", "bb": "abcxyz", "cc": "mnoabß", "dd": "qrstab"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 8)))
    pools = {lang: [word(lang) for _ in range(60)] for lang in letters}
    text = lambda lang: " ".join(r.choice(pools[lang]) if r.random() < 0.7 else word(lang) for _ in range(r.randrange(1, 25)))
    learned = [(lang, text(lang)) for lang in letters for _ in range(12)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(learned)], "doc_id long, lang string, text string")
    asked = [text(r.choice(list(letters))) for _ in range(60)] + ["", None, "12 !", "été Ünseen", "日本 語"]
    predict = plain_language(learned)
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {x.doc_id: x for x in langid.identify(rows, langid.learn(docs, fold=None)).collect()}
    for i, t in enumerate(asked):
        lang, score = predict(t)
        assert got[i].score == pytest.approx(score, abs=1e-4)
        assert got[i].lang_pred == lang or abs(score - 0.5) < 1e-3


def test_every_language_is_learned_within_the_bound(spark):
    name = lambda i: "".join(chr(97 + (i // 26**k + 7 * k) % 26) * 2 for k in range(3))
    rows = [(i, f"l{i % 300:03}", f"{name(i % 300)} and {name(i % 300)}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs, fold=None)
    assert len(model.value["langs"]) == 300
    got = langid.identify(docs.where("doc_id < 300"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)
    tight = langid.learn(docs, fold=None, sample_bytes=300 * 30)  # two texts of each
    assert len(tight.value["langs"]) == 300 and len(langid.learn(docs, fold=None, sample_bytes=1).value["langs"]) == 300


# toxicity


def plain_features(text, p, lower):
    words = plain_words(text)
    out = []
    for f in (lambda k, h, w: p(k, h, w), lambda k, h, w: lower(k, w)):
        r = [math.log(f(1, h, w)) - math.log(f(0, h, w)) for h, w in zip([None, *words], words)]
        out.append(sum(r) / max(len(r), 1))
        out += [max((sum(r[i : i + n]) / n for i in range(len(r))), default=0.0) for n in toxicity.PASSAGES]
    return [*out, math.log1p(len(words)) / 5, 1.0]


def toxic_rows(n=60):
    r = random.Random(5)
    ordinary, toxic = [f"plain{i}" for i in range(40)], [f"bad{i}" for i in range(12)]
    rows = []
    for i in range(n):
        words = [r.choice(ordinary) for _ in range(r.randrange(1, 30))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = [r.choice(toxic) for _ in range(r.randrange(1, 6))]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_equals_plain_scores(spark):
    """Models, passages, folds and the curve worked out a word at a time."""
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"))).collect()}
    inorder = sorted(rows, key=lambda x: (order[x[0]], x[1]))
    place, rank = Counter(), []
    for _, _, k in inorder:
        rank.append(place[k] % toxicity.FOLDS)
        place[k] += 1
    x = []
    for own, (_, text, _) in zip(rank, inorder):
        # words that only the part left out has are known to no class, but counted as kinds of words
        rest = [(t, k) for f, (_, t, k) in zip(rank, inorder) if f != own]
        everything = {w for _, t, _ in inorder for w in plain_words(t)}
        x.append((text, rest, everything))
    y = np.array([k for _, _, k in inorder], float)

    def features(text, rest, everything):
        # all kinds of words of the sample share the rest, whichever part is left out
        bi = {k: Counter() for k in (0, 1)}
        for t, k in rest:
            w = plain_words(t)
            bi[k].update(zip([None, *w], w))
        cont = {k: Counter(w for _, w in bi[k]) for k in (0, 1)}
        types = Counter(w for k in (0, 1) for w in cont[k])
        bottom, d = sum(types.values()) + 0.5 * (len(everything) + 2), toxicity.DISCOUNT
        lower = lambda k, w: max(cont[k][w] - d, 0) / sum(cont[k].values()) + d * len(cont[k]) / sum(cont[k].values()) * (types[w] + 0.5) / bottom
        follow = {k: defaultdict(list) for k in (0, 1)}
        for k in (0, 1):
            for (h, _), c in bi[k].items():
                follow[k][h].append(c)

        def p(k, h, w):
            own = follow[k].get(h)
            return lower(k, w) if not own else max(bi[k][h, w] - d, 0) / sum(own) + d * len(own) / sum(own) * lower(k, w)

        return plain_features(text, p, lower)

    held = np.array([features(*a) for a in x])
    scale = np.where(held.std(0) > 0, held.std(0), 1)
    beta = toxicity.logistic(held / scale, y, np.ones(len(y))) / scale
    everything = x[0][2]
    want = {}
    for i, text, _ in [*rows, (900, "bad1 unseen plain3", 0), (901, "", 0)]:
        f = np.array(features(text, [(t, k) for _, t, k in inorder], everything))
        want[i] = 1 / (1 + math.exp(-f @ beta))
    asked = docs.unionByName(spark.createDataFrame([(900, "bad1 unseen plain3"), (901, "")], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in toxicity.score(asked, toxicity.learn(docs, labels, fold=None)).collect()}
    assert got == pytest.approx(want, abs=2e-3)


def test_curve_is_the_best_one():
    """The logistic curve against steps down the slope."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(80, 2)), np.ones((80, 1))], 1)
    y = (r.random(80) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.3]))).astype(float)
    weight = r.random(80) + 0.5
    beta = np.zeros(3)
    for _ in range(20_000):
        beta += 0.01 * (x.T @ (weight * (y - 1 / (1 + np.exp(-x @ beta)))) - 0.3 * beta)
    assert toxicity.logistic(x, y, weight) == pytest.approx(beta, abs=1e-5)


def test_sample_is_bounded_in_bytes(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t + " filler" * 100) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    sizes = [len(toxicity.learn(docs, labels, fold=None, sample_bytes=b).value) for b in (1, 3000, 1 << 26)]
    assert sizes[0] < sizes[1] < sizes[2]


# token counts


def test_long_texts_and_flushes_equal_brute_force(spark, monkeypatch):
    pieces = tokencount.load_pieces()
    scores = tokencount.piece_scores(pieces)
    byte = tokencount.Counter(scores).byte
    longest = max(map(len, scores))

    def best(word):
        out = [(0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(out[end - 1][0] + n * byte, out[end - 1][1] - n)]
            options += [(out[k][0] + scores[word[k:end]], out[k][1] - 1) for k in range(max(0, end - longest), end) if word[k:end] in scores]
            out.append(max(options))
        return -out[-1][1]

    docs, known = awkward(spark), {}
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").split()), sum(known.setdefault(w, best("▁" + w)) if w not in known else known[w] for w in (r["text"] or "").split())) for r in docs.collect())
    for held in (tokencount.HELD, 100):
        monkeypatch.setattr(tokencount, "HELD", held)
        assert sorted((repr(r.doc_id), r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(docs, pieces).collect()) == want
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert tokencount.count_tokens(one, [], {"▁": -1, "a": -1, "b": -1}).first().n_tokens == 3
