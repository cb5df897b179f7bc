import random

import numpy as np
import pytest

from dartline.llm import jaccard
from dartline.llm.common import words_of
from dartline.operators import connectivity
from tests.llm.fixtures import awkward, empty


def brute(rows):
    """(doc_id, n_shingles, component_id) by all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    kinds = sorted(least, key=least.get)
    parent = {s: s for s in kinds}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for x, a in enumerate(kinds):
        for b in kinds[:x]:
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common):
                p, q = sorted((root(a), root(b)), key=least.get)
                parent[q] = p
    return [(i, len(s), least[root(s)] if s and i is not None else i) for (i, _), s in zip(rows, sets)]


def check(docs, **options):
    got = sorted(map(tuple, jaccard.near_groups(docs, **options).collect()), key=repr)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    return got


def test_awkward_rows_equal_brute_force(spark):
    check(awkward(spark))


def test_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert any(r[0] != r[2] for r in check(docs))


def near_copies(n, seed=7):
    """A chain of edits, copies with a few words changed, and texts around a common passage."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(120)]
    rows, now = [], base
    for i in range(n):
        now = list(now)
        now[r.randrange(len(now))] = word()
        own = list(base)
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = word()
        rows += [(3 * i, " ".join(now)), (3 * i + 1, " ".join(own)), (3 * i + 2, " ".join([word() for _ in range(r.randrange(60))] + base[:60]))]
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2000, 300])
def test_large_groups_equal_brute_force(spark, block):
    check(spark.createDataFrame(near_copies(40), "doc_id long, text string").repartition(3), block=block)


def test_large_groups_by_rounds_of_components(spark, monkeypatch):
    monkeypatch.setattr(connectivity, "LOCAL_EDGES", 0)
    check(spark.createDataFrame(near_copies(20), "doc_id long, text string").repartition(3), block=300)


def test_empty_table(spark):
    assert jaccard.near_groups(empty(spark)).collect() == []


def test_merge_of_lists():
    r = np.random.default_rng(1)
    for _ in range(400):
        lists = [np.unique(r.integers(0, 40, r.integers(1, 20))) for _ in range(r.integers(1, 8))]
        least = int(r.integers(1, len(lists) + 1))
        every = np.concatenate(lists)
        want = [(v, int((every == v).sum())) for v in sorted(set(every.tolist()), reverse=True)]
        want = [(v, c) for v, c in want if c >= least]
        assert list(jaccard.Merge(list(lists), least)) == want
        # with every third member found, those of its remainder by 4 leave
        merge, got, gone, left = jaccard.Merge(list(lists), least), [], set(), []
        for v, c in merge:
            got.append((v, c))
            if v % 3 == 0:
                gone.add(v % 4)
                merge.without(np.array([x % 4 not in gone for x in range(40)]))
        gone = set()
        for v, c in want:
            if v % 4 not in gone:
                left.append((v, c))
                if v % 3 == 0:
                    gone.add(v % 4)
        assert got == left


def test_groups():
    g = jaccard.Groups([7, 3, 7, 9, 3])
    g.join(1, 3)
    assert g.label[1] == g.label[4] == g.label[3] != g.label[0] == g.label[2] and not g.is_one(0)
    g.join(0, 4)
    assert len(set(g.label.tolist())) == 1 and g.is_one(2)


def test_one_of_each(spark):
    docs = awkward(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(repr(r["doc_id"]) for r in kept.collect())
    # 1, 2: one text (1 came twice); 6, 7: one text; 9, 10: one text; 8 has no group with the row without id
    assert ids == sorted(map(repr, [1, 3, 4, 5, 6, None, 8, 9, 11, -12]))


def test_one_of_each_where_texts_share_a_doc_id(spark):
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    near = lambda words: " ".join([*words[:-1], "other"])
    x, nx, y, ny = " ".join(x), near(x), " ".join(y), near(y)
    unrelated = [" ".join(f"u{k}v{i}" for i in range(20)) for k in range(3)]
    rows = [(5, x), (7, x), (5, y), (2, y)]
    kept = lambda rows: sorted(map(tuple, jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept(rows) == sorted([(5, x), (2, y)])
    assert kept([*rows, *((7, t) for t in unrelated), (9, ny)]) == sorted([(5, x), (2, y), *((7, t) for t in unrelated)])
    # two texts of one doc_id that are near, or one set; rows without words
    assert len(kept([(5, x), (5, nx), (8, nx)])) == 1 and len(kept([(5, x), (5, x.upper()), (6, x)])) == 1
    assert kept([(5, x), (5, ""), (6, ""), (4, x)]) == [(4, x), (5, ""), (6, "")]
    # sets that share their smallest doc_id don't pass on each other's links
    docs = spark.createDataFrame([(5, x), (5, y), (6, nx), (3, ny), (8, unrelated[0]), (5, unrelated[0])], "doc_id long, text string")
    assert {(r[0], r[2]) for r in check(docs) if r[0] != 5} == {(6, 5), (3, 3), (8, 5)}
