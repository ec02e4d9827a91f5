"""Components of near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from docsift.llm import dedup
from docsift.llm.graph import components
from docsift.llm.triejoin import links_within

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = BLANK.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words += passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, "one two"), (504, "ONE  two"), (505, "one two three")]


@pytest.mark.parametrize(("seed", "block"), [(1, 4_000_000), (2, 300)])
def test_components_equal_all_pairs(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, block).collect()}
    assert got == brute(rows)


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.choice(500, 60, replace=False)
        sets = []
        for i in range(40):
            own = np.unique(np.concatenate((rng.choice(base, rng.integers(35, 60), replace=False), rng.choice(500, rng.integers(0, 12)))))
            sets.append((i, len(own), own.astype(np.uint64), np.ones(len(own), np.uint32)))
        parent = list(range(40))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        want = list(range(40))
        for a, b in links_within(sets):
            x, y = sets[a][2], sets[b][2]
            assert 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
            parent[max(find(a), find(b))] = min(find(a), find(b))
        got = [find(i) for i in range(40)]
        parent[:] = want
        for a in range(40):
            for b in range(a):
                if 100 * len(np.intersect1d(sets[a][2], sets[b][2])) >= 75 * len(np.union1d(sets[a][2], sets[b][2])):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
        assert got == [find(i) for i in range(40)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (3, 4)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (None, "a b c d e f", "z"), (9, "q r s", "z"), (None, None, None)], "doc_id long, text string, sig string")
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in dedup.near_duplicates(docs).collect())
    assert rows == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (9, 9)]
    kept = sorted((r.doc_id or -1, r.sig or "") for r in dedup.keep_one(docs).collect())
    assert [k for k, _ in kept if k > 0] == [1, 9]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(empty).count() == 0
    assert dedup.keep_one(empty).count() == 0


def test_keep_one_knows_rows_by_id_and_class(spark):
    copy, other, third = "a b c d e f g h", "q r s t u v w x", "k l m n o p"
    rows = [(1, copy, 0), (5, copy, 1), (5, other, 2), (7, "one two three", 3), (7, third, 4), (7, third, 5), (None, other, 6), (None, "lone text", 7), (8, "", 8), (8, None, 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = {r.root for r in kept.collect()}
    assert got - {4, 5} == {0, 2, 3, 7, 8, 9, 10} and len(got & {4, 5}) == 1


def test_keep_one_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", i) for i in range(4)] + [(None, "x y z", 9)], "doc_id long, text string, n long")
    got = sorted(r.n for r in dedup.keep_one(docs).collect())
    assert len(got) == 2 and 9 in got


def thue_morse(length):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(length))


def test_words_that_cancel_in_polynomials_stay_apart(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"x {one} y"), (4, f"x {two} y"), (5, one.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near = words[:30_000] + ["new"] + words[30_001:]
    docs = spark.createDataFrame([(3, " ".join(words), "r", 1), (4, " ".join(near), "s", 2), (9, "w" * 300_000, None, 3)], "doc_id long, text string, root string, n long")
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()} == {3: 3, 4: 3, 9: 9}
    assert sorted((r.doc_id, r.root) for r in dedup.keep_one(docs).collect()) == [(3, "r"), (9, None)]


def test_a_hub_is_split(spark, monkeypatch):
    from docsift.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    links = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(500 + i, 399 - i) for i in range(50)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in [*range(400), *range(500, 550)]} | {900: 900, 901: 900}
