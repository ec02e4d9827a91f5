"""Words, hashes and rule statistics against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docsift.llm import kernel as K
from docsift.llm import quality as Q

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "a", "a b c d e a b c d e", "x\n\nx\n \n \nx y\nx", "é é é é é é é é", " \t\n", "a" * 300_000 + " b", "\xa0   z", "a b c d e f\na b c d e f", "日本 語\x0bx", "A-B a_b 9'z", "\x1c x \x85"]


def stats(text):
    text = text or ""
    w = BLANK.findall(text)
    uses = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if uses[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(hit)


def test_statistics_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("ab \n#é")) for _ in range(rng.integers(0, 120))) for _ in range(400)]
    got = Q.text_stats(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in Q.STATS[:5]) == stats(text), text


@pytest.mark.parametrize(("kind", "pattern"), [("blank", BLANK), ("alnum", ALNUM)])
def test_words_and_hashes(kind, pattern):
    texts = [t or "" for t in ODD]
    named: dict[int, str] = {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for part in K.slices(pa.array(texts), max_bytes=50):
        words = K.words_of(part, K.classes(kind))
        hashes = K.hash_segments(part.data, words.starts, words.ends, lower=True)
        for row in range(part.rows):
            want = pattern.findall(texts[part.lo + row].translate(lower))
            own = hashes[words.offsets[row] : words.offsets[row + 1]]
            assert len(own) == len(want)
            for h, w in zip(own.tolist(), want, strict=True):
                assert named.setdefault(h, w) == w
    assert len(set(named.values())) == len(named)


def test_forest_finds_odd_rows_and_keeps_good(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(f"a{i}{j}" + "###$$" for j in range(60))) for i in range(5)]
    docs = spark.createDataFrame(good + junk + [(5000, None), (5001, ""), (5002, "short text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert len(rows) == 308
    assert sum(rows[i].kept for i in range(300)) >= 298
    assert not any(rows[1000 + i].kept for i in range(5))
    assert all(rows[i].base_failed and not rows[i].kept for i in (5000, 5001, 5002))


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judge(docs, labels).count() == 0


def test_lines_and_words_that_cancel_in_polynomials():
    """Runs of a Thue-Morse sequence and its opposite hash alike under any polynomial modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{two}", f"{one}\n{one}", " ".join([one, two, one, two, one, two]), " ".join([one] * 6)]
    got = Q.text_stats(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in Q.STATS[:5]) == stats(text)


def test_runs_around_the_eight_byte_steps():
    words = [c * n for c in "ab" for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300, 5000)] + ["a" * 8 + "b", "b" + "a" * 8, "é" * 4, "\x01"]
    part = next(K.slices(pa.array([" ".join(words * 2)]), max_bytes=1 << 20))
    found = K.words_of(part, K.classes("blank"))
    hashes = K.hash_segments(part.data, found.starts, found.ends).tolist()
    assert hashes[: len(words)] == hashes[len(words) :] and len(set(hashes)) == len(words)


def test_quality_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l.", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(1, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in Q.judge(docs, labels).collect()) == [(0, 0, True), (1, 12, False)]


def grown(x, forest, tree, node, depth):
    """Paths of the rows by plain recursion over all of them, under the forest's draws."""
    wide = [c for c in range(x.shape[1]) if len(x) and x[:, c].max() > x[:, c].min()]
    if depth == forest.depth or not wide:
        return np.full(len(x), depth + float(Q._average_path(len(x))))
    col = wide[int(forest.draws[0, tree, node] * len(wide))]
    least, most = x[:, col].min(), x[:, col].max()
    low = x[:, col] <= least + forest.draws[1, tree, node] * (most - least)
    out = np.zeros(len(x))
    out[low], out[~low] = grown(x[low], forest, tree, 2 * node, depth + 1), grown(x[~low], forest, tree, 2 * node + 1, depth + 1)
    return out


def test_forest_and_threshold_from_all_rows(spark):
    """More rows than any bound that fitting once had: 8,192 for the trees, 20,000 for the threshold."""
    n, rng = 24_000, np.random.default_rng(5)
    s = {c: rng.integers(0, 40, n) for c in Q.STATS} | {"n_words": rng.integers(0, 60, n), "n_repeat_words": np.zeros(n, np.int64)}
    frame = spark.createDataFrame(list(zip(range(n), *(s[c].tolist() for c in Q.STATS), strict=True)), Q.SCHEMA)
    forest, again = Q.fit(frame.repartition(3)), Q.fit(frame.coalesce(1))
    used = s["n_words"] > 0
    assert forest.size == used.sum()
    assert (forest.split == again.split).all() and (forest.column == again.column).all() and (forest.path == again.path).all()
    x = Q.features(s)
    for t in range(0, Q.TREES, 9):
        assert np.allclose(forest.path[t][forest._nodes(x[used], t, forest.depth)], grown(x[used], forest, t, 1, 0))
    odd, failed = forest.score(x), Q.base_failed(s)
    scored = spark.createDataFrame(list(zip(range(n), failed.tolist(), odd.tolist(), strict=True)), "doc_id long, base_failed boolean, anomaly double")
    labels = spark.createDataFrame([(i, int(i % 50 > 0)) for i in range(n)] + [(None, 1), (7, None)], "doc_id long, quality int")
    kept = np.sort(odd[~failed & (np.arange(n) % 50 > 0)])
    assert Q.calibrate(scored, labels) == kept[int(np.ceil(len(kept) * (1 - Q.MAX_GOOD_LOST)))] + 1e-9


def test_extreme_rows_do_not_hide_junk(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(f"a{i}{j}" + "###$$" for j in range(60))) for i in range(5)]
    extreme = [(2000 + i, "b" * 10 ** (3 + i) + " c d e f g h i j k") for i in range(3)] + [(2003, "#" * 100_000 + " c d e f g h i j k")]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    rows = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(good + junk + extreme, "doc_id long, text string"), labels).collect()}
    assert sum(rows[i] for i in range(300)) >= 298
    assert not any(rows[i] for i, _ in junk + extreme)


def test_quality_of_one_row_and_of_equal_rows(spark):
    text = "a b c d e f g h i j k l."
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for n in (1, 40):
        docs = spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string")
        assert [r.kept for r in Q.judge(docs, labels).collect()] == [True] * n


def test_verdicts_follow_from_all_labelled_rows(spark):
    n, rng = 24_000, np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdeFG.,#"), rng.integers(1, 9))) for _ in range(3000)])
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(n)], "doc_id long, text string")
    rows = Q.judge(docs.repartition(4), spark.range(n).selectExpr("id AS doc_id", "1 AS quality")).collect()
    odd = np.sort([r.anomaly for r in rows if not r.base_failed])
    most = odd[int(np.ceil(len(odd) * (1 - Q.MAX_GOOD_LOST)))]
    assert all(r.kept == (not r.base_failed and r.anomaly <= most + 1e-9) for r in rows)
