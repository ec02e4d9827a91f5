"""FM-index and decontamination against plain search."""

import re

import numpy as np
import pyarrow as pa

from docsift.llm import decontam as D
from docsift.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 400)
    ends = np.sort(rng.choice(399, 30, replace=False))
    text[ends] = 0
    text[-1] = 0
    starts = np.concatenate(([0], np.flatnonzero(text == 0)[:-1] + 1))
    index = FMIndex(text, starts, 3)
    phrases = [rng.integers(1, 4, n) for n in rng.integers(1, 6, 60)]
    flat, start = np.concatenate(phrases), np.cumsum([0] + [len(p) for p in phrases[:-1]])
    low, high = index.search(flat, start, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        got = sorted(index.locate(np.arange(a, b)).tolist())
        assert got == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


def _case():
    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(30)] + ["É", "x9", "Z"]
    draw = lambda n: " ".join(rng.choice(vocab, n))
    items = [(str(i), draw(int(rng.integers(1, 30)))) for i in range(12)] + [("s", "v1 v2"), ("n", None), ("e", "..."), ("", draw(12)), ("0", draw(11))]
    items = [(i, t) for i, t in items if t is not None and t not in ("v1", "v2")]
    texts = [None, "", "..", "v1 v2", "V1--v2!"]
    for _ in range(120):
        parts = [draw(int(rng.integers(0, 15)))]
        for _ in range(int(rng.integers(0, 3))):
            own = words(items[int(rng.integers(len(items)))][1])
            a = int(rng.integers(0, max(1, len(own) - 3)))
            parts += [", ".join(own[a:]).upper(), draw(int(rng.integers(0, 6)))]
        texts.append("\n".join(parts))
    return texts, items


def test_hits_equal_brute_force():
    texts, items = _case()
    want = brute(texts, items)
    for chunk in (len(items), 3):
        chunks = [D.phrases(items[i : i + chunk]) for i in range(0, len(items), chunk)]
        got = D.find_all(pa.array(texts, pa.large_string()), chunks)
        for i, w in enumerate(want):
            assert (int(got.n_words[i]), int(got.n_hit[i]), sorted(got.items.get(i, ()))) == w
            assert sum(b - a for a, b in got.spans.get(i, ())) == w[1]


def test_removal_leaves_no_phrase_and_all_else(spark):
    texts, items = _case()
    docs = spark.createDataFrame([(i, t, "s", "extra") for i, t in enumerate(texts)], "doc_id long, text string, source string, spans string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = {r.doc_id: r for r in D.remove_spans(docs, bench).collect()}
    before = brute(texts, items)
    for i, row in out.items():
        assert brute([row.text], items)[0][1] == 0
        assert row.spans == "extra"
        if before[i][1] == 0:
            assert row.text == texts[i]
    assert all(i in out for i, b in enumerate(before) if b[1] == 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items) for r in D.contamination(docs, none).collect()] == [(2, 0, 0)]
    assert D.contamination(docs.limit(0), none).count() == 0


def test_phrases_are_the_distinct_windows():
    _, items = _case()
    items += [items[3], ("twin", items[3][1])]
    given = D.phrases(items)
    windows = {}
    number = {h: k + 1 for k, h in enumerate(given.vocabulary.tolist())}
    from docsift.llm.kernel import classes, hash_segments, slices, words_of

    for name, text in items:
        part = next(slices(pa.array([text], pa.large_string())))
        found = words_of(part, classes("alnum"))
        own = [number[h] for h in hash_segments(part.data, found.starts, found.ends, lower=True).tolist()]
        size = min(10, len(own))
        for i in range(len(own) - size + 1) if own else ():
            windows.setdefault(tuple(own[i : i + size]), set()).add(name)
    got = {tuple(given.words[a : a + n].tolist()): {given.names[i] for i in given.item_of[given.item_from[k] : given.item_from[k + 1]]} for k, (a, n) in enumerate(zip(given.start, given.length, strict=True))}
    assert got == windows and len(given.start) == len(windows)


def test_shards_gather_batches_and_split_them(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 9])], ["doc_id", "text"])
    for size in (1, 12, 30, 1000):
        monkeypatch.setattr(D, "SHARD_BYTES", size)
        out = list(D._shards(iter([batch, batch.slice(0, 0), batch.slice(3), batch])))
        assert [i for b in out for i in b.column("doc_id").to_pylist()] == [*range(6), 3, 4, 5, *range(6)]
        sizes = [sum(len(t or "") for t in b.column("text").to_pylist()) for b in out]
        assert all(n >= size for n in sizes[:-1]) and (size < 1000 or len(out) == 1)


def test_many_chunks_and_shards(spark, monkeypatch):
    texts, items = _case()
    monkeypatch.setattr(D, "RESIDENT", 1)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "v1 v2")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute(texts, items)
    got = {r.doc_id: r for r in D.contamination(docs, bench, chunk_words=20).collect()}
    assert len(got) == len(texts) + 1
    for i, (n, hit, found) in enumerate(want):
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(found))


def test_a_long_text_and_words_that_cancel_in_polynomials(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rng = np.random.default_rng(1)
    passage = "one two three four five six seven eight nine ten eleven"
    long = " ".join(rng.choice(["one", "two", "six", "far", "near"], 300_000)) + " , " + passage + " . " + " ".join(["six"] * 100_000)
    docs = spark.createDataFrame([(1, long), (2, f"x {two} y"), (3, one)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, one)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (11, 1), 2: (0, 0), 3: (1, 1)}
