"""Language ID on held-out rows; token counts against the library."""

import random

import pyarrow as pa
import pytest

from docsift.llm import langid as L
from docsift.llm import tokens as K

WORDS = {"en": "the of and to in is was that with for this have from they which".split(), "de": "der die und das ist nicht mit für auf eine werden über schön größe".split(), "fr": "le la les des est une pour dans que avec être où déjà français".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(4, 60)), lang, "s") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(500))]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 !! 34", None, "s"), (903, "語", None, "s"), (None, "the of and to", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i], lang) for i, _, lang, _ in rows[:500] if got[i].held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.98
    assert not any(r.rejected for r, _ in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (900, 901, 902):
        assert got[i].lang_pred == "und" and got[i].rejected
    assert got[903].lang_pred in WORDS and got[None].held_out
    kept = {r.doc_id for r in L.keep_identified(docs, model).collect()}
    assert {i for i, *_ in rows[:500]} <= kept and not kept & {900, 901, 902}


FOREIGN = [
    "il governo ha deciso di aumentare le tasse sulla casa e gli abitanti della città sono scesi in piazza per protestare contro questa scelta",
    "rząd zdecydował się podnieść podatki od domów a mieszkańcy miasta wyszli na ulice aby zaprotestować przeciwko tej decyzji",
    "hallitus päätti nostaa asuntoveroa ja kaupungin asukkaat lähtivät kaduille osoittamaan mieltään tätä päätöstä vastaan",
    "3f9ac0de77b1 a0e4f1c2bd 9e8d7c6b5a 4f3e2d1c0b a9f8e7d6c5 deadbeef00 c0ffee1234 " * 5,
]


def test_unlearned_languages_and_noise_go(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, lang, rng.randint(8, 90)), lang, "s") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(1800))]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), per_lang=150)
    assert model.predict(pa.array(FOREIGN))[2].all()
    good = pa.array([text(rng, lang, n) for lang in WORDS for n in (8, 15, 30, 60, 120, 400) for _ in range(20)])
    assert model.predict(good)[2].mean() <= 0.01


def test_lower_bound_of_scores():
    import numpy as np

    rng = np.random.default_rng(8)
    scores = rng.beta(20, 1, 100_000)
    for n in (100, 100_000):
        assert np.mean(scores < L.lower_bound(scores[:n])) < 0.01
    assert L.lower_bound(scores) == pytest.approx(np.quantile(scores, L.MAX_GOOD_REJECTED), abs=1e-3)
    assert L.lower_bound(scores[:100]) < scores[:100].min() and L.lower_bound(np.ones(5)) == pytest.approx(1) and L.lower_bound(scores[:0]) == 0.0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in L.identify(docs, L.fit(docs)).collect()] == [("und", 0.0, True)]
    assert L.identify(docs.limit(0), L.fit(docs.limit(0))).count() == 0


def test_labels_are_bounded(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, 20), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(1000 + i, "some text", f"odd{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "MOST_LANGS", len(WORDS))
    assert set(L.fit(docs).langs) == set(WORDS)


def slow_logits(model, given):
    """Scores by the definition: every run of 2 to 4 bytes with blanks at its ends only, one at a time."""
    import numpy as np

    raw = f" {given.lower()} ".encode()
    clean = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in raw)
    total, n = np.zeros(len(model.langs)), 0
    for size in (2, 3, 4):
        for i in range(len(clean) - size + 1):
            part = clean[i : i + size]
            if b" " in part[1:-1] or not part.strip():
                continue
            value = int.from_bytes(part, "little") * int(L._FACTOR[size]) % 2**32
            total += model.weights[value >> (32 - L.BUCKET_BITS)]
            n += 1
    return total / max(1, n) + model.bias


def test_scores_against_the_definition():
    import numpy as np

    rng = random.Random(5)
    texts = [text(rng, lang, rng.randint(1, 40)) for lang in WORDS for _ in range(30)]
    model = L.train(sorted(WORDS), L.bucket_shares(pa.array(texts)), np.array([k for k, _ in enumerate(sorted(WORDS)) for _ in range(30)]))
    odd = ["É", "a", "x  y\tz 12", "ÀÉ ß", "word" * 50_000, "日本 語", "a.b.c"]
    langs, score, _ = model.predict(pa.array(texts + odd))
    for given, lang, s in zip(texts + odd, langs, score, strict=True):
        if len(given) > 1000:
            continue
        p = L._softmax(slow_logits(model, given) / model.temperature)
        assert lang == model.langs[int(p.argmax())] and s == pytest.approx(float(p.max()), abs=1e-4)


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, lang, 30), lang, "x", 1) for i, lang in enumerate(list(WORDS) * 30)] + [(999, text(rng, list(WORDS)[0], 60_000), None, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert got[999].lang_pred == list(WORDS)[0]
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 999 AND lang_pred = 'y' AND score = 2").count() == 1


def test_shares_and_prediction_agree():
    rng = random.Random(2)
    texts = [text(rng, lang, rng.randint(1, 30)) for lang in WORDS for _ in range(40)] + ["a", "é", "x y z"]
    target = [k for k, _ in enumerate(WORDS) for _ in range(40)]
    import numpy as np

    shares = L.bucket_shares(pa.array(texts))
    model = L.train(sorted(WORDS), shares[:120], np.array(target))
    p = L._softmax(model.logits(shares) / model.temperature)
    langs, score, _ = model.predict(pa.array(texts))
    assert np.allclose(p.max(axis=1), score, atol=1e-4)
    assert [model.langs[k] for k in p.argmax(axis=1)] == langs


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path(K.VOCABULARY)


def test_counts_equal_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    rng = random.Random(3)
    letters = "aZé'sİ 1²<|>\n\t\x1c\x1f\x00!?日ς\u0301 \u0085x"
    texts = ["", "don't'S'", "Hello<|endoftext|>World <|startoftext|>", "日本語のテキスト 12３", "\x00!", "😀😀 x", "ﬁ ﬀ", "<|endoftext"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (0, "")], "doc_id long, text string")
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)} | {-1: 0}
    rows = K.token_counts(docs, vocabulary).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.n_tokens == want[r.doc_id], texts[r.doc_id]
        assert r.n_bytes == (len(texts[r.doc_id].encode()) if r.doc_id >= 0 else 0)
        assert r.over_limit == (r.n_tokens > 2048)
    assert K.token_counts(docs.limit(0), vocabulary).count() == 0


def test_long_texts_are_cut_at_blanks(monkeypatch, vocabulary):
    tool = K.pre_tokens(vocabulary)
    sample = "Some words, and more's the <|endoftext|> pity é語 x" * 20

    def count():
        parts, specials = tool.split(sample)
        return specials + sum(tool.length(p) for part in parts for p in part)

    whole = count()
    monkeypatch.setattr(K, "PIECE_CHARS", 7)
    assert count() == whole == len(tool.tokenizer.encode(sample, add_special_tokens=False).ids)


def _whole(tool, text):
    parts, specials = tool.split(text)
    return specials + sum(tool.length(p) for part in parts for p in part)


def test_every_code_point_between_letters(vocabulary):
    """Each code point after, before and between letters, digits and blanks, against the library."""
    tool = K.pre_tokens(vocabulary)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f"ization{chr(c)}al{chr(c)}{chr(c)}tions {chr(c)} the{chr(c)}1{chr(c)} {chr(c)}'s" for c in points]
    want = [len(e.ids) for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [hex(c) for c, t, n in zip(points, texts, want, strict=True) if _whole(tool, t) != n]
    assert not bad


def test_random_pairs_of_latin_code_points(vocabulary):
    tool, rng = K.pre_tokens(vocabulary), random.Random(9)
    texts = ["".join(chr(rng.randrange(0x250)) if rng.random() < 0.5 else rng.choice("ingtheation ") for _ in range(rng.randint(2, 12))) for _ in range(20_000)]
    want = [len(e.ids) for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [_whole(tool, t) for t in texts] == want


def test_the_sample_changes_no_count(spark, vocabulary, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and some more words é{i}", "x") for i in range(60)], "doc_id long, text string, n_tokens string")
    whole = sorted(K.token_counts(docs, vocabulary).collect())
    monkeypatch.setattr(K, "SAMPLE_DOCS", 3)
    assert sorted(K.token_counts(docs, vocabulary).collect()) == whole
