"""Error rates over whole texts of all rows, against brute force."""

import pytest

from docsift.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rate(hypothesis, reference):
    return distance(hypothesis, reference) / len(reference) if reference else float(hypothesis != "")


LONG = "Où est la bibliothèque, größer als zuvor? " * 4
TURNS = [
    (1, 0, "user", LONG + "Fin à droite"), (1, 1, "assistant", LONG + "fin a droite"), (1, 2, "user", LONG + "東京"), (1, 5, "assistant", LONG + "東京"), (1, 6, "user", LONG + "東京の天気"),
    (2, 0, "user", "É" * 130), (2, 1, "assistant", "E" * 130), (2, 4, "user", "é" * 129), (3, 0, "user", ""), (3, 7, "assistant", "ñ"),
]


ITEMS = [(1, "the mother of them all "), (2, "là-bas, the été e fin"), (3, "größer e th ñ"), (4, "東京 the"), (5, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_cer(spark, tables):
    got = {r.item_id: (r.cer, r.cer_empty, r.cer_no_truth) for r in QUERIES["cer"](spark, tables).collect()}
    assert got.keys() == {i for i, _ in ITEMS}
    for i, text in ITEMS:
        swapped = text.replace("th", "ht").replace("e ", " ")
        assert got[i] == pytest.approx((rate(swapped, text), rate("", text), rate(text, "")), abs=1e-6)


def test_variant_summary(spark, tables):
    got = {r.variant: r for r in QUERIES["variant_summary"](spark, tables).collect()}
    base = {c: text for c, turn, _, text in sorted(TURNS) if turn % 2 == 0}
    for variant in "ab":
        own = [(text, base[c]) for c, turn, _, text in TURNS if "ab"[turn % 2] == variant]
        assert got[variant].n == len(own) and got[variant].identical == sum(a == b for a, b in own)
        assert got[variant].cer == pytest.approx(sum(rate(a, b) for a, b in own) / len(own), abs=1e-6)
        assert got[variant].total_s == pytest.approx(sum(2 * len(a) for a, _ in own) / len(own), abs=1e-6)


def test_variant_truth(spark, tables):
    got = {r.variant: r for r in QUERIES["variant_truth"](spark, tables).collect()}
    truth = {c: text.lower() for c, turn, _, text in TURNS if turn == 0}
    for variant in "ab":
        own = [rate(text, truth[c]) for c, turn, _, text in TURNS if "ab"[turn % 2] == variant]
        assert got[variant].n == len(own) and got[variant].cer == pytest.approx(sum(own) / len(own), abs=1e-6)
