"""Mixing and URL reputation against plain Python and against their DuckDB twins."""

import re
from pathlib import Path

import pytest

from docsift.llm import mixing as M
from docsift.llm import queries, urls

SF = Path("/root/testdata/sf0.001")


def water_fill(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_are_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, None: 5, "c": 0, "Z": 77}, {"x": 3}, {"a": 0, "b": 0}, {f"s{i}": 7**i for i in range(8)}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in M.source_targets(rows).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys()
        for s in got:
            assert got[s] == pytest.approx(want[s])


def test_report_and_mix_agree(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}", i) for i in range(400)] + [(None, "a b", None, 1), (7, None, "s1", 2), (8, "", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int")
    report = M.mix_report(docs).collect()
    assert len(report) == len(rows)
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in report)
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in report) == sorted((r.doc_id or -1, r.size, r.copies) for r in M.mix_report(docs.repartition(7)).collect())
    mixed = M.mix(docs)
    assert mixed.count() == sum(r.copies for r in report)
    assert mixed.columns == ["doc_id", "text", "source", "copy_no"]
    by = {}
    for r in report:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    for target, taken in by.values():
        assert abs(taken - target) <= 17


def by_source(docs, report):
    """source: (target, taken, sizes of its documents); rows of docs and report in the same order."""
    out = {}
    for d, r in zip(docs, report, strict=True):
        one = out.setdefault(d["source"], [r.target, 0, []])
        one[1] += r.taken
        one[2].append(r.size)
    return out


def bound(sizes):
    """Half the largest document that is not large, or half of what one is larger than all smaller ones."""
    ranked, rest, out = sorted(sizes), 0, 0.5
    for size in ranked:
        out = max(out, size / 2 if size * M.LARGE <= sum(sizes) else (size - rest) / 2)
        rest += size
    return out


@pytest.mark.parametrize("with_ids", [True, False])
def test_every_source_comes_near_its_target(spark, with_ids):
    """Sizes of one word to thousands, null ids, one hot source: misses are bounded by the size of small documents."""
    import random

    rng, rows = random.Random(4), []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 13}"
        rows.append({"doc_id": i if with_ids else None, "source": source, "text": f"t{i} " + "w " * int(rng.lognormvariate(3.5, 1.4))})
    report = M.mix_report(spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)).collect()
    for target, taken, sizes in by_source(rows, report).values():
        assert abs(taken - target) <= bound(sizes) + 1e-6


def test_probability_is_the_fraction(spark):
    """Over many seeds, a large and a small document of a source are taken as often as the rate asks."""
    rows = [(0, "s", "w " * 200)] + [(i, "s", f"w{i} " * 9) for i in range(1, 60)] + [(100, "t", "x " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).cache()
    seen = {0: 0, 1: 0, 59: 0}
    for seed in range(12):
        for r in M.mix_report(docs, weights=(2, 1), seed=f"s{seed}").collect():
            if r.doc_id in seen:
                seen[r.doc_id] += r.copies
                rate = r.target / r.source_size
    for doc_id in seen:
        assert abs(seen[doc_id] / 12 - rate) < 0.45


def test_repeated_rows_draw_alike(spark):
    rows = [(1, "s", "a b c")] * 50 + [(i, "s", f"w{i} x y") for i in range(2, 90)] + [(500, "t", "z " * 400)]
    report = M.mix_report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len({r.copies for r in report if r.doc_id == 1}) == 1 and len(report) == len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source", "text").coalesce(1)
    rows = docs.collect()
    for target, taken, sizes in by_source(rows, M.mix_report(docs).collect()).values():
        assert abs(taken - target) <= bound(sizes) + 1e-6, (target, taken, sorted(sizes))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_report(docs).count() == 0 and M.mix(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge_urls(pages, labels).count() == 0


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(
        [(0, None), (1, "no scheme"), (2, "http://A.Example.ORG/es/x?q=/de/"), (3, "https://example.org/en/12"), (4, "https://badexample.org/es/"), (5, "x://y.com/de/#f"), (6, "x://y.com"), (7, "http://h.net/a#b?c"), (8, "a://b://c/d"), (9, "http://org/"), (10, "http://z.com/fr/1")],
        "page_id long, url string",
    )
    labels = spark.createDataFrame([(7, 0, 1), (7, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("badexample.org", "/es/", "org/", "allow")
    assert got[5] == ("y.com", "/de/", "com/de/", "block") and got[6] == ("y.com", "", None, "allow")
    assert got[7][:3] == ("h.net", "/a", None) and got[8][:2] == ("b:", "//c/d") and got[9][2] == "org/" and got[10][2:] == ("com/fr/", "allow")


def test_bad_hosts_go(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.example.net/{i}") for i in range(200)] + [(999, "http://new.example.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels).collect()}
    assert got[1].verdict == "block" and got[0].verdict == "allow" and got[999].verdict == "allow"
    assert 0 < got[1].good_rate < 0.1 < got[999].good_rate < got[0].good_rate < 1


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    df = queries.QUERIES[name](spark, str(SF))
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(re.sub(r"(\d\.\d{6})\d+", r"\1", str([r[i] for i in order])) for r in data)

    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_urls_with_clashing_columns_and_own_suffixes(spark):
    pages = spark.createDataFrame([(1, "http://a.b.example.pvt.test/x", "h", 1.0), (None, "http://q/" + "p" * 100_000, "i", 2.0), (1, "http://a.b.example.pvt.test/x", "h", 1.0)], "page_id long, url string, host string, n double")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, page_id string")
    got = urls.judge_urls(pages, labels.drop("page_id"), second_level=("pvt.test",)).collect()
    assert sorted((r.page_id or 0, r.host) for r in got) == [(0, "q"), (1, "a.b.example.pvt.test"), (1, "a.b.example.pvt.test")]
    from pyspark.sql import functions as F

    suffix, domain = urls.suffix_and_domain(F.col("host"), ("pvt.test",))
    row = spark.createDataFrame([("a.b.example.pvt.test",)], "host string").select(suffix.alias("s"), domain.alias("d")).first()
    assert (row.s, row.d) == ("pvt.test", "example.pvt.test")


def test_mix_of_long_texts_and_clashing_columns(spark):
    rows = [(1, "word " * 300_000, "a", 7, 1), (2, "x y", "b", 8, 2), (3, None, "b", 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int, size int")
    assert {r.doc_id: r.size for r in M.mix_report(docs).collect()} == {1: 300_000, 2: 2, 3: 0}
    mixed = M.mix(docs)
    assert mixed.columns == [*docs.columns, "copy_no"] and {r.target for r in mixed.collect()} <= {7, 8, 9}
