"""Golden rows worked out by hand for the expressions, and the batch plan end to end."""

import pytest
from pyspark.sql import functions as F

from docsift.functions import geometry as G
from docsift.functions import sequences as Q
from docsift.functions import text as X
from docsift.operators import evaluate, integrity, layout, quality, routing
from docsift.plans.process import Options, process

LEXICON = "day as reminder of the revenue by region is on this page total quarterly report moon tells a".split()


def one(spark, column, *values, schema):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column).collect()]


def test_flatten(spark):
    cases = [("![a](b) [c](d)", "c"), ("**b** snake_case", "b snakecase"), ("# Title\ntext", "Title\ntext"), ("para\n\n- item", "para\nitem"), ("x\n* item", "x\n item"), ("a\n\n\n\nb", "a\n\nb"), ("", "")]
    assert one(spark, X.to_plaintext(F.col("t")), *[(a,) for a, _ in cases], schema="t string") == [b for _, b in cases]


def test_line_gate(spark):
    lexicon = spark.createDataFrame([("en", w, 5.0) for w in LEXICON], "lang string, word string, zipf double")
    good = ["day as a reminder of the", "Total $1,299.00", "v1.2-beta", "东京の天気は晴れ"]
    bad = ["|||", "llIl1", "l1Il|", "-------", "aaaaaah", "x", "xqzt vbnm plkj wrtz", "a1#b c2$d", "@@##$$%%"]
    rows = [(i, t, 0.98, ["en"], t in good) for i, t in enumerate(good + bad)] + [(20, good[0], 0.5, ["en"], False), (21, "the moon tells", 0.99, ["fr"], False), (22, "the moon tells", 0.99, ["fr", "en"], True)]
    lines = spark.createDataFrame(rows, "id int, text string, score double, langs array<string>, want boolean")
    for r in quality.judge_lines(lines, ["id"], lexicon, F.col("langs")).collect():
        assert r.ok == r.want, (r.text, r.reason)


def test_page_score(spark):
    texts, scores = ["The Quarterly Report", "", "|||", "revenue by region is on this page"], [0.99, 0.0, 0.95, 0.97]
    lines = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(zip(texts, scores, strict=True))] + [(2, 0, "", 0.0)], "page int, pos int, text string, score double")
    got = {r.page: r.quality for r in quality.page_quality(quality.judge_lines(lines, ["page", "pos"]), ["page"]).collect()}
    assert got == {1: pytest.approx(53 / 56), 2: 0.0}


def test_ctc(spark):
    classes = [1, 1, 0, 1, 2, 2, 3, 0]
    row = lambda k: [(0.97 if k == 0 else 0.9) if j == k else 0.01 for j in range(4)]
    got = one(spark, Q.ctc_decode(F.col("p"), F.array(*map(F.lit, ["<blank>", "a", "b", " "]))), ([row(k) for k in classes],), ([row(0)] * 3,), schema="p array<array<double>>")
    assert got[0].text == "aab " and got[0].score == pytest.approx(0.9)
    assert got[1].text == "" and got[1].score == 0.0


def test_reading_order(spark):
    boxes = [(200, 10, 300, 30, "world"), (10, 12, 150, 31, "hello"), (10, 80, 100, 100, "para two"), (10, 40, 90, 60, "next"), (0, 0, 5, 5, " ")]
    items = [([(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))], t) for a, b, c, d, t in boxes]
    got = one(spark, layout.assemble_lines(F.col("items")), (items,), ([],), schema="items array<struct<quad:array<struct<x:double,y:double>>,text:string>>")
    assert got == ["hello world\nnext\n\npara two", ""]


def test_sizes(spark):
    assert [tuple(r) for r in one(spark, G.smart_resize(F.col("h"), F.col("w")), (28, 28), (1000, 1000), schema="h int, w int")] == [(336, 336), (980, 980)]
    assert one(spark, G.smart_resize(F.col("h"), F.col("w")), (28, 9000), schema="h int, w int") == [None]
    assert [tuple(r) for r in one(spark, G.det_resize(F.col("h"), F.col("w")), (20, 50), (5000, 3000), schema="h int, w int")] == [(64, 160), (4000, 2400)]
    quad = [(0.0, 0.0), (100.0, 0.0), (100.0, 20.0), (0.0, 20.0)]
    grown = one(spark, G.unclip(F.col("q"), 1.5), (quad,), schema="q array<struct<x:double,y:double>>")[0]
    assert [tuple(p) for p in grown] == [(-12.5, -12.5), (112.5, -12.5), (112.5, 32.5), (-12.5, 32.5)]


def test_sequences(spark):
    assert one(spark, Q.banned_next(F.col("s")), ([1, 2, 3, 4, 1, 2, 3],), ([1, 2],), schema="s array<int>") == [[4], []]
    assert one(spark, Q.looping(F.col("s")), ([7] * 40,), ([7] * 39,), ([1, 2] * 20,), schema="s array<int>") == [True, False, True]


def test_names_rates_and_routes(spark):
    done = spark.createDataFrame([(i, s) for i, s in enumerate("abaa")], "pos int, stem string")
    assert [r.path for r in routing.output_names(done).orderBy("pos").collect()] == ["a_ocr.txt", "b_ocr.txt", "a_ocr_2.txt", "a_ocr_3.txt"]
    assert one(spark, evaluate.cer(F.col("h"), F.col("r")), ("abc", "abd"), ("", ""), ("x", ""), schema="h string, r string") == [pytest.approx(1 / 3), 0.0, 1.0]
    assert one(spark, X.slug(F.col("t")), ("Hello, World!",), ("?!",), schema="t string") == ["hello_world", "webpage"]
    assert one(spark, routing.keeps_primary(F.col("q"), F.col("m")), (0.79, 0.8), (0.8, 0.8), (0.0, 0.0), schema="q double, m double") == [False, True, True]
    with pytest.raises(Exception, match="not a quality"):
        one(spark, routing.check_quality(F.col("q")), ("2",), schema="q string")
    assert one(spark, routing.check_quality(F.col("q")), ("0.5",), schema="q string") == [0.5]


def test_old_manifest_drops_nothing(spark):
    embedded = spark.createDataFrame([(f"f{i}", "a" * 64) for i in range(11)], "name string, sha256 string")
    old = spark.createDataFrame([("f3", "b" * 64)], "name string, sha256 string")
    merged = {r.name: r.sha256 for r in integrity.merge_manifests(embedded, old).collect()}
    assert len(merged) == 11 and merged["f3"] == "b" * 64
    files = spark.createDataFrame([("f1", "a" * 64), ("f3", "c" * 64), ("zz", "d")], "name string, actual string")
    checked = integrity.verify(files, integrity.merge_manifests(embedded, old))
    assert {r.name: r.status for r in checked.collect()} == {"f1": "verified", "f3": "mismatch", "zz": "skipped"}
    with pytest.raises(ValueError, match="mismatch"):
        integrity.assert_verified(checked)
    assert integrity.assert_verified(checked.where("name <> 'f3'")) == 1


def _batch(spark):
    inputs = spark.createDataFrame([(0, "p0", "page", None), (1, "p1", "page", None), (2, "gone", "page", "FileNotFoundError: gone"), (3, "p3", "page", None)], "pos long, path string, stem string, error string")
    quad = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    lines = spark.createDataFrame([("p0", 0, "a good line", 0.99, quad), ("p1", 0, "|||", 0.99, quad), ("p3", 0, "fine text", 0.9, quad)], "path string, pos int, text string, score double, quad array<struct<x:double,y:double>>")
    return inputs, lines


def test_batch(spark):
    inputs, lines = _batch(spark)
    thorough = lambda keys: keys.select("path", F.lit("**read** again").alias("text"))
    got = {r.pos: r for r in process(inputs, lines, Options(folder="out"), secondary=thorough).collect()}
    assert [got[i].output for i in range(4)] == ["out/page_ocr.txt", "out/page_ocr_2.txt", None, "out/page_ocr_3.txt"]
    assert [got[i].engine for i in (0, 1, 3)] == ["primary", "secondary", "primary"] and got[1].text == "read again"
    status = routing.batch_status(process(inputs, lines)).head()
    assert (status.n_failed, status.n_total, status.status) == (1, 4, 1)
    assert {r.engine for r in process(inputs, lines, Options(min_quality=0.0), secondary=thorough).collect()} == {"primary", None}
    with pytest.raises(RuntimeError, match="gone"):
        process(inputs, lines, Options(strict=True))
    with pytest.raises(ValueError):
        Options(min_quality=1.5)


def test_texts_are_written(spark, tmp_path):
    from docsift.sources.sinks import write_texts

    rows = spark.createDataFrame([(0, "a_ocr.txt", "é\n"), (1, "sub/b.txt", "")], "pos long, path string, text string")
    assert [r.error for r in write_texts(rows, str(tmp_path)).collect()] == [None, None]
    assert (tmp_path / "a_ocr.txt").read_text(encoding="utf-8") == "é\n" and (tmp_path / "sub/b.txt").exists()


def test_stream_gate_equals_batch(spark, tmp_path):
    from docsift.streaming.gate import judged_stream, run_gate

    schema = "doc_id long, text string, score double"
    docs = spark.createDataFrame([(1, "a good line\n|||", 0.9), (2, "", 0.9), (3, "fine", 0.5)], schema)
    docs.write.parquet(f"{tmp_path}/in")
    run_gate(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    key = lambda r: (r.doc_id, r.quality, r.engine)
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(key, judged_stream(docs).collect()))
