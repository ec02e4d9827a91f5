"""Whole runs: kinds of inputs, pages of the web, names, failures, the engine that cannot be loaded; folders of models."""

import os
import urllib.error

import pytest
from pyspark.sql import functions as F

from docsift import __main__ as cli
from docsift.models import engine, registry, wire
from docsift.operators import images, integrity, layout
from docsift.plans import joins
from docsift.plans.run import RunOptions, output_of, run_batch
from docsift.queries.batch import bitmap, fast, thorough
from docsift.sources import reading

HTML = '<html><head><title>{}</title></head><body><article><img src="/big.bmp" width=90 height=90><img src="b.bmp" width=1 height=1></article></body></html>'
TYPES = {"http://h.example/a.png": "image/png", "http://h.example/page": "text/html", "http://h.example/untitled": "text/html; x", "http://h.example/none": "text/html", "http://h.example/gone.png": ""}


def stubs():
    """A server's answers, as local functions, which travel to workers by value."""
    types = dict(TYPES)
    body = {"http://h.example/a.png": bitmap(30, 10), "http://h.example/big.bmp": bitmap(70, 10), "http://h.example/page": HTML.format("Big News!").encode(), "http://h.example/untitled": HTML.format("").encode(), "http://h.example/none": b"<p>text</p>"}

    def ask(address, method, headers, timeout):
        if method == "HEAD" and "page" in address:
            raise OSError("no head")
        return types.get(address, "")

    def fetch(rows):
        content, error = F.udf(lambda u: body.get(u) and bytearray(body[u]), "binary"), F.udf(lambda u: None if u in body else "HTTPError: 404", "string")
        return rows.select("*", content("url").alias("content"), error("url").alias("error"))

    return ask, fetch


def test_web_inputs(spark, tmp_path):
    ask, fetch = stubs()
    out = run_batch(spark, list(TYPES), fast, RunOptions(output=f"{tmp_path}/out/"), ask=ask, fetch=fetch)
    got = {r.pos: r for r in out.collect()}
    assert [got[i].kind for i in range(5)] == ["image_url", "html_url", "html_url", "html_url", "image_url"]
    assert [got[i].output for i in range(5)] == ["a_ocr.txt", "big_news_ocr.txt", "h_example_ocr.txt", None, None]
    assert got[1].text.startswith("first line of width 70") and got[3].error == "no image on the page" and "404" in got[4].error
    assert sorted(os.listdir(tmp_path / "out")) == ["a_ocr.txt", "big_news_ocr.txt", "h_example_ocr.txt"]
    assert (tmp_path / "out" / "a_ocr.txt").read_text() == got[0].text


def test_content_type_is_asked_twice():
    seen = []

    def first_fails(address, method, headers, timeout):
        seen.append((method, headers))
        if method == "HEAD":
            raise urllib.error.URLError("no")
        return "Image/PNG"

    assert reading.content_type("http://h/x", ask=first_fails) == "image/png"
    assert seen == [("HEAD", {}), ("GET", {"Range": "bytes=0-0"})]
    assert reading.content_type("http://h/x", ask=lambda *a: "") == ""


def test_exact_file_and_patterns(spark, tmp_path):
    for name in ("b.bmp", "a.bmp"):
        (tmp_path / name).write_bytes(bitmap(40, 20))
    out = run_batch(spark, [str(tmp_path / "a.bmp")], fast, RunOptions(output=str(tmp_path / "exact.txt"))).collect()
    assert out[0].output == "exact.txt" and (tmp_path / "exact.txt").read_text().startswith("first line")
    rows = reading.arguments(spark, [f"{tmp_path}/*.bmp", "no*such", "x://y"]).collect()
    assert [(os.path.basename(r.arg), r.is_file) for r in rows] == [("a.bmp", True), ("b.bmp", True), ("no*such", False), ("y", False)]
    with pytest.raises(ValueError, match="need a folder"):
        output_of(RunOptions(output=str(tmp_path / "exact.txt")), 2)
    assert output_of(RunOptions(), 3) == ("texts", None) and output_of(RunOptions(output=str(tmp_path)), 1) == (str(tmp_path), None)


def test_thorough_engine(spark, tmp_path):
    (tmp_path / "tall.bmp").write_bytes(bitmap(20, 50))
    arg, opts = [str(tmp_path / "tall.bmp")], RunOptions(output=f"{tmp_path}/o/")
    assert [(r.engine, r.text) for r in run_batch(spark, arg, fast, opts, lambda: thorough).collect()] == [("secondary", "Read\nagain in full")]

    def broken():
        raise OSError("no such model")

    with pytest.warns(UserWarning, match="no such model") as seen:
        got = run_batch(spark, arg * 2, fast, opts, broken).collect()
    assert [r.engine for r in got] == ["primary"] * 2 and len([w for w in seen if "no such model" in str(w.message)]) == 1
    with pytest.raises(RuntimeError, match="structured"), pytest.warns(UserWarning):
        run_batch(spark, arg, fast, RunOptions(output=f"{tmp_path}/o/", structured=True), broken)


def test_aligned_lists(spark):
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    schema = "path string, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<struct<x:double,y:double>>>"
    pages = spark.createDataFrame([("p", ["a", "b"], [0.9, 0.5], [box, box]), ("none", [], [], [])], schema)
    assert [(r.path, r.pos, r.text, r.score, r.quad[2].x) for r in layout.lines_of(pages).collect()] == [("p", 0, "a", 0.9, 1.0), ("p", 1, "b", 0.5, 1.0)]
    with pytest.raises(Exception, match="differ in length: 2, 1, 2"):
        layout.lines_of(spark.createDataFrame([("p", ["a", "b"], [0.9], [box, box])], schema)).collect()


def test_registry(tmp_path):
    assert registry.model_files("q4")[0].endswith("q4.onnx") and len(registry.all_files()) == len(set(registry.all_files()))
    with pytest.raises(ValueError, match="q8, q4"):
        registry.model_files("q5")
    files = registry.model_files()
    for f in files:
        if f != "config.json":
            (tmp_path / "beside" / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "beside" / f).write_bytes(b"")
    beside = str(tmp_path / "beside")
    assert registry.find_folder(files, beside=("/nowhere", beside)) == registry.Folder(beside, True)
    with pytest.raises(FileNotFoundError, match="lacks"):
        registry.find_folder(files, str(tmp_path))
    for revision in (None, "main", "a" * 39, "g" * 40):
        with pytest.raises(ValueError, match="40"):
            registry.find_folder(files, cache=beside, revision=revision)
    assert registry.find_folder(files, cache=beside, revision="0123456789abcdef" * 2 + "01234567") == registry.Folder(beside, False)
    with pytest.raises(FileNotFoundError):
        registry.find_folder(files, cache=str(tmp_path), revision="a" * 40)


def test_options_and_threads():
    given = cli.parser().parse_args(["a.png", "-o", "x", "--model-dir", "m", "--min-quality", "0.5", "--langs", "en, fr"])
    assert given.min_quality == 0.5 and given.inputs == ["a.png"]
    for bad in (["a", "--model-dir", "m", "--min-quality", "2"], ["a", "--model-dir", "m", "--vision", "q5"], ["a"], ["--model-dir", "m"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    with pytest.raises(ValueError):
        RunOptions(max_tokens=0)
    assert engine.threads_for("alone", 4) == 4 and engine.threads_for("beside", 4) == 1 and engine.threads_for("alone", 0) == 1
    with pytest.raises(ValueError):
        engine.threads_for("other")


def test_numbered(spark):
    rows = spark.createDataFrame([("a", i % 7, i) for i in range(200)] + [("b", 1, 500), (None, 0, 600), (None, 2, 601)], "stem string, pos long, n long").repartition(5)
    got = joins.numbered(rows, [F.col("pos"), F.col("n")], "no", ["stem"]).collect()
    for stem in ("a", "b", None):
        own = sorted((r for r in got if r.stem == stem), key=lambda r: r.no)
        assert [r.no for r in own] == list(range(1, len(own) + 1)) and [(r.pos, r.n) for r in own] == sorted((r.pos, r.n) for r in own)
    assert sorted(r.no for r in joins.numbered(rows, [F.col("n")], "no").collect()) == list(range(1, 204))
    assert joins.numbered(rows.limit(0), [F.col("n")], "no", ["stem"]).count() == 0


def test_manifests_of_folders(spark, tmp_path):
    import hashlib

    for name, data in (("one/det/a.onnx", b"a"), ("one/b.yml", b"b"), ("two/c.json", b"c")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    digest = {d: hashlib.sha256(d.encode()).hexdigest() for d in "abc"}
    rows = integrity.models_manifest(spark, {"first @ 1": str(tmp_path / "one"), "second @ 2": f"{tmp_path}/two/"}).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == list(enumerate(["# first @ 1", f"{digest['b']}  b.yml", f"{digest['a']}  det/a.onnx", "# second @ 2", f"{digest['c']}  c.json"]))
    assert [r.line for r in integrity.models_manifest(spark, {"t": str(tmp_path / "one")}, ["b.yml"]).orderBy("line_no").collect()] == ["# t", f"{digest['b']}  b.yml"]
    (tmp_path / "two" / "model_checksums.sha256").write_text("x")
    assert integrity.find_manifest([str(tmp_path / "one"), str(tmp_path / "two")]) == str(tmp_path / "two" / "model_checksums.sha256")
    assert integrity.find_manifest([str(tmp_path / "one")]) is None


def test_links_of_any_spelling(spark):
    pages = spark.createDataFrame([(1, "http://h/x", "<A class=q HREF='/one'>x</A><a>no</a><a title=\"a>b\" href=two>y</a><abbr href=z>")], "page_id long, url string, html string")
    assert [r.href for r in images.links(pages).orderBy("idx").collect()] == ["/one", "two"]


def test_a_closed_table_has_no_rows():
    import numpy as np

    with wire.RowTable(np.ones((3, 2), np.float32)) as rows:
        assert rows.lookup([2]).tolist() == [[1.0, 1.0]]
    with pytest.raises(ValueError):
        rows.lookup([0])
