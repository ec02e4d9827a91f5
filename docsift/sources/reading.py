"""From arguments to images: what each is, its bytes, its name; failures stay in their rows."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators import images
from docsift.sources import inputs

IMAGE_COLUMNS = ["height", "width", "channels", "data"]


def _answer(address: str, method: str, headers: dict[str, str], timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(address, method=method, headers=headers), timeout=timeout) as reply:
        return reply.headers.get("Content-Type") or ""


def content_type(address: str, timeout: float = 15.0, ask: Callable = _answer) -> str:
    """What a server says an address holds: by its head, else by asking for a single byte; empty if neither tells."""
    for method, headers in (("HEAD", {}), ("GET", {"Range": "bytes=0-0"})):
        try:
            found = ask(address, method, headers, timeout)
        except (urllib.error.URLError, OSError, ValueError):
            continue
        if found:
            return found.lower()
    return ""


def probe(rows: DataFrame, ask: Callable = _answer) -> DataFrame:
    """rows (pos, arg, is_file) with content_type and kind; web addresses are asked for, in the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            web = frame["arg"].fillna("").str.contains(r"^https?://", case=False)
            yield frame.assign(content_type=[content_type(a, ask=ask) if w else None for a, w in zip(frame["arg"], web, strict=True)])

    asked = rows.mapInPandas(run, "pos long, arg string, is_file boolean, content_type string")
    return asked.withColumn("kind", inputs.classify(F.col("arg"), F.col("content_type"), F.col("is_file")))


def arguments(spark: SparkSession, args: list[str]) -> DataFrame:
    """(pos, arg, is_file) of the arguments with patterns expanded, by the file system that each path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, bool]] = []
    for arg in args:
        if arg.lower().startswith(("http://", "https://")):
            out.append((arg, False))
            continue
        path = jvm.org.apache.hadoop.fs.Path(arg if "://" in arg else "file://" + os.path.abspath(arg))
        try:
            found = path.getFileSystem(conf).globStatus(path)
        except Exception:  # a scheme without a file system, a broken pattern: reported with its row
            found = None
        files = sorted(s.getPath().toString() for s in found or () if s.isFile())
        out += [(f, True) for f in files] or [(arg, False)]
    return spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(out)], "pos long, arg string, is_file boolean")


def _decoded(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, height, width, channels, data) of the files that are images."""
    if not files:
        return spark.createDataFrame([], "path string, height int, width int, channels int, data binary")
    return inputs.read_images(spark, files).select("path", *IMAGE_COLUMNS)


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """rows (pos, content) as files in the shared folder, for the image reader: (pos, path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = []
            for pos, content in zip(frame["pos"], frame["content"], strict=True):
                path = os.path.join(folder, f"{pos}.bin")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"pos": frame["pos"], "path": paths})

    return rows.where("content IS NOT NULL").select("pos", "content").mapInPandas(run, "pos long, path string")


def page_images(pages: DataFrame) -> DataFrame:
    """(pos, url, stem): the most prominent image of each page (pos, url, html), named by its title, or its host if that
    is empty. Images without a declared size are not measured here: the first counts."""
    candidates = images.image_candidates(pages.select(F.col("pos").alias("page_id"), "url", "html"))
    chosen = images.prominent_image(candidates, candidates.select("page_id", "src", F.lit(0).alias("pixels"))).select(F.col("page_id").alias("__page"), "src")
    title = X.strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    named = F.when(title == "", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).otherwise(title)
    return pages.join(chosen, F.col("pos") == F.col("__page")).select("pos", images.url_join("url", "src").alias("url"), X.slug(named).alias("stem"))


def load_inputs(spark: SparkSession, args: list[str], folder: str, ask: Callable = _answer, fetch: Callable[[DataFrame], DataFrame] = inputs.fetch) -> tuple[DataFrame, DataFrame]:
    """(inputs, images): pos, path, stem, kind, error of every argument, and path with its image.

    folder, shared by all executors, takes the bytes that come from the web. Arguments are a driver's list, so what is
    known of each is gathered there; image bytes are not.
    """
    known = {r.pos: r for r in probe(arguments(spark, args), ask).collect()}
    path, stem, error = {p: r.arg for p, r in known.items()}, {}, {}
    web = [(p, r.arg) for p, r in known.items() if r.kind in ("image_url", "html_url")]
    for p, r in known.items():
        if r.kind is None:
            error[p] = f"{r.arg} is neither a file nor a web address"
    if web:
        got = fetch(spark.createDataFrame(web, "pos long, url string")).persist()
        error |= {r.pos: r.error for r in got.where("error IS NOT NULL").select("pos", "error").collect()}
        html = [p for p, r in known.items() if r.kind == "html_url"]
        pages = got.where(F.col("pos").isin(html) & F.col("error").isNull()).select("pos", "url", F.decode("content", "UTF-8").alias("html"))
        chosen = {r.pos: r for r in page_images(pages).collect()} if html else {}
        error |= {p: "no image on the page" for p in html if p not in chosen and p not in error}
        ready = got.where(~F.col("pos").isin(html)).select("pos", "content")
        if chosen:
            second = fetch(spark.createDataFrame([(p, r.url) for p, r in chosen.items()], "pos long, url string")).persist()
            error |= {r.pos: r.error for r in second.where("error IS NOT NULL").select("pos", "error").collect()}
            ready = ready.unionByName(second.select("pos", "content"))
            stem |= {p: r.stem for p, r in chosen.items()}
        path |= {r.pos: r.path for r in stored(ready, folder).collect()}
    local = {p: a for p, a in path.items() if p not in error}
    images_ = _decoded(spark, sorted(set(local.values())))
    rows = spark.createDataFrame([(p, path[p], r.arg, r.kind, stem.get(p), error.get(p)) for p, r in known.items()], "pos long, path string, arg string, kind string, stem string, error string")
    named = F.when(F.col("kind") == "file", X.path_stem(X.percent_decoded(F.col("path")))).when(F.col("kind").isNotNull(), inputs.url_stem(F.col("arg")))
    bare = F.regexp_replace("path", "^file:/*", "/")
    seen = images_.select(F.regexp_replace("path", "^file:/*", "/").alias("__seen"), F.col("path").alias("__path")).distinct()
    rows = rows.join(seen, bare == F.col("__seen"), "left")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("__path").isNull(), F.lit("not an image"))))
    return rows.select("pos", F.coalesce("__path", "path").alias("path"), F.coalesce("stem", named).alias("stem"), "kind", "error"), images_
