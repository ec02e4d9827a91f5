"""What an input argument is, and reading it: files, images, manifests, ground truths, bytes behind URLs."""

from __future__ import annotations

import glob
import os
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X

INPUT_SCHEMA = "pos long, arg string"


def classify(arg: Column, content_type: Column, is_file: Column) -> Column:
    """clipboard, file, image_url or html_url; null for what is neither a file nor an http(s) address."""
    scheme = F.lower(F.try_parse_url(arg, F.lit("PROTOCOL")))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.regexp_extract(arg, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    extension = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    web = F.when(kind.startswith("image/"), "image_url").when(kind.contains("html") | kind.contains("xml"), "html_url").when(extension.isin(*X.IMAGE_EXTENSIONS), "image_url").otherwise("html_url")
    return F.when(arg.isNull(), "clipboard").when(is_file, "file").when(scheme.isin("http", "https"), web)


def url_stem(url: Column, default: str = "image") -> Column:
    """Last part of an address' path, percent-decoded, without its suffix."""
    stem = X.path_stem(X.percent_decoded(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)))
    return F.when(stem == "", F.lit(default)).otherwise(stem)


def expand_inputs(spark: SparkSession, args: list[str]) -> DataFrame:
    """(pos, arg): patterns become their files, sorted; addresses, existing paths and unmatched patterns stay."""
    out: list[str] = []
    for arg in args:
        found = []
        if any(ch in arg for ch in "*?[") and "://" not in arg and not os.path.exists(arg):
            found = sorted(p for p in glob.glob(arg, recursive=True) if os.path.isfile(p))
        out += found or [arg]
    return spark.createDataFrame(list(enumerate(out)), INPUT_SCHEMA)


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, stem, height, width, channels, data): rows of BGR bytes."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path)
    return rows.select(F.col("image.origin").alias("path"), X.path_stem(F.col("image.origin")).alias("stem"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(stem, truth) of text files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.select(X.path_stem(X.percent_decoded(F.col("path"))).alias("stem"), X.strip(F.col("value")).alias("truth"))


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file; a manifest is one small file, so its lines keep their order in one array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


def fetch(urls: DataFrame, url: str = "url", timeout: float = 60.0, agent: str = "docsift") -> DataFrame:
    """urls with content and error: the bytes of each address. Failures stay in their rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content, errors = [], []
            for address in frame[url]:
                try:
                    request = urllib.request.Request(address, headers={"User-Agent": agent})
                    with urllib.request.urlopen(request, timeout=timeout) as reply:
                        content.append(reply.read())
                    errors.append(None)
                except Exception as e:  # of any kind: it is reported with its row
                    content.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(content=content, error=errors)

    fields = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes)
    return urls.mapInPandas(run, f"{fields}, content binary, error string")


def parse_parameters(text: str) -> dict[str, str | list[str]]:
    """Scalars and lists of the PostProcess block of a model's parameter file, a small part of YAML."""
    out: dict[str, str | list[str]] = {}
    inside, target = False, None
    for line in text.splitlines():
        bare = line.strip(" \t\r")
        if bare in ("",) or bare[0] == "#":
            continue
        depth = len(line) - len(line.lstrip(" "))
        if depth == 0:
            inside, target = bare == "PostProcess:", None
        elif inside and target is not None and (bare == "-" or bare[:2] == "- "):
            target.append(plain_scalar(bare[2:]))
        elif inside and depth <= 2:
            name, colon, value = bare.partition(":")
            if colon and name.replace("_", "a").isalnum() and not name[0].isdigit() and (not value or value[0].isspace()):
                value = value.strip()
                target = None if value else []
                out[name] = plain_scalar(value) if value else target
    return out


def plain_scalar(value: str) -> str:
    """Unquoted scalar; only ASCII blanks are trimmed."""
    import json

    value = value.strip(" \t\r\n")
    if len(value) < 2 or value[0] != value[-1] or value[0] not in "'\"":
        return value
    if value[0] == "'":
        return value[1:-1].replace("''", "'")
    try:
        return json.loads(value)
    except ValueError:
        return value[1:-1]


def parameters(files: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """files (name, text) with one column per default, its value if it is a number of that kind, and characters."""

    @F.pandas_udf("map<string,array<string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: {k: v if isinstance(v, list) else [v] for k, v in parse_parameters(t or "").items()})

    rows = files.withColumn("__p", parsed("text"))
    columns = [F.coalesce(F.get(F.col("__p")[k], F.lit(0)).try_cast("double" if isinstance(v, float) else "int"), F.lit(v)).alias(k) for k, v in defaults.items()]
    return rows.select("name", *columns, F.coalesce(F.col("__p")["character_dict"], F.array().cast("array<string>")).alias("characters"))
