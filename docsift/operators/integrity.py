"""Checksum manifests: reading, merging, verifying, writing; sets of model files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import WS, strip
from docsift.plans.joins import numbered, settled, small_side

HEX64 = r"\A[0-9a-f]{64}\z"


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(name, sha256) from (line_no, line): blank and # lines skipped, the last entry of a name wins."""
    t = strip(F.col("line"))
    parts = lines.select("line_no", t.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    digest = F.lower(F.regexp_extract("t", rf"\A([^{WS}]+)", 1))
    name = F.regexp_replace(F.regexp_extract("t", rf"(?s)\A[^{WS}]+[{WS}]+(.*)\z", 1), r"\A\*+", "")
    rows = parts.select("line_no", digest.alias("sha256"), name.alias("name")).where("name <> ''")
    return rows.groupBy("name").agg(F.max_by("sha256", "line_no").alias("sha256"))


def merge_manifests(embedded: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, sha256, origin): the manifest wins over what is embedded, and drops nothing."""
    e, m = embedded.select("name", F.col("sha256").alias("e")), manifest.select("name", F.col("sha256").alias("m"))
    origin = F.when(F.col("m").isNotNull(), F.lit("manifest")).otherwise(F.lit("embedded"))
    return e.join(m, "name", "full").select("name", F.coalesce("m", "e").alias("sha256"), origin.alias("origin"))


def verify(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, actual, expected, status): files (name, actual) against digests; files without one are skipped."""
    joined = files.join(small_side(pinned.select("name", F.lower("sha256").alias("expected"))), "name", "left")
    status = F.when(F.col("expected").isNull(), "skipped").when(~F.col("expected").rlike(HEX64), "malformed").when(F.col("actual") == F.col("expected"), "verified").otherwise("mismatch")
    return joined.withColumn("status", status)


def assert_verified(checked: DataFrame) -> int:
    """Number of verified files; an error if any digest is malformed or unequal."""
    got = {r["status"]: r["count"] for r in checked.groupBy("status").count().collect()}
    bad = {k: n for k, n in got.items() if k in ("malformed", "mismatch")}
    if bad:
        raise ValueError(f"integrity check failed: {bad}")
    return got.get("verified", 0)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, actual) of the files below a folder, named by their path in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.substring_index("path", f"{folder.rstrip('/')}/", -1).alias("name"), F.sha2("content", 256).alias("actual"))


def manifest_lines(files: DataFrame, header: str | None = None) -> DataFrame:
    """(line_no, line) of a manifest: a comment, then digest, two blanks and name, in order of names."""
    rows = numbered(files.select("name", "actual"), [F.col("name"), F.col("actual")], "line_no").select("line_no", F.concat_ws("  ", "actual", "name").alias("line"))
    if header is None:
        return rows
    first = files.sparkSession.createDataFrame([(0, f"# {header}")], "line_no long, line string")
    return first.unionByName(rows)


def models_manifest(spark: SparkSession, folders: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """(line_no, line) of one manifest of several model folders, by title: each a comment and the lines of its files.

    wanted: the names to list; all by default. A title is a source and its pinned revision.
    """
    out, at = None, 0
    for title, folder in folders.items():
        files = file_digests(spark, folder)
        files = settled(files if wanted is None else files.where(F.col("name").isin(wanted)))
        part = manifest_lines(files, title).withColumn("line_no", F.col("line_no") + at)
        out, at = part if out is None else out.unionByName(part), at + files.count() + 1
    if out is None:
        raise ValueError("no model folder is given")
    return out


def find_manifest(folders: list[str], name: str = "model_checksums.sha256") -> str | None:
    """The first of the folders' manifests that is there."""
    return next((path for path in (os.path.join(folder, name) for folder in folders) if os.path.isfile(path)), None)


def complete_sets(required: DataFrame, present: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """(folder, variant, complete): folders that hold every required file. required: variant, file; present: folder, file."""
    need = required.where(~F.col("file").isin(*optional)) if optional else required
    sizes = need.groupBy("variant").agg(F.count_distinct("file").alias("n"))
    have = present.select("folder", "file").distinct().join(need.select("variant", "file").distinct(), "file").groupBy("folder", "variant").agg(F.count("*").alias("have"))
    # the variants are a short fixed list
    every = present.select("folder").distinct().join(F.broadcast(sizes), F.lit(True))
    return every.join(have, ["folder", "variant"], "left").select("folder", "variant", (F.coalesce("have", F.lit(0)) == F.col("n")).alias("complete"))


def layer_index(name: Column) -> Column:
    """The first .N. of a tensor name, -1 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"\.(\d+)\.", 1).try_cast("int"), F.lit(-1))


def pair_caches(names: DataFrame) -> DataFrame:
    """(layer, kind, past, present): inputs and outputs of a decoder by layer number and key or value.

    names: name, one row per tensor. A layer that lacks a side shows as null.
    """
    kind = F.when(F.col("name").contains("value"), "value").otherwise("key")
    rows = names.select("name", layer_index(F.col("name")).alias("layer"), kind.alias("kind"))
    past = rows.where(F.col("name").startswith("past")).select("layer", "kind", F.col("name").alias("past"))
    present = rows.where(F.col("name").startswith("present")).select("layer", "kind", F.col("name").alias("present"))
    return past.join(present, ["layer", "kind"], "full")
