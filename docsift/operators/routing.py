"""Routing between a fast recognizer and a thorough one, names of outputs, and failures that stay with their row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import to_plaintext
from docsift.plans.joins import numbered

MIN_QUALITY = 0.8


def check_quality(value: Column) -> Column:
    """A threshold from 0 to 1, or an error."""
    number = F.expr("try_cast(NULL AS double)") if value is None else value.try_cast("double")
    return F.when(number.between(0.0, 1.0), number).otherwise(F.raise_error(F.concat(F.lit("not a quality between 0 and 1: "), value.cast("string"))).cast("double"))


def keeps_primary(quality: Column, min_quality: float | Column = MIN_QUALITY) -> Column:
    least = min_quality if isinstance(min_quality, Column) else F.lit(float(min_quality))
    return (least <= 0) | (quality >= least)


def route(primary: DataFrame, secondary: Callable[[DataFrame], DataFrame] | None, key: str, min_quality: float = MIN_QUALITY, structured: bool = False, plaintext: bool = False) -> DataFrame:
    """(key, text, engine): the fast result where its quality suffices, the thorough one elsewhere.

    primary: key, text, quality; should be written or persisted, as both branches read it. secondary gets the rows it
    has to read and returns key and text; a key it does not return, or returns with a null text, keeps the fast result.
    Results of the fallback are flattened; structured runs use the thorough engine alone and flatten only on request.
    """
    if structured:
        out = secondary(primary)
        return out.select(key, (to_plaintext(F.col("text")) if plaintext else F.col("text")).alias("text"), F.lit("secondary").alias("engine"))
    kept = primary.where(keeps_primary(F.col("quality"), min_quality)).select(key, "text", F.lit("primary").alias("engine"))
    low = primary.where(~keeps_primary(F.col("quality"), min_quality))
    if secondary is None:
        return kept.unionByName(low.select(key, "text", F.lit("primary").alias("engine")))
    read = secondary(low).select(F.col(key).alias("__key"), to_plaintext(F.col("text")).alias("__text"))
    joined = low.join(read, F.col(key) == F.col("__key"), "left")
    engine = F.when(F.col("__text").isNotNull(), F.lit("secondary")).otherwise(F.lit("primary"))
    return kept.unionByName(joined.select(key, F.coalesce("__text", "text").alias("text"), engine.alias("engine")))


def output_names(done: DataFrame, stem: str = "stem", pos: str = "pos", folder: str = "", suffix: str = "_ocr") -> DataFrame:
    """Adds path: stem_ocr.txt, then stem_ocr_2.txt and so on in input order. Failed rows must be gone already.

    Any number of rows may share a stem: places go by ranges of stem and pos, not by a task per stem.
    """
    placed = numbered(done, [F.col(pos)], "__no", [stem])
    no = F.col("__no")
    name = F.concat(F.col(stem), F.lit(suffix), F.when(no > 1, F.concat(F.lit("_"), no.cast("string"))).otherwise(F.lit("")), F.lit(".txt"))
    return placed.withColumn("path", F.concat(F.lit(f"{folder.rstrip('/')}/" if folder else ""), name)).drop("__no")


def failure_text(error: Column, kind: Column | None = None) -> Column:
    """Message of a failure without the tool's prefix; other kinds of errors are named."""
    bare = F.regexp_replace(error, r"\A\[[a-z]+\] ", "")
    return bare if kind is None else F.when(kind == "SystemExit", bare).otherwise(F.concat(kind, F.lit(": "), bare))


def batch_status(results: DataFrame) -> DataFrame:
    """(n_failed, n_total, status): status 1 if any row has an error."""
    failed, total = F.count_if(F.col("error").isNotNull()), F.count("*")
    return results.agg(failed.alias("n_failed"), total.alias("n_total"), F.when(failed > 0, 1).otherwise(0).alias("status"))
