"""A batch from inputs to named text files, with failures kept in their rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators import layout, quality, routing


@dataclass(frozen=True)
class Options:
    """What a run may choose. folder: where texts go; langs: languages of the dictionary check."""

    folder: str = ""
    min_quality: float = routing.MIN_QUALITY
    langs: tuple[str, ...] = ("en",)
    structured: bool = False
    plaintext: bool = False
    strict: bool = False

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_quality <= 1.0:
            raise ValueError(f"min_quality must be between 0 and 1: {self.min_quality}")


def pages_of(lines: DataFrame, page: str = "path") -> DataFrame:
    """(page, text): lines (page, pos, text, quad) in reading order."""
    items = F.array_sort(F.collect_list(F.struct("pos", "quad", "text")))
    return lines.groupBy(page).agg(items.alias("items")).select(page, layout.assemble_lines(F.col("items")).alias("text"))


def process(inputs: DataFrame, lines: DataFrame, options: Options = Options(), lexicon: DataFrame | None = None, secondary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(pos, path, text, engine, output, error) of every input.

    inputs: pos, path, stem, error (null unless reading failed); lines: path, pos, text, score, quad of the fast
    recognizer. Failed inputs get no output name and use up none. With strict, the first error is raised.
    """
    langs = F.array(*[F.lit(x) for x in options.langs])
    judged = quality.judge_lines(lines.where("text IS NOT NULL").withColumnRenamed("pos", "line"), ["path", "line"], lexicon, langs)
    scored = quality.page_quality(judged, ["path"]).select("path", "quality")
    texts = pages_of(lines.where("text IS NOT NULL"))
    good = inputs.where("error IS NULL").select("path").distinct()
    primary = good.join(texts, "path", "left").join(scored, "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("quality", F.lit(0.0)).alias("quality"))
    primary = primary.persist()  # both branches of the routing read it
    routed = routing.route(primary, secondary, "path", options.min_quality, options.structured, options.plaintext)
    results = inputs.join(routed, "path", "left").withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), F.lit("no result"))))
    named = routing.output_names(results.where("error IS NULL").select("pos", "stem"), folder=options.folder).select("pos", F.col("path").alias("output"))
    out = results.join(named, "pos", "left").select("pos", "path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "engine", "output", "error")
    if options.strict:
        first = out.where("error IS NOT NULL").orderBy("pos").select("error").head()
        if first:
            raise RuntimeError(first.error)
    return out
