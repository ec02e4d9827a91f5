"""A whole run: arguments in, named text files out."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.models import registry
from docsift.plans.joins import shared_dir
from docsift.plans.process import Options, process
from docsift.sources import inputs, reading
from docsift.sources.sinks import write_texts


@dataclass(frozen=True)
class RunOptions(Options):
    """Options of a run. output: a file for one input, else a folder; vision, model_dir, verify: which models are used;
    max_tokens and max_pixels: bounds of the thorough engine."""

    output: str | None = None
    vision: str = registry.DEFAULT_VISION
    model_dir: str | None = None
    verify: bool = True
    max_tokens: int = 2048
    max_pixels: int = 1_003_520

    def __post_init__(self) -> None:
        super().__post_init__()
        registry.model_files(self.vision)
        if min(self.max_tokens, self.max_pixels) < 1:
            raise ValueError("max_tokens and max_pixels must be 1 or more")


#: Folder of results where none is named.
DEFAULT_FOLDER = "texts"


def output_of(options: RunOptions, count: int) -> tuple[str, str | None]:
    """(folder, file name or None): one input may name its file, several need a folder."""
    given = options.output
    if given and count > 1 and os.path.isfile(given):
        raise ValueError(f"{count} inputs need a folder, and {given} is a file")
    if given and count == 1 and not os.path.isdir(given) and not given.endswith("/"):
        return os.path.dirname(given) or ".", os.path.basename(given)
    return given or options.folder or DEFAULT_FOLDER, None


def with_fallback(secondary: Callable[[], Callable[[DataFrame], DataFrame]] | None) -> Callable[[DataFrame], DataFrame] | None:
    """The thorough engine, made once; None with one warning if it cannot be loaded: fast results stay then."""
    if secondary is None:
        return None
    try:
        return secondary()
    except Exception as e:  # of any kind: it is a second opinion, no requirement
        warnings.warn(f"the thorough engine is not available ({e or type(e).__name__}); fast results stay", stacklevel=2)
        return None


def run_batch(spark: SparkSession, args: list[str], read: Callable[[DataFrame], DataFrame], options: RunOptions = RunOptions(), secondary: Callable[[], Callable[[DataFrame], DataFrame]] | None = None, lexicon: DataFrame | None = None, ask: Callable = reading._answer, fetch: Callable[[DataFrame], DataFrame] = inputs.fetch) -> DataFrame:
    """(pos, kind, stem, engine, output, text, error) of every input, written below the output folder.

    read: the fast engine, from images (path, height, width, channels, data) to lines. secondary: makes the thorough one.
    """
    work = os.path.join(shared_dir(spark), "inputs")
    os.makedirs(work, exist_ok=True)
    rows, images = reading.load_inputs(spark, args, work, ask, fetch)
    lines = read(images).persist()
    folder, name = output_of(options, rows.count())
    failed = lines.where("error IS NOT NULL").groupBy(F.col("path").alias("__bad")).agg(F.first("error").alias("__why"))
    rows = rows.join(failed, F.col("path") == F.col("__bad"), "left").withColumn("error", F.coalesce("error", "__why")).drop("__bad", "__why")
    engine = with_fallback(secondary)
    if options.structured and engine is None:
        raise RuntimeError("structured output needs the thorough engine")
    done = process(rows, lines.where("error IS NULL").drop("error"), replace(options, folder=""), lexicon, engine).persist()
    named = done.withColumn("output", F.when(F.col("error").isNull(), F.lit(name) if name else F.col("output")))
    written = write_texts(named.where("error IS NULL").select("pos", F.col("output").alias("path"), "text"), folder)
    written = written.select(F.col("pos").alias("__pos"), F.col("error").alias("__unwritten"))
    out = named.join(written, F.col("pos") == F.col("__pos"), "left").withColumn("error", F.coalesce("error", "__unwritten"))
    return out.join(rows.select("pos", "kind", "stem"), "pos").select("pos", "kind", "stem", "engine", "output", "text", "error")
