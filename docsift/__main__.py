"""python -m docsift INPUT... : texts of images, addresses and folders' patterns, one file each."""

from __future__ import annotations

import argparse
import sys

from docsift.models import registry
from docsift.operators.routing import MIN_QUALITY


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("docsift", description=__doc__)
    p.add_argument("inputs", nargs="+", help="image files, patterns, http(s) addresses of images or pages")
    p.add_argument("-o", "--output", help="a file for one input, a folder for several")
    p.add_argument("--min-quality", type=_quality, default=MIN_QUALITY, help="pages below are read again by the thorough engine; 0: never")
    p.add_argument("--langs", default="en", help="languages of the dictionary check, comma-separated")
    p.add_argument("--lexicon", help="Parquet of lang, word, zipf; without it every word counts as known")
    p.add_argument("--model-dir", required=True, help="folder with lines/det and lines/rec that all executors share")
    p.add_argument("--vision", choices=sorted(registry.VISION), default=registry.DEFAULT_VISION)
    p.add_argument("--max-tokens", type=int, default=2048)
    p.add_argument("--max-pixels", type=int, default=1_003_520)
    p.add_argument("--plaintext", action="store_true")
    p.add_argument("--strict", action="store_true", help="fail at the first input that fails")
    return p


def _quality(text: str) -> float:
    value = float(text)
    if not 0.0 <= value <= 1.0:
        raise argparse.ArgumentTypeError(f"not a quality between 0 and 1: {text}")
    return value


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from docsift.models import engine
    from docsift.plans.run import RunOptions, run_batch
    from docsift.sources.inputs import parse_parameters

    spark = SparkSession.builder.appName("docsift").getOrCreate()
    folder = registry.find_folder(tuple(f"lines/{f}" for f in registry.LINES), given.model_dir).path
    with open(f"{folder}/lines/rec/inference.yml", encoding="utf-8") as f:
        characters = parse_parameters(f.read()).get("character_dict", [])
    options = RunOptions(min_quality=given.min_quality, langs=tuple(x.strip() for x in given.langs.split(",") if x.strip()) or ("en",), plaintext=given.plaintext, strict=given.strict, output=given.output, vision=given.vision, model_dir=given.model_dir, max_tokens=given.max_tokens, max_pixels=given.max_pixels)
    lexicon = spark.read.parquet(given.lexicon) if given.lexicon else None
    out = run_batch(spark, given.inputs, lambda images: engine.read_pages(images, f"{folder}/lines/det/inference.onnx", f"{folder}/lines/rec/inference.onnx", characters), options, lexicon=lexicon)
    rows = out.select("pos", "output", "error").orderBy("pos").collect()
    for r in rows:
        print(r.output if r.error is None else f"FAILED {given.inputs[r.pos] if len(given.inputs) == len(rows) else r.pos}: {r.error}", file=sys.stdout if r.error is None else sys.stderr)
    bad = sum(r.error is not None for r in rows)
    if bad:
        print(f"{bad} of {len(rows)} inputs failed", file=sys.stderr)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
