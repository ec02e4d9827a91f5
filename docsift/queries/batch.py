"""The whole run as a query, and queries over what it is made of. Engines are stood in for by rules on image sizes."""

from __future__ import annotations

import os
import struct
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import sequences as Q
from docsift.functions import text as X
from docsift.functions.geometry import point
from docsift.models import registry
from docsift.operators import integrity, layout
from docsift.plans.joins import shared_dir
from docsift.plans.run import RunOptions, run_batch
from docsift.queries import sql as S
from docsift.queries.sql import table

#: (file, width, height) of the images that the run reads.
IMAGES = [("page.bmp", 40, 20), ("sub/page.bmp", 60, 20), ("tall.bmp", 20, 50), ("late/page.bmp", 80, 20)]
LISTS = ["en", " fr , de,", "", ",", "fr,fr"]
SYMBOLS = [(1, ["a", "b"], 3), (2, ["a", "b"], 4), (3, [], 1), (4, [], 2)]


def bitmap(width: int, height: int) -> bytes:
    """A white picture as an uncompressed bitmap file."""
    row = b"\xff" * (width * 3) + b"\0" * (-width * 3 % 4)
    return b"BM" + struct.pack("<IHHI", 54 + len(row) * height, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(row) * height, 0, 0, 0, 0) + row * height


def fast(images: DataFrame) -> DataFrame:
    """Two lines a picture: a wide one holds words, a tall one strokes."""
    good = F.col("width") >= F.col("height")
    lines = F.array(*[F.struct(F.lit(i).alias("pos"), F.when(good, F.concat(F.lit(words), F.col("width").cast("string"))).otherwise(F.lit("|||")).alias("text"), F.lit(0.95).alias("score"), F.array(*[point(F.lit(x), F.lit(y + 30 * i)) for x, y in ((0, 0), (50, 0), (50, 10), (0, 10))]).alias("quad")) for i, words in enumerate(("first line of width ", "second line of width "))])
    return images.select("path", F.inline(lines)).withColumn("error", F.lit(None).cast("string"))


def thorough(low: DataFrame) -> DataFrame:
    return low.select("path", F.lit("# Read\n**again** in full").alias("text"))


def batch_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, a file that is none, a missing file and an unknown argument through the whole run."""
    folder = os.path.join(shared_dir(spark), "pictures")
    for name, width, height in IMAGES:
        os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        with open(os.path.join(folder, name), "wb") as out:
            out.write(bitmap(width, height))
    with open(os.path.join(folder, "notes.bmp"), "w", encoding="utf-8") as out:
        out.write("no picture")
    args = [os.path.join(folder, "page.bmp"), os.path.join(folder, "sub", "*.bmp"), os.path.join(folder, "tall.bmp"), os.path.join(folder, "notes.bmp"), "nowhere.bmp", os.path.join(folder, "late", "page.bmp")]
    out = run_batch(spark, args, fast, RunOptions(output=os.path.join(folder, "out") + "/"), lambda: thorough)
    error = F.when(F.col("error").contains("neither"), "no input").otherwise(F.col("error"))
    return out.select("pos", "kind", "stem", "engine", "output", "text", error.alias("error"))


def secondary_not_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thorough engine that cannot be loaded: the fast text stays."""
    folder = os.path.join(shared_dir(spark), "pictures")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "only.bmp"), "wb") as out:
        out.write(bitmap(20, 50))

    def broken():
        raise OSError("no such model")

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = run_batch(spark, [os.path.join(folder, "only.bmp")], fast, RunOptions(output=os.path.join(folder, "only.txt")), broken)
    return out.select("stem", "engine", "output", "text", "error")


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as pages of aligned lists of words, turned into lines."""
    words = F.split(F.regexp_replace("text", f"[{X.WS}]+", " "), " ")
    box = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (9, 0), (9, 5), (0, 5))])
    pages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), words.alias("rec_texts"), F.transform(words, lambda w: F.length(w) / 100.0).alias("rec_scores"), F.transform(words, lambda w: box).alias("rec_boxes"))
    rows = layout.lines_of(pages)
    return rows.select(F.col("path").alias("item_id"), F.col("pos").cast("long").alias("pos"), "text", F.round("score", 6).alias("score"), F.round(F.get("quad", F.lit(2))["x"], 6).alias("x2"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variants two folders can serve, by the registry."""
    needed = spark.createDataFrame(registry.rows(), "variant string, file string, required boolean")
    present = spark.createDataFrame([("full", f) for f in registry.all_files()] + [("old", f) for f in registry.model_files("q4") if f != "config.json"], "folder string, file string")
    return integrity.complete_sets(needed.select("variant", "file"), present, registry.OPTIONAL)


def language_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(LISTS)), "id long, given string")
    return rows.select("id", F.array_join(X.split_list(F.col("given")), "+").alias("langs"))


def charset_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SYMBOLS, "id long, chars array<string>, classes int")
    return rows.select("id", F.array_join(Q.charset_for(F.col("chars"), F.col("classes")), "+").alias("symbols"))


QUERIES = {f.__name__: f for f in (batch_end_to_end, secondary_not_loaded, page_lists, model_registry, language_lists, charset_fit)}


def _page(width: int) -> str:
    return f"first line of width {width}\n\nsecond line of width {width}"


_RUN = [
    (0, "file", "page", "primary", "page_ocr.txt", _page(40), None), (1, "file", "page", "primary", "page_ocr_2.txt", _page(60), None), (2, "file", "tall", "secondary", "tall_ocr.txt", "Read\nagain in full", None),
    (3, "file", "notes", None, None, None, "not an image"), (4, None, None, None, None, None, "no input"), (5, "file", "page", "primary", "page_ocr_3.txt", _page(80), None),
]
_SETS = [("full", "q8", True), ("full", "q4", True), ("old", "q8", False), ("old", "q4", True)]
ORACLES = {
    "batch_end_to_end": f"SELECT * FROM {S.values(_RUN, 'pos, kind, stem, engine, output, text, error')}",
    "secondary_not_loaded": f"SELECT * FROM {S.values([('only', 'primary', 'only.txt', chr(10).join(['|||', '', '|||']), None)], 'stem, engine, output, text, error')}",
    "page_lists": f"""WITH w AS (SELECT item_id, string_split(regexp_replace(text, {S.rx(f'[{X.WS}]+')}, ' ', 'g'), ' ') AS words FROM benchmark)
SELECT item_id, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS text, round(len(unnest(words))::DOUBLE / 100.0::DOUBLE, 6) AS score, 9.0::DOUBLE AS x2 FROM w""",
    "model_registry": f"SELECT * FROM {S.values(_SETS, 'folder, variant, complete')}",
    "language_lists": f"SELECT * FROM {S.values([(0, 'en'), (1, 'fr+de'), (2, 'en'), (3, 'en'), (4, 'fr+fr')], 'id, langs')}",
    "charset_fit": f"SELECT * FROM {S.values([(1, '<blank>+a+b'), (2, '<blank>+a+b+ '), (3, '<blank>'), (4, '<blank>+ ')], 'id, symbols')}",
}
