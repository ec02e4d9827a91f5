"""Reading order: quads to rows, rows to lines, with a blank line where a paragraph ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.functions.geometry import bind

LOOK_BACK, MIN_OVERLAP, PARAGRAPH_GAP = 3, 0.5, 0.9
_ROW = "array<struct<top:double,bot:double,cells:array<struct<x:double,text:string>>>>"


def _boxes(items: Column) -> Column:
    """items: array of struct(quad, text), to sorted (mean y, min x, place) with extents; blank texts dropped."""
    def box(item: Column, at: Column) -> Column:
        ys, xs = F.transform(item["quad"], lambda p: p["y"].cast("double")), F.transform(item["quad"], lambda p: p["x"].cast("double"))
        mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)
        return F.struct(mean.alias("mid"), F.array_min(xs).alias("x"), at.alias("at"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bot"), X.strip(item["text"]).alias("text"))

    return F.array_sort(F.filter(F.transform(items, box), lambda b: b["text"] != ""))


def _absorb(rows: Column, b: Column) -> Column:
    """One step of the fold: the first of the last rows that overlaps by half takes the box, else it opens a row."""
    height = F.greatest(b["bot"] - b["top"], F.lit(1.0))
    start = F.greatest(F.size(rows) - LOOK_BACK + 1, F.lit(1))

    def overlaps(r: Column) -> Column:
        return F.least(b["bot"], r["bot"]) - F.greatest(b["top"], r["top"]) > MIN_OVERLAP * F.least(height, r["bot"] - r["top"])

    found = F.array_position(F.transform(F.slice(rows, start, F.lit(LOOK_BACK)), overlaps), F.lit(True))
    cell = F.array(F.struct(b["x"].alias("x"), b["text"].alias("text")))

    def placed(place: Column) -> Column:
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == place, F.struct(F.least(r["top"], b["top"]).alias("top"), F.greatest(r["bot"], b["bot"]).alias("bot"), F.concat(r["cells"], cell).alias("cells"))).otherwise(r))
        fresh = F.concat(rows, F.array(F.struct(b["top"].alias("top"), b["bot"].alias("bot"), cell.alias("cells"))))
        return F.when(place > 0, grown).otherwise(fresh)

    return bind(F.when(found > 0, found + start - 1).otherwise(F.lit(0)), placed)


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def assemble_lines(items: Column) -> Column:
    """Plain text in reading order of an array of struct(quad, text). Each intermediate array is evaluated once."""

    def by_top(rows: Column) -> Column:
        return F.array_sort(F.transform(rows, lambda r, i: F.struct(r["top"].alias("top"), i.alias("i"), r["bot"].alias("bot"), r["cells"].alias("cells"))))

    def measured(rows: Column) -> Column:
        median = upper_median(F.transform(rows, lambda r: r["bot"] - r["top"]))
        return F.struct(rows.alias("rows"), F.when(median == 0, F.lit(1.0)).otherwise(median).alias("median"))

    def joined(m: Column) -> Column:
        def line(r: Column, i: Column) -> Column:
            above = F.get(m["rows"], i - 1)["bot"]
            gap = (i > 0) & (r["top"] - above > PARAGRAPH_GAP * m["median"])
            return F.concat(F.when(gap, F.lit("\n")).otherwise(F.lit("")), F.array_join(F.transform(F.array_sort(r["cells"]), lambda c: c["text"]), " "))

        return F.array_join(F.transform(m["rows"], line), "\n")

    rows = F.aggregate(_boxes(items), F.array().cast(_ROW), lambda acc, b: _absorb(acc, b).cast(_ROW))
    return bind(bind(bind(rows, by_top), measured), joined)


def lines_of(pages: DataFrame, page: str = "path") -> DataFrame:
    """(page, pos, text, score, quad): the aligned lists rec_texts, rec_scores and rec_boxes of each page as rows.

    Lists of different lengths are an error, as nothing tells which entry lacks.
    """
    same = (F.size("rec_texts") == F.size("rec_scores")) & (F.size("rec_texts") == F.size("rec_boxes"))
    sizes = F.concat_ws(", ", F.size("rec_texts"), F.size("rec_scores"), F.size("rec_boxes"))
    lists = F.when(same, F.arrays_zip("rec_texts", "rec_scores", "rec_boxes")).otherwise(F.raise_error(F.concat(F.lit("lists of a page differ in length: "), sizes)))
    rows = pages.select(page, F.posexplode(lists).alias("pos", "line"))
    return rows.select(page, "pos", F.col("line.rec_texts").alias("text"), F.col("line.rec_scores").cast("double").alias("score"), F.col("line.rec_boxes").alias("quad"))
