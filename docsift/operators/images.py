"""Choice of a page's most prominent image; batches of strips by aspect; look-ups of embeddings."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions import text as X
from docsift.functions.geometry import REC_BATCH

MEASURED = 8

#: Fixed value: parts of an HTML start tag.
_IMG = r"(?is)<img\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
_ANCHOR = _IMG.replace("<img", "<a")
_MAIN = r"(?is)<(article|main)\b[^>]*>.*?</\1>"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, quoted or bare; empty if it is not there."""
    found = F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(found, r"\A[\"']|[\"']\z", "")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, idx, href) of the anchors of pages (page_id, url, html) that have an address, in page order."""
    found = F.filter(F.transform(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)), lambda tag: attribute(tag, "href")), lambda href: href != "")
    return pages.select("page_id", "url", F.posexplode(found).alias("idx", "href"))


def image_tags(html: Column) -> Column:
    """Attributes of the img tags of the main part; of the whole page if the main part has none."""
    whole = F.regexp_extract_all(html, F.lit(_IMG), F.lit(1))
    main = F.regexp_extract_all(F.regexp_extract(html, _MAIN, 0), F.lit(_IMG), F.lit(1))
    return F.when(F.size(main) > 0, main).otherwise(whole)


def declared_area(tag: Column) -> Column:
    """Product of the first numbers of width and height; 0 where one is missing."""
    width, height = (F.coalesce(F.regexp_extract(attribute(tag, a), r"(\d+)", 1).try_cast("long"), F.lit(0)) for a in ("width", "height"))
    return width * height


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC 3986 resolution of links."""
    return pd.Series([None if link_ is None else urljoin(base_ or "", link_) for base_, link_ in zip(base, link, strict=True)])


def image_candidates(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, url, idx, src, area) of the usable images, src as written."""
    spread = pages.select(key, "url", F.posexplode(image_tags(F.col(html))).alias("idx", "tag"))
    src = F.lit("")
    for name in ("data-original", "data-src", "src"):
        src = F.when(attribute(F.col("tag"), name) != "", attribute(F.col("tag"), name)).otherwise(src)
    rows = spread.select(key, "url", "idx", src.alias("src"), declared_area(F.col("tag")).alias("area"))
    return rows.where((F.col("src") != "") & ~F.col("src").startswith("data:") & ~F.col("src").rlike(X.JUNK_IMAGE))


def prominent_image(candidates: DataFrame, measured: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, src, area) of the largest declared image, the earliest of equals.

    Where no size is declared, the first eight in order are compared by measured pixels (key, src, pixels); an image
    that could not be measured drops out.
    """
    best = candidates.groupBy(key).agg(F.max(F.struct("area", (-F.col("idx")).alias("earlier"), "src")).alias("best"))
    chosen = best.select(key, F.col("best.src").alias("src"), F.col("best.area").alias("area"))
    if measured is None:
        return chosen
    order = Window.partitionBy(key).orderBy(F.desc("area"), "idx")
    first = candidates.join(chosen.where("area = 0").select(key), key, "left_semi").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MEASURED)
    seen = first.join(measured, [key, "src"]).groupBy(key).agg(F.max(F.struct("pixels", (-F.col("rn")).alias("earlier"), "src")).alias("best"))
    return chosen.where("area > 0").unionByName(seen.select(key, F.col("best.src").alias("src"), F.lit(0).cast("long").alias("area")))


def aspect_batches(strips: DataFrame, page: list[str], size: int = REC_BATCH) -> DataFrame:
    """strips (page..., pos, w, h) with ratio and batch: consecutive ones by aspect, a page at a time."""
    ratio = F.col("w").cast("double") / F.greatest(F.col("h"), F.lit(1)).cast("double")
    rows = strips.withColumn("ratio", ratio)
    order = Window.partitionBy(*page).orderBy("ratio", "pos")
    return rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def embedding_lookup(sequences: DataFrame, table: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, pos, token_id, vec) of sequences (key, ids); an id beyond the table is an error."""
    rows = sequences.select(key, F.posexplode("ids").alias("pos", "token_id"))
    found = rows.join(table.select("token_id", "vec"), "token_id", "left")
    message = F.concat(F.lit("token id out of range: "), F.col("token_id").cast("string"))
    return found.select(key, "pos", "token_id", F.when(F.col("vec").isNull(), F.raise_error(message).cast("array<float>")).otherwise(F.col("vec")).alias("vec"))


def splice_image_rows(tokens: DataFrame, image: DataFrame, placeholder: int, key: str = "seq_id") -> DataFrame:
    """tokens (key, pos, token_id, vec) with the k-th placeholder's vector replaced by the k-th image row (key, k, image_vec)."""
    marks = tokens.where(F.col("token_id") == placeholder)
    marks = marks.select(key, "pos", F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("k"))
    placed = marks.join(image, [key, "k"], "full")
    wrong = F.col("pos").isNull() | F.col("image_vec").isNull()
    placed = placed.select(F.col(key).alias("__k"), F.when(wrong, F.raise_error(F.lit("image rows and placeholders differ in number")).cast("int")).otherwise(F.col("pos")).alias("__pos"), "image_vec")
    joined = tokens.join(placed, (F.col(key) == F.col("__k")) & (F.col("pos") == F.col("__pos")), "left")
    return joined.select(key, "pos", "token_id", F.coalesce("image_vec", "vec").alias("vec"))
