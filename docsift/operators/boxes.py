"""The detector's box filters, in order, over a table of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import geometry as G

#: Fixed values of the detector: least score, growth, least side on the page.
MIN_SCORE, UNCLIP, MIN_PAGE_SIDE = 0.45, 1.4, 3


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns computed in a step of their own: filters above read them instead of computing them anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def grow(df: DataFrame, quad: str, ratio: float, name: str) -> DataFrame:
    """df with, as name, the quads grown by area * ratio / perimeter on every side; as they are if a side is nothing."""
    sized = once(df, __w=G.side_length(F.col(quad), 1, 0), __h=G.side_length(F.col(quad), 3, 0))
    w, h = F.col("__w"), F.col("__h")
    axes = once(sized, **{f"__{k}": F.when(~G.is_flat(w, h), c) for k, c in G.half_axes(F.col(quad), w, h, ratio).items()})
    grown = F.when(F.col("__ax").isNull(), F.col(quad)).otherwise(G.spanned(lambda k: F.col(f"__{k}")))
    return once(axes, **{name: grown}).drop("__w", "__h", *[f"__{k}" for k in ("cx", "cy", "ax", "ay", "bx", "by")])


def _least_side(quad: str) -> Column:
    return F.least(G.side_length(F.col(quad), 0, 1), G.side_length(F.col(quad), 0, 3))


def filter_boxes(boxes: DataFrame, map_size: tuple[int, int], page_size: tuple[int, int], min_score: float = MIN_SCORE, ratio: float = UNCLIP) -> DataFrame:
    """boxes (quad, side, score, others) that stay, with page, their quad on the page. Sizes are (width, height).

    A box goes if its side is too short, its score too low, its grown form too small or what is left on the page too thin.
    """
    likely = boxes.where((F.col("side") >= G.MIN_BOX) & (F.col("score") >= min_score))
    grown = grow(likely, "quad", ratio, "grown").where(_least_side("grown") >= G.MIN_BOX + 2)
    (map_w, map_h), (page_w, page_h) = map_size, page_size
    placed = once(grown, page=G.to_page(F.col("grown"), F.lit(map_w), F.lit(map_h), F.lit(page_w), F.lit(page_h)))
    return placed.where(_least_side("page") > MIN_PAGE_SIDE).drop("grown")
