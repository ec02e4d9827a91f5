"""Sizes and quadrilaterals as column expressions. Halves round to even, as everywhere in the model's preprocessing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two models' preprocessing.
FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_ASPECT = 28, 112_896, 1_003_520, 200
DET_LIMIT, DET_MAX_SIDE, DET_STEP, MIN_BOX = 64, 4000, 32, 3
REC_HEIGHT, REC_MIN_WIDTH, REC_MAX_WIDTH, REC_BATCH = 48, 320, 3200, 6


def _d(x: Column) -> Column:
    return x.cast("double")


def smart_resize(height: Column, width: Column, factor: int = FACTOR, min_pixels: int = MIN_PIXELS, max_pixels: int = MAX_PIXELS) -> Column:
    """struct(h, w): sides as multiples of factor with an area between the bounds; null where the aspect is too extreme."""
    f = float(factor)
    h0, w0 = _d(height), _d(width)
    w1, h1 = F.when(h0 < f, F.rint(w0 * f / h0)).otherwise(w0), F.greatest(h0, F.lit(f))
    h2, w2 = F.when(w1 < f, F.rint(h1 * f / w1)).otherwise(h1), F.greatest(w1, F.lit(f))
    hb, wb = F.rint(h2 / f) * f, F.rint(w2 / f) * f
    shrink, grow = F.sqrt(h2 * w2 / float(max_pixels)), F.sqrt(float(min_pixels) / (h2 * w2))
    over, under = hb * wb > max_pixels, hb * wb < min_pixels

    def side(x: Column, snapped: Column) -> Column:
        return F.when(over, F.floor(x / shrink / f) * factor).when(under, F.ceil(x * grow / f) * factor).otherwise(snapped.cast("long"))

    fits = F.greatest(h2, w2) / F.least(h2, w2) <= MAX_ASPECT
    return F.when(fits, F.struct(side(h2, hb).cast("long").alias("h"), side(w2, wb).cast("long").alias("w")))


def det_resize(height: Column, width: Column, limit: int = DET_LIMIT, max_side: int = DET_MAX_SIDE) -> Column:
    """struct(h, w) for the detector: short side at least limit, long side at most max_side, multiples of 32."""
    h, w = _d(height), _d(width)
    low, high = F.least(h, w), F.greatest(h, w)
    ratio = F.when(low < limit, limit / low).otherwise(F.lit(1.0))
    ratio = F.when(high * ratio > max_side, max_side / high).otherwise(ratio)
    side = [F.greatest(F.rint(x * ratio / float(DET_STEP)).cast("long") * DET_STEP, F.lit(DET_STEP).cast("long")) for x in (h, w)]
    return F.struct(side[0].alias("h"), side[1].alias("w"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"))


def order_quad(quad: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left. Equal x keep their order.

    Four corners are sorted as structs of x and place, and all else picks fields, so the whole is generated code.
    """
    corners = [F.get(quad, F.lit(i)) for i in range(4)]
    by_x = F.sort_array(F.array(*[F.struct(c["x"].alias("x"), F.lit(i).alias("i"), c["y"].alias("y")) for i, c in enumerate(corners)]))
    at = [F.get(by_x, F.lit(i)) for i in range(4)]
    left, right = at[1]["y"] > at[0]["y"], at[3]["y"] > at[2]["y"]

    def pick(first: Column, a: Column, b: Column) -> Column:
        return F.struct(F.when(first, a["x"]).otherwise(b["x"]).alias("x"), F.when(first, a["y"]).otherwise(b["y"]).alias("y"))

    return F.array(pick(left, at[0], at[1]), pick(right, at[2], at[3]), pick(right, at[3], at[2]), pick(left, at[1], at[0]))


def side_length(quad: Column, a: int, b: int) -> Column:
    dx, dy = F.get(quad, F.lit(a))["x"] - F.get(quad, F.lit(b))["x"], F.get(quad, F.lit(a))["y"] - F.get(quad, F.lit(b))["y"]
    return F.sqrt(dx * dx + dy * dy)


def half_axes(quad: Column, w: Column, h: Column, ratio: float) -> dict[str, Column]:
    """Centre and half axes of a rectangle (sides w and h) grown by area * ratio / perimeter on every side."""
    at, d = [F.get(quad, F.lit(i)) for i in range(4)], w * h * ratio / (2 * (w + h))
    out = {f"c{k}": (at[0][k] + at[1][k] + at[2][k] + at[3][k]) / 4 for k in "xy"}
    out |= {f"a{k}": (w / 2 + d) * (at[1][k] - at[0][k]) / w for k in "xy"}
    return out | {f"b{k}": (h / 2 + d) * (at[3][k] - at[0][k]) / h for k in "xy"}


def spanned(part: Callable[[str], Column]) -> Column:
    """The rectangle of centre and half axes, by name."""
    return F.array(*[point(part("cx") + s * part("ax") + t * part("bx"), part("cy") + s * part("ay") + t * part("by")) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def is_flat(w: Column, h: Column) -> Column:
    return (w < 1e-6) | (h < 1e-6)


def unclip(quad: Column, ratio: float) -> Column:
    """A rectangle grown by area * ratio / perimeter on every side; as it is if a side is nothing. For whole tables,
    ``boxes.grow`` does the same in generated code."""

    def grown(m: Column) -> Column:
        axes = F.struct(*[F.when(~is_flat(m["w"], m["h"]), c).alias(k) for k, c in half_axes(m["q"], m["w"], m["h"], ratio).items()])
        return F.when(is_flat(m["w"], m["h"]), m["q"]).otherwise(bind(axes, lambda x: spanned(lambda k: x[k])))

    return bind(bind(quad, lambda q: F.struct(q.alias("q"), side_length(q, 1, 0).alias("w"), side_length(q, 3, 0).alias("h"))), grown)


def to_page(quad: Column, map_w: Column, map_h: Column, page_w: Column, page_h: Column) -> Column:
    """Corners scaled from the detector's map to the page, rounded half to even and clipped."""
    def scale(v: Column, size: Column, page: Column) -> Column:
        return F.greatest(F.least(F.rint(v / _d(size) * _d(page)), _d(page)), F.lit(0.0))

    return F.transform(quad, lambda p: point(scale(p["x"], map_w, page_w), scale(p["y"], map_h, page_h)))


def crop_size(quad: Column) -> Column:
    """struct(w, h, vertical) of the upright strip cut from a quad; vertical ones are turned."""

    def sides(q: Column) -> Column:
        w = F.greatest(F.floor(F.greatest(side_length(q, 0, 1), side_length(q, 2, 3))), F.lit(1))
        h = F.greatest(F.floor(F.greatest(side_length(q, 0, 3), side_length(q, 1, 2))), F.lit(1))
        return F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))

    return bind(bind(quad, sides), lambda s: F.struct(s["w"].alias("w"), s["h"].alias("h"), (s["h"] / s["w"] >= 1.5).alias("vertical")))


def batch_width(max_ratio: Column) -> Column:
    """Width that a batch of strips is padded to, from the widest aspect in it."""
    ratio = F.greatest(max_ratio, F.lit(REC_MIN_WIDTH / REC_HEIGHT))
    return F.least(F.floor(REC_HEIGHT * ratio), F.lit(REC_MAX_WIDTH)).cast("long")
