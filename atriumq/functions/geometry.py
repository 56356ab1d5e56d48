"""Planar geometry as column expressions: everything here stays inside generated code.

Points are (x, y) columns. Lengths use sqrt(dx*dx + dy*dy), which DuckDB rounds alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two cross products on either side of a line multiply to less than this.
CROSSING = -1e-7
#: Metres that a vertical connector costs, by kind.
VERTICAL_METERS = {"elevator": 6.0, "stairs": 10.0, "ramp": 12.0}
VERTICAL_DEFAULT = 10.0
#: Fixed value: no link is cheaper.
LEAST_METERS = 0.001


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    return F.sqrt(dx * dx + dy * dy)


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Cross product of b - a and c - a."""
    return (_c(bx) - _c(ax)) * (_c(cy) - _c(ay)) - (_c(by) - _c(ay)) * (_c(cx) - _c(ax))


def crosses(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the segments a-b and c-d cross properly: touching and lying along each other do not count."""
    one = cross(ax, ay, bx, by, cx, cy) * cross(ax, ay, bx, by, dx, dy)
    two = cross(cx, cy, dx, dy, ax, ay) * cross(cx, cy, dx, dy, bx, by)
    return (one < CROSSING) & (two < CROSSING)


def boxes_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the bounding boxes of two segments meet: a cheap necessary condition of a crossing."""
    low, high = F.least, F.greatest
    return (
        (high(_c(ax), _c(bx)) >= low(_c(cx), _c(dx)))
        & (high(_c(cx), _c(dx)) >= low(_c(ax), _c(bx)))
        & (high(_c(ay), _c(by)) >= low(_c(cy), _c(dy)))
        & (high(_c(cy), _c(dy)) >= low(_c(ay), _c(by)))
    )


def known_scale(ppm) -> Column:
    """Pixels a metre, null where the plan is not calibrated: null and 0 both mean so."""
    return F.when(_c(ppm) != 0, _c(ppm))


def to_pixels(meters, ppm) -> Column:
    return _c(meters) * _c(ppm)


def to_meters(pixels, ppm) -> Column:
    return _c(pixels) / _c(ppm)


def measured_meters(pixels, ppm) -> Column:
    """Metres, null without calibration."""
    return _c(pixels) / known_scale(ppm)


def edge_meters(pixels, ppm) -> Column:
    """Metres, or the pixels themselves without calibration."""
    return F.coalesce(measured_meters(pixels, ppm), _c(pixels))


def calibrated(pixels, meters) -> Column:
    """Struct of pixels a metre and, where that cannot be told, why."""
    wrong = F.when(_c(meters) <= 0, F.lit("distance must be positive")).when(_c(pixels) < 1, F.lit("points coincide"))
    return F.struct(F.when(wrong.isNull(), _c(pixels) / _c(meters)).alias("ppm"), wrong.alias("error"))


def resolved_scale(calibrated_ppm, vector_ppm, thickness) -> Column:
    """Struct of scale and source: calibrated, else from the drawing, else a fifth of a metre a wall, within 8 to 400."""
    c, v = known_scale(calibrated_ppm), known_scale(vector_ppm)
    estimate = F.least(F.greatest(_c(thickness) / 0.2, F.lit(8.0)), F.lit(400.0))
    source = F.when(c.isNotNull(), "calibrated").when(v.isNotNull(), "vector").otherwise("estimated")
    return F.struct(F.coalesce(c, v, estimate).alias("ppm"), source.alias("source"))


def clamped(value, top) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(top).cast("double"), _c(value)))


def luminance(r, g, b) -> Column:
    return _c(r) * 0.2126 + _c(g) * 0.7152 + _c(b) * 0.0722


def vertical_meters(kind) -> Column:
    return reduce(lambda out, kv: out.when(_c(kind) == kv[0], kv[1]), VERTICAL_METERS.items(), F.when(F.lit(False), 0.0)).otherwise(VERTICAL_DEFAULT)


def item_length(kind, x0, y0, x1, y1) -> Column:
    """Length of a drawing item: a line or a curve's chord, twice the sides of a box, 0 for others."""
    w, h = F.abs(_c(x1) - _c(x0)), F.abs(_c(y1) - _c(y0))
    return F.when(_c(kind).isin("l", "c"), distance(x0, y0, x1, y1)).when(_c(kind).isin("re", "qu"), 2 * (w + h)).otherwise(0.0)


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, steps: int = 12) -> Column:
    """Points of a cubic curve, both ends included; arguments are structs of x and y."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(steps))
        u = 1 - t
        blend = lambda c: u * u * u * p0[c] + 3 * u * u * t * p1[c] + 3 * u * t * t * p2[c] + t * t * t * p3[c]
        return F.struct(blend("x").alias("x"), blend("y").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def pixel_point(point: Column, zoom) -> Column:
    """A point scaled and rounded half to even."""
    return F.struct(F.bround(point["x"] * zoom).cast("int").alias("x"), F.bround(point["y"] * zoom).cast("int").alias("y"))


def path_length(points: Column) -> Column:
    """Length of a polyline given as an array of structs of x and y."""
    gaps = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda b, a: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def near(ax, ay, bx, by, pixels: float = 2) -> Column:
    """Within so many pixels on either axis."""
    return (F.abs(_c(ax) - _c(bx)) <= pixels) & (F.abs(_c(ay) - _c(by)) <= pixels)


def centred_segment(x, y, ux, uy, length) -> Column:
    """Struct of the ends of a segment given by its centre, unit axis and length."""
    half = _c(length) / 2
    return F.struct((_c(x) - _c(ux) * half).alias("sx"), (_c(y) - _c(uy) * half).alias("sy"), (_c(x) + _c(ux) * half).alias("ex"), (_c(y) + _c(uy) * half).alias("ey"))


def contains(ring: Column, x, y) -> Column:
    """Even-odd test of a point against a ring (array of structs of x and y, not closed)."""
    x, y = _c(x), _c(y)
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    flips = F.zip_with(ring, ahead, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(flips, lambda f: f)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area inside a ring, by the shoelace formula."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def principal_angle(x, y) -> Column:
    """Aggregate: direction of largest spread of the points of a group, null under three points or without spread."""
    x, y = _c(x), _c(y)
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return F.when((F.count(x) >= 3) & (xx + yy > 0), 0.5 * F.atan2(2 * xy, xx - yy))
