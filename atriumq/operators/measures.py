"""Measures over pixels and strokes as grouped aggregates: histograms first, so a floor of any size is a few hundred rows after the map side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atriumq.functions import geometry as g

# Dark and light ink, the least width of a wall stroke in points, the largest share of a page a filled wall covers.
DARK, LIGHT, WALL_STROKE, FILL_SHARE = 0.55, 0.85, 2.0, 0.25
DARK_MOST, DARK_LEAST = 110, 40


def stroke_mode(pixels: DataFrame, value: str = "thickness") -> DataFrame:
    """(floor, mode): the stroke thickness that most ink has: one-pixel bins from the least value, weighted by thickness, the first best plus a half."""
    low = pixels.where(F.col(value) > 0).groupBy("floor").agg(F.min(value).alias("low"))
    bins = pixels.where(F.col(value) > 0).join(low, "floor").groupBy("floor", "low", F.floor(F.col(value) - F.col("low")).alias("bin")).agg(F.count("*").alias("n"))
    edge = F.col("low") + F.col("bin")
    return bins.groupBy("floor").agg(F.max_by(edge, F.struct(F.col("n") * edge, -edge)).alias("edge")).select("floor", (F.col("edge") + 0.5).alias("mode"))


def otsu(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """(floor, threshold): the gray that parts a floor's histogram with the largest variance between the sides, the first of equals."""
    h = pixels.groupBy("floor", value).agg(F.count("*").cast("double").alias("n"))
    floor = Window.partitionBy("floor")
    run = floor.orderBy(value)
    h = h.withColumn("w", F.sum("n").over(run)).withColumn("s", F.sum(F.col("n") * F.col(value)).over(run)).withColumn("tw", F.sum("n").over(floor)).withColumn("ts", F.sum(F.col("n") * F.col(value)).over(floor))
    rest = F.col("tw") - F.col("w")
    apart = F.when((rest > 0) & (F.col("w") > 0), F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("ts") - F.col("s")) / rest, 2)).otherwise(0.0)
    return h.withColumn("apart", F.round(apart / (F.col("tw") * F.col("tw")), 9)).groupBy("floor").agg(F.min_by(value, F.struct(-F.col("apart"), F.col(value))).alias("threshold"))


def dark_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels darker than the floor's threshold, which is held between DARK_LEAST and DARK_MOST."""
    limit = otsu(pixels).select("floor", F.greatest(F.least("threshold", F.lit(DARK_MOST)), F.lit(DARK_LEAST)).alias("limit"))
    return pixels.join(limit, "floor").where(F.col("gray") < F.col("limit")).drop("limit")


def with_ink(strokes: DataFrame) -> DataFrame:
    return strokes.withColumn("ink", g.luminance("r", "g", "b")).withColumn("length", g.item_length("item", "x0", "y0", "x1", "y1"))


def wall_stroke_width(strokes: DataFrame, share: float = 0.9) -> DataFrame:
    """(floor, threshold): half the width that ``share`` of dark stroke length does not exceed, at least WALL_STROKE."""
    dark = with_ink(strokes).where((F.col("ink") < DARK) & (F.col("width") > 0) & (F.col("length") > 0))
    by = dark.groupBy("floor", "width").agg(F.sum("length").alias("length"))
    run = by.withColumn("run", F.sum("length").over(Window.partitionBy("floor").orderBy("width"))).withColumn("all", F.sum("length").over(Window.partitionBy("floor")))
    at = run.where(F.col("run") >= share * F.col("all")).groupBy("floor").agg(F.min("width").alias("width"))
    return at.select("floor", F.greatest(F.lit(WALL_STROKE), F.col("width") * 0.5).alias("threshold"))


def wall_strokes(strokes: DataFrame) -> DataFrame:
    """Strokes with what they do: ``wall`` draws, ``erase`` clears in drawing order, null does nothing."""
    s = with_ink(strokes).join(wall_stroke_width(strokes), "floor", "left").withColumn("threshold", F.coalesce("threshold", F.lit(WALL_STROKE)))
    role = F.when((F.col("ink") < DARK) & (F.col("width") >= WALL_STROKE) & (F.col("width") >= F.col("threshold")), "wall").when((F.col("ink") > LIGHT) & (F.col("width") >= 0.5 * F.col("threshold")), "erase")
    return s.withColumn("role", role)


def wall_fills(strokes: DataFrame, page_area: float) -> DataFrame:
    """Filled items that are walls: dark, of three points or more, not as large as a background."""
    box = F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("y1") - F.col("y0"))
    return with_ink(strokes).where((F.col("ink") < DARK) & (box < FILL_SHARE * page_area) & (F.col("n_points") >= 3))


def large_groups(labelled: DataFrame, least: float, label: str = "component") -> DataFrame:
    """(floor, label, area, box, centroid) of pixel groups of at least ``least`` pixels."""
    a = labelled.groupBy("floor", label).agg(F.count("*").alias("area"), F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return a.where(F.col("area") >= least)


def group_overlap(labelled: DataFrame, mask: DataFrame, label: str = "component") -> DataFrame:
    """(floor, label, overlap, probability): the share of a group's pixels in a mask, and its mean probability there."""
    m = mask.select("floor", "px", "py", F.lit(1).alias("on")).distinct()
    out = labelled.join(m, ["floor", "px", "py"], "left")
    return out.groupBy("floor", label).agg(F.avg(F.coalesce("on", F.lit(0)).cast("double")).alias("overlap"), F.avg("probability").alias("probability"))


def face_spread(faces: DataFrame, key: str) -> DataFrame:
    """Low, middle and high percentile of what lies across a gap, per group."""
    return faces.groupBy("floor", key).agg(F.percentile("across", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("p")).select("floor", key, F.col("p")[0].alias("low"), F.col("p")[1].alias("middle"), F.col("p")[2].alias("high"))


def accepted_classical(groups: DataFrame, ppm: str = "ppm") -> DataFrame:
    """Groups of dark pixels taken as walls: overlapping what is drawn, or compact; all of a floor where nothing is drawn yet."""
    side = F.col(ppm) * 0.9
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    compact = (F.col("area") <= side * side) & (F.greatest(w, h) <= 3 * F.least(w, h))
    known = groups.withColumn("_most", F.max("overlap").over(Window.partitionBy("floor")))
    return known.where((F.col("overlap") >= 0.2) | compact | (F.col("_most") == 0)).drop("_most")


def blended(tiles: DataFrame, tile: int = 512) -> DataFrame:
    """(floor, class, px, py, value): overlapping tiles of a model's output as one image.

    tiles: (floor, class, x0, y0, tx, ty, value), a row a pixel of a tile that begins at x0, y0. A pixel is the
    mean of all tiles over it, weighted by how near the middle of each it lies (a raised cosine both ways)."""
    near = lambda c: 0.5 - 0.5 * F.cos(2 * math.pi * F.col(c) / (tile - 1))
    w = near("tx") * near("ty") + 1e-3
    at = tiles.withColumns({"px": F.col("x0") + F.col("tx"), "py": F.col("y0") + F.col("ty"), "_w": w})
    return at.groupBy("floor", "class", "px", "py").agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def likeliest(blend: DataFrame) -> DataFrame:
    """(floor, px, py, class): the class of every pixel, the first of equally likely ones."""
    return blend.groupBy("floor", "px", "py").agg(F.min_by("class", F.struct(-F.col("value"), F.col("class"))).alias("class"))
