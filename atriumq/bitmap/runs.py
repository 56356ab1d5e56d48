"""Runs of scan lines, their groups, and what a point meets.

A bitmap is a table of pixels (keys, px, py) or of runs (keys, y, x0, x1) with both ends included; keys are the
columns that tell bitmaps apart, ``floor`` if nothing else is said. Everything meets by equality of a row and a
tile of it, so cost follows what lies there and neither a floor nor a row has to fit a task.

Defined results: pixels that repeat count once; rows with a null coordinate or key take no part; empty tables
give empty ones; other columns are dropped unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriumq.checkpoint import kept
from atriumq.operators.graphs import contracted_labels

#: Width of a tile in pixels.
TILE = 256


def runs(pixels: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, y, x0, x1): the longest stretches of neighbouring pixels of a row, by gaps and islands."""
    p = pixels.select(*keys, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("y")).dropna()
    island = F.col("px") - F.dense_rank().over(Window.partitionBy(*keys, "y").orderBy("px"))
    return p.withColumn("_i", island).groupBy(*keys, "y", "_i").agg(F.min("px").alias("x0"), F.max("px").alias("x1")).drop("_i")


def pixels_of(rows: DataFrame, *also: str, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, also, px, py): every pixel of every run."""
    return rows.select(*keys, *also, F.explode(F.sequence("x0", "x1")).alias("px"), F.col("y").alias("py"))


def word(x: Column) -> tuple[Column, Column]:
    """(word, bits): which 64 pixels of a row x is among, and x as one bit of them."""
    return F.shiftright(x.cast("long"), 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))


def ones(lo: Column, hi: Column) -> Column:
    """A word with the bits from lo to hi set, both included."""
    every = F.lit(-1).cast("long")
    return F.call_function("shiftleft", every, lo.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", every, (63 - hi).cast("int")))


def words(pixels: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, y, word, bits): pixels as bits, 64 of a row in one number. They are put together before they move, so of a
    crowded bitmap a few bytes move instead of a row for every pixel. A pixel without a column is a word by itself, of one bit."""
    at, bit = word(F.col("px"))
    return pixels.groupBy(*keys, F.col("py").cast("long").alias("y"), at.alias("word")).agg(F.bit_or(F.coalesce(bit, F.lit(1).cast("long"))).alias("bits"))


def words_of(rows: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, y, word, bits): the pixels of runs as bits."""
    first = F.col("word") * 64
    bits = ones(F.greatest("x0", first) - first, F.least("x1", first + 63) - first)
    cut = rows.select(*keys, "y", "x0", "x1", F.explode(F.sequence(F.shiftright("x0", 6), F.shiftright("x1", 6))).alias("word"))
    return cut.groupBy(*keys, "y", "word").agg(F.bit_or(bits).alias("bits"))


def complement(rows: DataFrame, frames: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """Runs of a frame's pixels that are in no run; frames: (keys, width, height), runs inside it."""
    lines = frames.select(*keys, "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y"))
    ends = rows.select(*keys, "y", "x0", "x1").unionByName(lines.select(*keys, "y", F.col("width").cast("long").alias("x0"), F.col("width").cast("long").alias("x1")))
    before = F.coalesce(F.lag("x1").over(Window.partitionBy(*keys, "y").orderBy("x0")), F.lit(-1).cast("long"))
    gaps = ends.select(*keys, "y", (before + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    return gaps.where("x0 <= x1").join(frames.select(*keys), list(keys), "left_semi")


def merged(rows: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """Runs of the pixels that are in any of the runs, which may overlap."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("x0") > before + 1)).cast("int")
    return rows.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).groupBy(*keys, "y", "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def dilated(rows: DataFrame, rx: int, ry: int, frames: DataFrame | None = None, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """Runs of the pixels within rx columns and ry rows of the runs, inside the frames if there are any."""
    out = rows.select(*keys, F.explode(F.sequence(F.col("y") - ry, F.col("y") + ry)).alias("y"), (F.col("x0") - rx).alias("x0"), (F.col("x1") + rx).alias("x1"))
    if frames is not None:
        out = out.join(frames.select(*keys, "width", "height"), list(keys)).where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
        out = out.select(*keys, "y", F.greatest("x0", F.lit(0).cast("long")).alias("x0"), F.least("x1", F.col("width").cast("long") - 1).alias("x1")).where("x0 <= x1")
    return merged(out, keys)


def eroded(rows: DataFrame, rx: int, ry: int, frames: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """Runs of the pixels whose neighbours within rx columns and ry rows are all in the runs; what lies outside the frame counts as in."""
    return complement(dilated(complement(rows, frames, keys), rx, ry, frames, keys), frames, keys)


def inked(boxes: DataFrame, pixels: DataFrame, of: Sequence[str], keys: Sequence[str] = ("floor",), side: int = 32) -> DataFrame:
    """(keys, of, n): pixels in each box (keys, of, x0, y0, x1, y1) from x0, y0 up to x1, y1 exclusive; boxes meet them by tiles."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor((F.col(hi) - 1) / side)))
    tiled = boxes.where("x0 < x1 AND y0 < y1").withColumn("_tx", span("x0", "x1")).withColumn("_ty", span("y0", "y1"))
    dots = pixels.select(*keys, "px", "py", F.floor(F.col("px") / side).alias("_tx"), F.floor(F.col("py") / side).alias("_ty"))
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    hits = tiled.join(dots, [*keys, "_tx", "_ty"]).where(inside).groupBy(*keys, *of).agg(F.count(F.lit(1)).alias("n"))
    return boxes.select(*keys, *of).join(hits, [*keys, *of], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def run_id() -> Column:
    """A run's number on its bitmap: its row above its first pixel, so numbers follow the order of reading."""
    return F.shiftleft("y", 32) + F.col("x0")


def touching(rows: DataFrame, keys: Sequence[str] = ("floor",), reach: int = 1) -> DataFrame:
    """(keys, a, b): runs of neighbouring rows that overlap, with ``reach`` 1 also by a corner.

    Both sides are laid over tiles; a pair is told in the tile where its overlap begins, so it comes once."""
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE)))
    up = rows.select(*keys, "y", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), run_id().alias("a")).withColumn("tile", tiles(F.col("ax0") - reach, F.col("ax1") + reach))
    down = rows.select(*keys, (F.col("y") - 1).alias("y"), "x0", "x1", run_id().alias("b")).withColumn("tile", tiles(F.col("x0"), F.col("x1")))
    met = up.join(down, [*keys, "y", "tile"]).where((F.col("ax0") - reach <= F.col("x1")) & (F.col("x0") <= F.col("ax1") + reach))
    return met.where(F.col("tile") == F.floor(F.greatest(F.col("ax0") - reach, "x0") / TILE)).select(*keys, "a", "b")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each is joined to by pairs a, b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _groups(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """The first run that each of the runs, which are in the order of reading, is joined to."""
    low, wide = x0.min() - reach - 1, x1.max() - x0.min() + 2 * reach + 4
    row = (y - y.min()) * wide
    begin, end = row + x0 - low, np.maximum.accumulate(row + x1 - low)
    lo, hi = np.searchsorted(end, begin + wide - reach), np.searchsorted(begin, row + wide + x1 + reach - low, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(lo, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    hit = x1[b] >= x0[a] - reach
    return _joined(len(y), a[hit], b[hit])


def labelled(rows: DataFrame, keys: Sequence[str] = ("floor",), reach: int = 1) -> DataFrame:
    """Runs with ``component``, the number of the first run of their group: 8-connected, or 4-connected with ``reach`` 0.

    Runs are cut at the tiles' sides, and a task joins the pieces of a tile. Only pieces at a side of their tile can touch
    others' pieces: these meet by joins, so what is shuffled for the groups of a bitmap grows with the sides of its tiles."""
    keys, side = list(keys), TILE
    cut = rows.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1"))).withColumn("_ty", F.floor(F.col("y") / side))
    cut = cut.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}

    def label(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("y", "ascending"), ("x0", "ascending")])
        left, top = tile.column("_tx")[0].as_py() * side, tile.column("_ty")[0].as_py() * side
        y, x0, x1 = (tile.column(c).to_numpy() for c in ("y", "x0", "x1"))
        a, b = np.maximum(x0, left), np.minimum(x1, left + side - 1)
        first = _groups(y, a, b, reach)
        inner = (a > left) & (b < left + side - 1) & (y > top) & (y < top + side - 1)
        out = tile.select([*keys, "y", "x0", "x1"]).append_column("_piece", pa.array((y[first] << 32) + a[first]))
        return out.append_column("_a", pa.array(a, mask=inner)).append_column("_b", pa.array(b, mask=inner))

    pieces = cut.groupBy(*keys, "_tx", "_ty").applyInArrow(label, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, y long, x0 long, x1 long, _piece long, _a long, _b long")
    pieces = kept(pieces, "pieces")
    outer = pieces.where("_a IS NOT NULL").select(*keys, "y", F.col("_a").alias("x0"), F.col("_b").alias("x1"), "_piece")
    of = lambda c: outer.select(*keys, run_id().alias(c), F.col("_piece").alias(f"_{c}"))
    beside = outer.where(F.pmod("x0", F.lit(side)) == 0).select(*keys, (F.shiftleft("y", 32) + F.col("x0") - 1).alias("b_end"), run_id().alias("b"))
    along = outer.select(*keys, (F.shiftleft("y", 32) + F.col("x1")).alias("b_end"), run_id().alias("a")).join(beside, [*keys, "b_end"]).select(*keys, "a", "b")
    pairs = touching(outer, keys, reach).unionByName(along).join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"])
    found = contracted_labels(pairs.select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b"), keys).withColumnRenamed("node", "_piece")
    whole = pieces.where("_a IS NULL OR _a = x0").select(*keys, "y", "x0", "x1", "_piece")
    return whole.join(found, [*keys, "_piece"], "left").withColumn("component", F.coalesce("component", "_piece")).drop("_piece")


def first_pixel(component: str = "component") -> tuple[Column, Column]:
    """(x, y) of the first pixel of a group."""
    return F.col(component) - F.shiftleft(F.shiftright(component, 32), 32), F.shiftright(component, 32)


def group_boxes(rows: DataFrame, *also: Column, keys: Sequence[str] = ("floor",), label: str = "component") -> DataFrame:
    """(keys, label, area, x0, y0, x1, y1, cx, cy, also): pixels, box and centre of every group, and other aggregates over its runs."""
    n = F.col("x1") - F.col("x0") + 1
    return rows.groupBy(*keys, label).agg(
        F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
        (F.sum(n * (F.col("x0") + F.col("x1"))) / 2 / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"), *also,
    )


def met(points: DataFrame, rows: DataFrame, *values: str, keys: Sequence[str] = ("floor",), how: str = "inner") -> DataFrame:
    """Points (keys, px, py and all their columns) with the values of the run that each lies in."""
    tiles = rows.select(*keys, F.col("y").alias("py"), "x0", "x1", *values).withColumn("_tile", F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor(F.col("x1") / TILE))))
    right = tiles.withColumnsRenamed({c: f"_r_{c}" for c in (*keys, "py", "_tile")})
    same = (F.col("_at") == F.col("_r__tile")) & (F.col("py") == F.col("_r_py")) & F.col("px").between(F.col("x0"), F.col("x1"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    out = points.withColumn("_at", F.floor(F.col("px") / TILE)).join(right, same, how)
    return out.select(*points.columns, *values) if how not in ("left_semi", "left_anti") else out.drop("_at")


def first_met(probes: DataFrame, rows: DataFrame, of: Sequence[str], value: str, order: str = "probe", keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(of, value): of the probes of a thing, in their order, the value of the first that lies in a run; null if none does."""
    return met(probes, rows, value, keys=keys, how="left").groupBy(*of).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def exterior(rows: DataFrame, frames: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """Runs of free pixels whose group reaches the frame's border."""
    free = labelled(complement(rows, frames, keys), keys).join(frames.select(*keys, "width", "height"), list(keys))
    edge = (F.col("y") == 0) | (F.col("x0") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x1") == F.col("width") - 1)
    open_ = free.where(edge).select(*keys, "component").distinct()
    return free.join(open_, [*keys, "component"], "left_semi").select(*keys, "y", "x0", "x1")


def opening_sides(openings: DataFrame, spaces: DataFrame, outside: DataFrame, frames: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, opening, side_a, side_b): what lies on both sides of every opening: a space, -1 outside, 0 nothing.

    openings: (keys, opening, cx, cy, nx, ny, depth, ppm); spaces: labelled runs with ``space`` numbers from 1; outside: runs.
    Four probes a side, ever farther; the nearest that meets anything tells, and one beyond the frame is outside."""
    far = F.array(*[F.col("depth") / 2 + d for d in (F.lit(2.0), 0.15 * F.col("ppm"), 0.35 * F.col("ppm"), 0.6 * F.col("ppm"))])
    half = lambda c: F.floor(c + 0.5).cast("long")
    p = openings.select(*keys, "opening", "cx", "cy", "nx", "ny", F.posexplode(far).alias("probe", "far")).withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1))))
    p = p.select(*keys, "opening", "way", "probe", half(F.col("cx") + F.col("nx") * F.col("far") * F.col("way")).alias("px"), half(F.col("cy") + F.col("ny") * F.col("far") * F.col("way")).alias("py"))
    p = p.join(frames.select(*keys, "width", "height"), list(keys))
    off = (F.col("px") < 0) | (F.col("py") < 0) | (F.col("px") >= F.col("width")) | (F.col("py") >= F.col("height"))
    world = spaces.select(*keys, "y", "x0", "x1", F.col("space").cast("long").alias("space")).unionByName(outside.select(*keys, "y", "x0", "x1", F.lit(-1).cast("long").alias("space")))
    hit = met(p, world, "space", keys=keys, how="left").withColumn("space", F.when(off, F.lit(-1).cast("long")).otherwise(F.col("space")))
    side = lambda w: F.coalesce(F.min_by("space", F.when(F.col("space").isNotNull() & (F.col("way") == w), F.col("probe"))), F.lit(0).cast("long"))
    return hit.groupBy(*keys, "opening").agg(side(1).alias("side_a"), side(-1).alias("side_b"))
