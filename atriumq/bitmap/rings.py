"""Outlines of pixel groups as rings of corners, and rings filled again, as rows.

The boundary of a bitmap is made of unit steps along the sides of its pixels. Steps in a line are one segment; a
segment's follower starts where it ends. Which ring a segment belongs to, and how far along it, comes from pointer
doubling: every round a segment looks twice as far ahead, so a ring of n corners takes about log2 n rounds. Rings
that lie in a tile are followed by a task, those that leave it by joins, all of all floors together.

Defined results: as in ``runs``; a ring runs with the set pixels on its right, so outer rings have a positive
area and holes a negative one; groups that meet at a corner only share one ring.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atriumq.checkpoint import dropped, kept

from . import runs

#: Directions by number: right, down, left, up.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


#: Width of a tile in pixels.
TILE = 256
#: Where a step along a pixel's side in each direction begins, from the pixel's first corner.
_CORNER = ((0, 0), (1, 0), (1, 1), (0, 1))


def _traced(px: np.ndarray, py: np.ndarray, tx: int, ty: int, side: int) -> dict[str, np.ndarray]:
    """Segments of the boundary of a tile's own pixels: way, ring and ord (-1 where the ring leaves the tile), x, y, bx, by."""
    lx, ly = px.min() - 1, py.min() - 1
    on = np.zeros((py.max() - ly + 2, px.max() - lx + 2), dtype=bool)
    on[py - ly, px - lx] = True
    own = on.copy()
    xs, ys = np.arange(on.shape[1]) + lx, np.arange(on.shape[0]) + ly
    own[:, xs // side != tx] = False
    own[ys // side != ty] = False
    at = lambda m, v: np.roll(m, (-v[1], -v[0]), (0, 1))  # noqa: E731  (the outermost places are never set)
    number, parts = np.full((4, *on.shape), -1, dtype=np.int64), []
    n = 0
    for way, ahead in enumerate(STEPS):
        step = own & ~at(on, STEPS[(way + 3) % 4])
        begin, end = step & ~at(step, (-ahead[0], -ahead[1])), step & ~at(step, ahead)
        if way % 2:
            (x0, y0), (x1, y1) = np.nonzero(begin.T), np.nonzero(end.T)
        else:
            (y0, x0), (y1, x1) = np.nonzero(begin), np.nonzero(end)
        number[way, y0, x0] = np.arange(n, n + len(x0))
        parts.append((np.full(len(x0), way), x0, y0, x1, y1))
        n += len(x0)
    way, x0, y0, x1, y1 = (np.concatenate([p[i] for p in parts]) for i in range(5))
    ahead, corner = np.array(STEPS), np.array(_CORNER)
    fx, fy = x1 + ahead[way, 0], y1 + ahead[way, 1]
    gx, gy = fx + ahead[(way + 3) % 4, 0], fy + ahead[(way + 3) % 4, 1]
    # To the left where a pixel lies there, straight on only into another tile, else to the right around the same pixel.
    left = on[gy, gx]
    then = np.where(left, number[(way + 3) % 4, gy, gx], np.where(on[fy, fx], -1, number[(way + 1) % 4, y1, x1]))
    leaves = then < 0
    then = np.where(leaves, np.arange(n), then)
    x, y = x0 + corner[way, 0] + lx, y0 + corner[way, 1] + ly
    bx, by = x1 + corner[(way + 1) % 4, 0] + lx, y1 + corner[(way + 1) % 4, 1] + ly
    id_ = (y << 33) + (x << 2) + way
    ring, p = id_, then
    while True:  # every round looks twice as far ahead
        new, out = np.minimum(ring, ring[p]), leaves | leaves[p]
        if (new == ring).all() and (out == leaves).all():
            break
        ring, leaves, p = new, out, p[p]
    last = leaves | (ring == id_)
    hops, p = (~last).astype(np.int64), np.where(last, np.arange(n), then)
    while not last[p].all():
        hops, p = hops + hops[p], p[p]
    size = np.bincount(p, minlength=n)[p]
    ring, ord_ = np.where(leaves, -1, ring), np.where(leaves, -1, (size - hops) % size)
    return {"way": way, "ring": ring, "ord": ord_, "x": x, "y": y, "bx": bx, "by": by}


def sides(pixels: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, ring, ord, x, y, bx, by): every straight side of every ring, from a corner to the next.

    A task follows the boundary of the pixels of a tile, and rings that lie in it are done. Of the others the tile tells the
    segments; these are put together across tiles, and their order comes from pointer doubling."""
    keys, side = list(keys), TILE
    p = runs.words(pixels.select(*keys, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).dropna(), keys)
    # A tile sees the pixels right beside it too, of a word what lies there.
    first = F.col("word") * 64
    p = p.withColumn("_tx", F.explode(F.sequence(F.floor((first - 1) / side), F.floor((first + 64) / side))))
    left = F.col("_tx") * side - 1 - first
    p = p.withColumn("bits", F.col("bits").bitwiseAND(runs.ones(F.greatest(left, F.lit(0)), F.least(left + side + 1, F.lit(63))))).where("bits <> 0")
    p = p.withColumn("_ty", F.explode(F.sequence(F.floor((F.col("y") - 1) / side), F.floor((F.col("y") + 1) / side))))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def trace(tile: pa.Table) -> pa.Table:
        bits = np.ascontiguousarray(tile.column("bits").to_numpy()).view(np.uint8).reshape(-1, 8)
        row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        px, py = tile.column("word").to_numpy()[row] * 64 + bit, tile.column("y").to_numpy()[row]
        found = _traced(px, py, tile.column("_tx")[0].as_py(), tile.column("_ty")[0].as_py(), side)
        out = tile.select(keys).take(pa.array(np.zeros(len(found["way"]), dtype=np.int64)))
        for name, values in found.items():
            out = out.append_column(name, pa.array(values.astype(np.int32 if name == "way" else np.int64)))
        return out

    told = p.groupBy(*keys, "_tx", "_ty").applyInArrow(trace, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, way int, ring long, ord long, x long, y long, bx long, by long")
    told = kept(told, "sides")
    done = told.where("ord >= 0").select(*keys, "ring", "ord", "x", "y", "bx", "by")
    open_ = kept(_segments(told.where("ord < 0"), keys), "segments")
    return done if open_.isEmpty() else done.unionByName(_ordered(open_, keys))


def _segments(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, way, sx, sy, ex, ey): straight stretches of the boundary, put together of pieces that follow each other."""
    flat, forth = F.col("way") % 2 == 0, F.col("way") < 2
    line, a, b = F.when(flat, F.col("y")).otherwise(F.col("x")), F.when(flat, F.col("x")).otherwise(F.col("y")), F.when(flat, F.col("bx")).otherwise(F.col("by"))
    p = pieces.select(*keys, "way", line.alias("line"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    w = Window.partitionBy(*keys, "way", "line").orderBy("lo")
    new = (F.coalesce(F.lag("hi").over(w), F.col("lo") - 1) < F.col("lo")).cast("int")
    whole = p.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).groupBy(*keys, "way", "line", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    begin, end = F.when(forth, F.col("lo")).otherwise(F.col("hi")), F.when(forth, F.col("hi")).otherwise(F.col("lo"))
    point = lambda along: (F.when(flat, along).otherwise(F.col("line")), F.when(flat, F.col("line")).otherwise(along))
    (sx, sy), (ex, ey) = point(begin), point(end)
    # A corner's number follows the order of reading; ways are told apart, as two rings may meet in a corner.
    number = F.shiftleft("sy", 33) + F.shiftleft("sx", 2) + F.col("way")
    return whole.select(*keys, "way", sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey")).select(*keys, number.alias("id"), "way", "sx", "sy", "ex", "ey")


def _ordered(at: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, ord, x, y, bx, by) of rings given by their segments."""
    then = at.select(*keys, F.col("id").alias("next"), F.col("way").alias("_way"), F.col("sx").alias("ex"), F.col("sy").alias("ey"))
    left = (F.col("_way") - F.col("way") + 1) % 4  # 0 for a turn to the left, 2 for one to the right
    link = at.join(then, [*keys, "ex", "ey"]).groupBy(*keys, "id").agg(F.min_by("next", F.pmod(left, F.lit(4))).alias("next"))
    state = kept(link.select(*keys, "id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("hops")), "links")
    reach = 1
    while True:
        far = state.select(*keys, F.col("id").alias("next"), F.col("next").alias("_then"), F.col("ring").alias("_ring"), F.col("hops").alias("_hops"))
        less = F.col("_ring") < F.col("ring")
        after = state.join(far, [*keys, "next"]).select(*keys, "id", F.col("_then").alias("next"), F.least("ring", "_ring").alias("ring"), F.when(less, F.col("_hops") + reach).otherwise(F.col("hops")).alias("hops"), less.alias("moved"))
        after = kept(after, "links")
        dropped(state)
        state, reach = after.drop("moved"), 2 * reach
        if after.where("moved").isEmpty():
            break
    whole = state.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("n"))
    # hops lead to the ring's first corner, so the order from there runs the other way.
    out = state.join(whole, [*keys, "ring"]).withColumn("ord", F.pmod(F.col("n") - F.col("hops"), F.col("n")))
    ends = at.select(*keys, "id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("ex").alias("bx"), F.col("ey").alias("by"))
    return out.join(ends, [*keys, "id"]).select(*keys, "ring", "ord", "x", "y", "bx", "by")


def rings(pixels: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, ring, ord, x, y): the corners of every ring in their order from 0; ring is the number of its first one."""
    return sides(pixels, keys).select(*keys, "ring", "ord", "x", "y")


def closed_edges(corners: DataFrame, keys: Sequence[str] = ("floor",), shape: str = "ring") -> DataFrame:
    """(keys, shape, x, y, bx, by): every side of every ring."""
    w = Window.partitionBy(*keys, shape).orderBy("ord")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return corners.select(*keys, shape, "x", "y", after("x").alias("bx"), after("y").alias("by"))


def areas(edges: DataFrame, keys: Sequence[str] = ("floor",), shape: str = "ring") -> DataFrame:
    """(keys, shape, n, area, perimeter) of rings given by their sides; holes have a negative area."""
    step = F.sqrt((F.col("bx") - F.col("x")) ** 2 + (F.col("by") - F.col("y")) ** 2)
    return edges.groupBy(*keys, shape).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("x") * F.col("by") - F.col("bx") * F.col("y")) / 2).alias("area"), F.sum(step).alias("perimeter"))


def filled(edges: DataFrame, keys: Sequence[str] = ("floor",), width: int | None = None, height: int | None = None) -> DataFrame:
    """Runs (keys, y, x0, x1) of the pixels whose centres lie inside an odd number of the rings given by their sides.

    keys may name a shape, so that each is filled by itself. Sides are cut into scan lines, crossings at one
    place cancel in pairs, and between an odd crossing and the next one lies a run."""
    lo, hi = F.least("y", "by"), F.greatest("y", "by")
    first, last = F.ceil(lo), F.ceil(hi) - 1
    if height is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(height - 1))
    cut = edges.where("y <> by").withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("_y", F.explode(F.sequence("_a", "_b")))
    column = F.ceil(F.col("x") + (F.col("_y") - F.col("y")) * (F.col("bx") - F.col("x")) / (F.col("by") - F.col("y")))
    if width is not None:
        column = F.least(F.greatest(column, F.lit(0)), F.lit(width))
    # Crossings are bits of their row, of which an even number at one place is none; only words of them move.
    at, bit = runs.word(column)
    odd = cut.groupBy(*keys, F.col("_y").alias("y"), at.alias("word")).agg(F.bit_xor(bit).alias("bits")).where("bits <> 0")
    odd = odd.repartition(*keys, "y")  # as the window asks for, while they are words
    odd = odd.withColumn("_i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))).select(*keys, "y", (F.col("word") * 64 + F.col("_i")).alias("x0"))
    w = Window.partitionBy(*keys, "y").orderBy("x0")
    run = odd.withColumn("_n", F.row_number().over(w)).withColumn("x1", F.lead("x0").over(w) - 1).where("_n % 2 = 1")
    return run.where(F.col("x1") >= F.col("x0")).select(*keys, "y", "x0", "x1")


def simplified(points: DataFrame, tolerance: float, keys: Sequence[str] = ("floor",), line: str = "ring") -> DataFrame:
    """The points (keys, line, ord, x, y) of polylines that stay when none dropped is farther than ``tolerance`` from its chord.

    All chords of all lines are split at once: in each round the farthest point of every open chord (the first
    of equals) becomes an end. Chords of no length measure from their end. Rounds are as many as the recursion is deep."""
    keys = [*keys, line]
    w = Window.partitionBy(*keys)
    p = points.select(*keys, F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = p.withColumn("_lo", F.min("ord").over(w)).withColumn("_hi", F.max("ord").over(w))
    stay = kept(ends.where("ord = _lo OR ord = _hi").select(*keys, "ord", "x", "y"), "ends")
    parts = [stay]
    # Inner points with both ends of the chord that they lie under.
    tip = lambda o: F.max(F.when(F.col("ord") == F.col(o), F.struct("ord", "x", "y"))).over(w)
    open_ = kept(ends.withColumn("a", tip("_lo")).withColumn("b", tip("_hi")).where("ord > _lo AND ord < _hi").select(*keys, "ord", "x", "y", "a", "b"), "open")
    dx, dy, rx, ry = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    n = F.sqrt(dx * dx + dy * dy)
    far = F.when(n == 0, F.sqrt(rx * rx + ry * ry)).otherwise(F.abs(dx * ry - dy * rx) / n)
    while not open_.isEmpty():
        split = open_.withColumn("far", far).groupBy(*keys, F.col("a.ord").alias("_a")).agg(F.min(F.struct((-F.col("far")).alias("near"), "ord", "x", "y")).alias("m"))
        split = kept(split.where(-F.col("m.near") > tolerance).select(*keys, "_a", "m.ord", "m.x", "m.y"), "splits")
        parts.append(split.select(*keys, "ord", "x", "y"))
        mid = split.select(*keys, "_a", F.struct("ord", "x", "y").alias("m"))
        under = open_.withColumn("_a", F.col("a.ord")).join(mid, [*keys, "_a"]).where(F.col("ord") != F.col("m.ord"))
        before = F.col("ord") < F.col("m.ord")
        after = kept(under.select(*keys, "ord", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b")), "open")
        dropped(open_)
        open_ = after
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
