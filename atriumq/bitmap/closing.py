"""Closing along straight lines in many directions, and the gaps that it fills.

For a direction every pixel lies on one digital line and has a place on it; along a line, stretches between
pixels that are short enough are filled. Nothing is filled between a pixel and the frame, so margins stay free.
All directions are looked at in one pass over tiles, which a pixel is sent to once, whatever the number of directions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atriumq.bitmap.runs import merged, pixels_of


def odd_length(pixels: float) -> int:
    """Length of a line element of about ``pixels``: odd, at least three."""
    return max(3, int(round(pixels))) | 1


def slopes(orientations: int = 12) -> list[tuple[bool, float, float, float]]:
    """(whether x is the place, step of the line's other coordinate a place, cosine, sine) of each direction."""
    out = []
    for k in range(orientations):
        c, s = math.cos(math.pi * k / orientations), math.sin(math.pi * k / orientations)
        flat = abs(c) >= abs(s)
        out.append((flat, round(s / c if flat else c / s, 12), c, s))
    return out


def longest_gap(length: int, k: int, orientations: int = 12) -> int:
    """Places that closing by a line element of ``length`` pixels fills in direction k."""
    _, _, c, s = slopes(orientations)[k]
    r = (length - 1) / 2
    return 2 * max(abs(round(c * r)), abs(round(s * r)))


#: Least side in pixels of the tiles that lines are looked at in.
TILE = 256


def _half_up(v: np.ndarray) -> np.ndarray:
    return np.floor(v + 0.5).astype(np.int64)


def _gaps(x: np.ndarray, y: np.ndarray, own: np.ndarray, length: np.ndarray, way: tuple[bool, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel before, px, py) of what closing in one direction fills behind the tile's own pixels."""
    flat, step, c, s = way
    at, other = (x, y) if flat else (y, x)
    line = other - _half_up(at * step)
    most = 2 * np.maximum(np.abs(np.rint(c * (length - 1) / 2)), np.abs(np.rint(s * (length - 1) / 2)))
    order = np.lexsort((at, line))
    gap = np.diff(at[order]) - 1
    hit = np.flatnonzero((np.diff(line[order]) == 0) & (gap > 0) & (gap <= most[order[:-1]]) & own[order[:-1]])
    n = gap[hit]
    before = np.repeat(order[hit], n)
    t = at[before] + np.arange(1, len(before) + 1) - np.repeat(np.cumsum(n) - n, n)
    o = line[before] + _half_up(t * step)
    return before, *((t, o) if flat else (o, t))


def _tiled(pixels: DataFrame, length: Column | int, keys: list[str]) -> DataFrame:
    """(keys, px, py, _len, _tx, _ty): pixels in their tile and in those that lie within a line's length."""
    p = pixels.select(*keys, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), (F.lit(length) if isinstance(length, int) else length).cast("double").alias("_len")).dropna()
    halo = F.greatest(F.ceil("_len"), F.lit(0)) + 2
    side = F.greatest(F.lit(TILE), 4 * halo)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    return p.withColumn("_tx", tiles("px")).withColumn("_ty", tiles("py"))


def _of_tile(tile: pa.Table, ways: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(px, py, which pixels are the tile's own, (direction, pixel before, px, py) of what is filled) in a tile."""
    x, y, n = (tile.column(c).to_numpy() for c in ("px", "py", "_len"))
    wide = max(least, 4 * (max(math.ceil(n[0]), 0) + 2))
    own = (x // wide == tile.column("_tx")[0].as_py()) & (y // wide == tile.column("_ty")[0].as_py())
    return x, y, own, [(k, *_gaps(x, y, own, n, way)) for k, way in enumerate(ways)]


def bridged(pixels: DataFrame, length: Column | int, orientations: int = 12, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, angle, px, py): free pixels that closing by a line of ``length`` fills, for each direction.

    length may be a column of the pixels, the same for all of a bitmap. A pixel goes to its tile and to those that
    lie within a line's length; a gap is told by the tile of the pixel before it."""
    keys, least = list(keys), TILE
    p = _tiled(pixels, length, keys)
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    ways = slopes(orientations)

    def run(tile: pa.Table) -> pa.Table:
        _, _, _, found = _of_tile(tile, ways, least)
        angle = np.concatenate([np.full(len(f[1]), f[0], dtype=np.int32) for f in found])
        before, px, py = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
        out = tile.select(keys).take(pa.array(before))
        for name, values in (("angle", angle), ("px", px), ("py", py)):
            out = out.append_column(name, pa.array(values))
        return out

    return p.groupBy(*keys, "_tx", "_ty").applyInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, angle int, px long, py long")


def sealed_runs(pixels: DataFrame, length: Column | int, orientations: int = 12, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, y, x0, x1): runs of the pixels and all that closing in any direction adds.

    A tile tells what its directions fill once, as runs, so that rows between tasks follow the runs and not the fillings."""
    keys, least = list(keys), TILE
    p = _tiled(pixels, length, keys)
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    ways = slopes(orientations)

    def run(tile: pa.Table) -> pa.Table:
        x, y, own, found = _of_tile(tile, ways, least)
        px, py = np.concatenate([x[own], *(f[2] for f in found)]), np.concatenate([y[own], *(f[3] for f in found)])
        if not len(px):
            px = py = np.zeros(0, dtype=np.int64)
        low, wide = px.min(initial=0), px.max(initial=0) - px.min(initial=0) + 2
        code = np.unique(py * wide + px - low)  # a free place at the end of each line keeps lines apart
        new = np.flatnonzero(np.diff(code, prepend=np.iinfo(np.int64).min // 2) != 1)
        first, last = code[new], code[np.append(new[1:], len(code)) - 1] if len(code) else code
        out = tile.select(keys).take(pa.array(np.zeros(len(first), dtype=np.int64)))
        for name, values in (("y", first // wide), ("x0", first % wide + low), ("x1", last % wide + low)):
            out = out.append_column(name, pa.array(values))
        return out

    return merged(p.groupBy(*keys, "_tx", "_ty").applyInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, y long, x0 long, x1 long"), keys)


def sealed(pixels: DataFrame, length: Column | int, orientations: int = 12, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, px, py): the pixels and all that closing in any direction adds, each once."""
    return pixels_of(sealed_runs(pixels, length, orientations, keys), keys=keys)
