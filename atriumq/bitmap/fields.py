"""Distances to the nearest obstacle, and what follows from them: how wide a space is and where its middle lies.

The distance is separable. Along a row it comes from the run that a pixel lies in; along a column the least of
squares is taken over strips of STRIP columns, each an array in a task: as high as the frame, no wider than that. What is
sent to a strip are runs; pixels are made there."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns that a task holds at once.
STRIP = 256


def _down(squares: np.ndarray, most: float) -> np.ndarray:
    """Least of squares[y'] + (y - y')**2 over every column."""
    best, k = squares.copy(), 1
    while k < len(best) and k * k < min(most, best.max()):
        np.minimum(best[k:], squares[:-k] + k * k, out=best[k:])
        np.minimum(best[:-k], squares[k:] + k * k, out=best[:-k])
        k += 1
    return best


def distances(rows: DataFrame, frames: DataFrame, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, px, py, distance): Euclidean distance of every pixel of the runs to the nearest pixel of the frame in none.

    The frame's border is no obstacle; where a frame has no free pixel at all, distances are infinite."""
    keys = list(keys)
    p = rows.join(frames.select(*keys, "width", "height"), keys)
    strips = F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP))
    p = p.select(*keys, F.col("x0").alias("px"), "x1", F.col("y").alias("py"), "width", F.col("height").cast("long").alias("height"), F.explode(strips).alias("_strip"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    kind = to_arrow_schema(p.select("px", "py").schema)

    def run(strip: pa.Table) -> pa.Table:
        x0, x1, row, width = (strip.column(c).to_numpy() for c in ("px", "x1", "py", "width"))
        height, left = strip.column("height")[0].as_py(), strip.column("_strip")[0].as_py() * STRIP
        first, last = np.maximum(x0, left), np.minimum(x1, left + STRIP - 1)
        size = last - first + 1
        of = np.repeat(np.arange(len(size)), size)
        x = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of]
        y, before, after = row[of], (x - x0[of] + 1).astype(float), (x1[of] - x + 1).astype(float)
        before[x0[of] <= 0], after[x1[of] >= width[of] - 1] = np.inf, np.inf
        g, x0 = np.minimum(before, after), x.min()
        # One free row above and below tells all that free pixels beyond would; beyond the frame there is nothing.
        lo, hi = y.min() - 1, y.max() + 1
        squares = np.zeros((hi - lo + 1, x.max() - x0 + 1))
        squares[y - lo, x - x0] = g * g
        if lo < 0:
            squares[0] = np.inf
        if hi >= height:
            squares[-1] = np.inf
        d = np.sqrt(_down(squares, float(hi - lo + 1) ** 2))
        same = [pa.repeat(strip.column(k)[0], len(x)) for k in keys]
        return pa.table([*same, pa.array(x, kind.field("px").type), pa.array(y, kind.field("py").type), pa.array(d[y - lo, x - x0])], names=[*keys, "px", "py", "distance"])

    return p.groupBy(*keys, "_strip").applyInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, px {kinds['px']}, py {kinds['py']}, distance double")


def poles(distance: DataFrame, of: Sequence[str]) -> DataFrame:
    """(of, px, py, radius, narrowness): the pixel of each group that is farthest from any obstacle, the first in reading order of equals."""
    best = distance.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct((-F.col("distance")).alias("near"), "py", "px")).alias("m"))
    radius = -F.col("m.near")
    return best.select(*of, F.col("m.px").alias("px"), F.col("m.py").alias("py"), radius.alias("radius"), (radius / F.greatest(F.sqrt("_n"), F.lit(1.0))).alias("narrowness"))
