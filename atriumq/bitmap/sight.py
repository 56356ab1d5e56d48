"""Straight lines over a bitmap: the cells that they touch, and who sees whom past a barrier.

The cells of a segment are one array expression over whole numbers, exact, as many as the segment is long; a pair
sees each other if none of its cells is a barrier, which is one join by cell. No bitmap is held anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    """Array of (x, y): all unit cells, around whole coordinates and closed, that the segment between two cell centres touches."""
    ax, ay, bx, by = (F.col(c).cast("long") if isinstance(c, str) else c.cast("long") for c in (ax, ay, bx, by))
    w, h = F.abs(bx - ax), F.abs(by - ay)
    sx, sy = F.signum((bx - ax).cast("double")).cast("long"), F.signum((by - ay).cast("double")).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def column(k: Column) -> Column:
        # Between half a column before and after, the segment climbs from lo * h / 2w to hi * h / 2w.
        lo, hi = F.greatest(2 * k - 1, zero), F.least(2 * k + 1, 2 * w)
        d = F.greatest(2 * w, one)
        low = F.when(w == 0, zero).otherwise(F.greatest(zero, F.floor((lo * h - w + d - 1) / d)))
        high = F.when(w == 0, h).otherwise(F.least(h, F.floor((hi * h + w) / d)))
        return F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda j: F.struct((ax + sx * k).alias("x"), (ay + sy * j).alias("y")))

    return F.flatten(F.transform(F.sequence(zero, w), column))


def in_sight(pairs: DataFrame, barrier: DataFrame, of: Sequence[str], keys: Sequence[str] = ("floor",)) -> DataFrame:
    """The pairs (keys, of, ax, ay, bx, by, ...) that no barrier pixel (keys, px, py) lies between, touching included.

    of names a pair within its bitmap; repeated pairs stand or fall together."""
    lines = pairs.select(*keys, *of, F.explode(cells("ax", "ay", "bx", "by")).alias("_c")).select(*keys, *of, F.col("_c.x").alias("px"), F.col("_c.y").alias("py"))
    walls = barrier.select(*keys, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))
    shut = lines.join(walls, [*keys, "px", "py"], "left_semi").select(*keys, *of).distinct()
    return pairs.join(shut, [*keys, *of], "left_anti")


def mutual(points: DataFrame, barrier: DataFrame, group: str, far: float, point: str = "point", keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, group, a, b, ax, ay, bx, by): points of a group, at most ``far`` apart, that see each other, each pair once.

    Points meet in square cells of side ``far`` and the ones around them, so a group is never paired off as a whole."""
    side = F.lit(far)
    cell = lambda c: F.floor(F.col(c) / side)
    p = points.select(*keys, group, F.col(point).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = p.select(*keys, group, F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), "_cx", "_cy", F.explode(around).alias("_o"))
    q = q.select(*keys, group, "b", "bx", "by", (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"))
    near = (F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2 <= far * far
    met = p.join(q, [*keys, group, "_cx", "_cy"]).where((F.col("a") < F.col("b")) & near).drop("_cx", "_cy")
    return in_sight(met, barrier, ("a", "b"), keys)
