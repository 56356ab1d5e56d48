"""Convex hulls of groups of any size, and the least boxes around them.

A hull of hulls is the hull of all points, so hulls are made of parts first: of each line of a group only its
ends count, lines are dealt in blocks, a block becomes its hull in a task, and a group's blocks are merged. A least box
has a side along an edge of the hull: edges meet the hull's points by join, and the best edge is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.checkpoint import kept

#: Points that are dealt to a task, about; small groups share one.
DEALT = 50_000
#: Lines of a group whose ends are one block.
BLOCK = 4096


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Lower side of the hull of sorted points."""
    out: list[tuple[float, float]] = []
    for q in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
            out.pop()
        out.append(q)
    return out


def hulls(points: DataFrame, of: Sequence[str]) -> DataFrame:
    """(of, ord, x, y): corners of the convex hull of each group, in turn from the first by x and y; no three on a line."""
    of = list(of)
    p = points.select(*of, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    lines = p.groupBy(*of, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = lines.select(*of, "y", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")).withColumn("_block", F.floor(F.col("y") / BLOCK))
    ends = kept(ends, "ends")
    kinds = {f.name: f.dataType.simpleString() for f in ends.schema}
    shape = lambda keys: ", ".join(f"{k} {kinds[k]}" for k in keys)
    n = max(1, -(-ends.count() // DEALT))
    dealt = lambda df, keys: df.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("_deal")

    def cornered(table: pa.Table, keys: list[str]) -> pa.Table:
        """The hulls of all groups of a table: keys, ord, x, y."""
        groups: dict[tuple, set] = {}
        for key, x, y in zip(zip(*(table.column(k).to_pylist() for k in keys)), table.column("x").to_pylist(), table.column("y").to_pylist()):
            groups.setdefault(key, set()).add((x, y))
        rows = []
        for key, found in groups.items():
            pts = sorted(found)
            pts = pts if len(pts) < 3 else _chain(pts)[:-1] + _chain(pts[::-1])[:-1]
            rows += [(*key, k, x, y) for k, (x, y) in enumerate(pts)]
        types = [*(table.column(k).type for k in keys), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip([*keys, "ord", "x", "y"], types))})

    parts = dealt(ends, [*of, "_block"]).applyInArrow(lambda t: cornered(t, [*of, "_block"]), f"{shape([*of, '_block'])}, ord long, x double, y double")
    return dealt(parts.drop("_block", "ord"), of).applyInArrow(lambda t: cornered(t, of), f"{shape(of)}, ord long, x double, y double")


def least_boxes(points: DataFrame, of: Sequence[str]) -> DataFrame:
    """(of, cx, cy, ux, uy, long_side, short_side): the smallest box around each group, u along its longer side.

    Of boxes that are equal to nine digits the one of the first hull edge stands; a group of one point has sides of 0."""
    of = list(of)
    h = hulls(points, of)
    n = h.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"))
    then = h.select(*of, F.col("ord").alias("_o"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = h.join(n, of).withColumn("_o", (F.col("ord") + 1) % F.col("_n")).join(then, [*of, "_o"])
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    edges = edges.select(*of, "ord", F.when(size > 0, dx / size).otherwise(1.0).alias("ux"), F.when(size > 0, dy / size).otherwise(0.0).alias("uy"))
    at = edges.join(h.select(*of, "x", "y"), of)
    a, b = F.col("x") * F.col("ux") + F.col("y") * F.col("uy"), F.col("y") * F.col("ux") - F.col("x") * F.col("uy")
    spans = at.groupBy(*of, "ord", "ux", "uy").agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
    la, lb = F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")
    box = F.min(F.struct(F.round(la * lb, 9).alias("area"), "ord", "ux", "uy", "a0", "a1", "b0", "b1")).alias("m")
    out = spans.groupBy(*of).agg(box).select(*of, "m.*")
    ma, mb, along = (F.col("a0") + F.col("a1")) / 2, (F.col("b0") + F.col("b1")) / 2, la >= lb
    return out.select(
        *of, (F.col("ux") * ma - F.col("uy") * mb).alias("cx"), (F.col("uy") * ma + F.col("ux") * mb).alias("cy"),
        F.when(along, F.col("ux")).otherwise(-F.col("uy")).alias("ux"), F.when(along, F.col("uy")).otherwise(F.col("ux")).alias("uy"), F.greatest(la, lb).alias("long_side"), F.least(la, lb).alias("short_side"),
    )
