"""The routing network: edges with coordinates, without those that pass through walls, both ways, and connectors.

Edges and walls are dealt over the grid cells of their floor that they touch, as many as they are long, and
meet by equality of (floor, cell); boxes are compared before the crossing itself. A pair that crosses in
several cells counts once. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atriumq.functions import geometry as g


def placed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends; an edge whose end is not on its floor drops out."""
    a = nodes.select("floor", F.col("node").alias("from_node"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select("floor", F.col("node").alias("to_node"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.join(a, ["floor", "from_node"]).join(b, ["floor", "to_node"])


#: Side of a grid cell in pixels: a few times the usual wall, so that a piece seldom lies in many cells.
CELL = 128.0
_EDGE, _WALL = ("ax", "ay", "bx", "by"), ("sx", "sy", "ex", "ey")


def cell_of(x: Column, side: float = CELL) -> Column:
    return F.floor(x / side).cast("int")


def in_cells(df: DataFrame, ends: tuple[str, str, str, str], side: float = CELL) -> DataFrame:
    """A row for each cell (cx, cy) that the box around two points touches."""
    x0, y0, x1, y1 = ends
    span = lambda a, b: F.sequence(cell_of(F.least(a, b), side), cell_of(F.greatest(a, b), side))
    known = df.where(" AND ".join(f"{c} IS NOT NULL" for c in ends))
    return known.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def along_cells(df: DataFrame, ends: tuple[str, str, str, str], side: float = CELL) -> DataFrame:
    """A row for each cell (cx, cy) that the segment between two points touches: as many as it is long, not as its box is large."""
    known = df.where(" AND ".join(f"{c} IS NOT NULL" for c in ends))
    x0, y0, x1, y1 = map(F.col, ends)
    forth = x0 <= x1
    ax, ay, bx, by = (F.when(forth, p).otherwise(q) for p, q in ((x0, x1), (y0, y1), (x1, x0), (y1, y0)))
    slack = side * 1e-6

    def column(i: Column) -> Column:
        at = lambda x: F.when(bx > ax, ay + (x - ax) * (by - ay) / (bx - ax))
        p, q = F.coalesce(at(F.greatest(ax, i * side)), ay), F.coalesce(at(F.least(bx, (i + 1) * side)), by)
        rows = F.sequence(cell_of(F.least(p, q) - slack, side), cell_of(F.greatest(p, q) + slack, side))
        return F.transform(rows, lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    cells = F.flatten(F.transform(F.sequence(cell_of(ax - slack, side), cell_of(bx + slack, side)), column))
    return known.withColumn("_c", F.explode(cells)).select(*df.columns, "_c.cx", "_c.cy")


def _met(placed: DataFrame, walls: DataFrame) -> DataFrame:
    """(floor, from_node, to_node, wall...) of edges and the walls that they pass through, once for each cell that both touch there."""
    e = along_cells(placed.select("floor", "from_node", "to_node", *_EDGE), _EDGE).alias("e")
    w = along_cells(walls.select("floor", *(["wall"] if "wall" in walls.columns else []), *_WALL), _WALL).alias("w")
    at = [f"e.{c}" for c in _EDGE] + [f"w.{c}" for c in _WALL]
    same = (F.col("e.floor") == F.col("w.floor")) & (F.col("e.cx") == F.col("w.cx")) & (F.col("e.cy") == F.col("w.cy"))
    return e.join(w, same & g.boxes_meet(*at) & g.crosses(*at))


def crossings(placed: DataFrame, walls: DataFrame) -> DataFrame:
    """(floor, from_node, to_node, wall) for every wall that an edge passes through."""
    return _met(placed, walls).select("e.floor", "e.from_node", "e.to_node", "w.wall").distinct()


def _hit(placed: DataFrame, walls: DataFrame) -> DataFrame:
    return _met(placed, walls).select("e.floor", "e.from_node", "e.to_node").distinct()


def open_edges(placed: DataFrame, walls: DataFrame) -> DataFrame:
    """Edges that pass through no wall of their floor."""
    return placed.join(_hit(placed, walls), ["floor", "from_node", "to_node"], "left_anti")


def blocked_edges(placed: DataFrame, walls: DataFrame) -> DataFrame:
    return placed.join(_hit(placed, walls), ["floor", "from_node", "to_node"], "left_semi")


def flagged_edges(placed: DataFrame, walls: DataFrame) -> DataFrame:
    """Every edge, with whether a wall invalidates it."""
    hit = _hit(placed, walls).withColumn("invalid", F.lit(True))
    return placed.join(hit, ["floor", "from_node", "to_node"], "left").withColumn("invalid", F.coalesce("invalid", F.lit(False)))


def building_floors(floors: DataFrame, spatial: DataFrame, configs: DataFrame, key: str = "floor") -> DataFrame:
    """For every floor the floors of its building that have a spatial model, with their navigation if there is any."""
    other = floors.select("building", F.col(key).alias("other_floor"), F.col("ppm").alias("other_ppm"))
    out = floors.select("building", key).join(other, "building")
    have = spatial.select(F.col(key).alias("other_floor")).distinct()
    return out.join(have, "other_floor").join(configs.withColumnRenamed(key, "other_floor"), "other_floor", "left")


def sibling_floors(floors: DataFrame) -> DataFrame:
    """Pairs of different floors of a building."""
    b = floors.select("building", F.col("floor").alias("sibling"))
    return floors.select("building", "floor").join(b, "building").where("floor <> sibling")


def links(floors: DataFrame, nodes: DataFrame, edges: DataFrame, walls: DataFrame, connectors: DataFrame) -> DataFrame:
    """Directed links (building, src_floor, src, dst_floor, dst, metres, kind, label, accessible, ord).

    Edges go both ways and count as corridors, whatever they are stored as; connectors go back only
    if they are bidirectional. ``ord`` is the order in which links are tried: by floor, edges before
    connectors, by their own column ``ord`` where they have one, then by their ends, forward before back."""
    place = lambda df: F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
    home = floors.select("floor", "building", "ppm")
    scaled = open_edges(placed_edges(edges.drop("building"), nodes), walls).join(home, "floor")
    metres = g.edge_meters(g.distance("ax", "ay", "bx", "by"), "ppm")
    one = scaled.select("building", "floor", "from_node", "to_node", metres.alias("metres"), "accessible", place(scaled).alias("n"))
    ways = F.array(F.struct(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.lit(0).alias("back")), F.struct(F.col("to_node").alias("src"), F.col("from_node").alias("dst"), F.lit(1).alias("back")))
    level = one.withColumn("way", F.explode(ways)).select(
        "building", F.col("floor").alias("src_floor"), "way.src", F.col("floor").alias("dst_floor"), "way.dst", "metres", F.lit("corridor").alias("kind"), F.lit(None).cast("string").alias("label"), "accessible",
        F.struct(F.col("floor").alias("f"), F.lit(0).alias("t"), "n", F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("way.back").alias("r")).alias("ord"),
    )
    label = F.col("label") if "label" in connectors.columns else F.lit(None).cast("string")
    c = connectors.withColumn("n", place(connectors)).join(home.select(F.col("floor").alias("src_floor"), "building"), "src_floor").withColumn("metres", g.vertical_meters("kind")).withColumn("label", label)
    there = F.struct(F.col("src_floor").alias("sf"), F.col("src_node").alias("s"), F.col("dst_floor").alias("df"), F.col("dst_node").alias("d"), F.lit(0).alias("back"))
    back = F.struct(F.col("dst_floor").alias("sf"), F.col("dst_node").alias("s"), F.col("src_floor").alias("df"), F.col("src_node").alias("d"), F.lit(1).alias("back"))
    # No `when` around the second way: both branches of an array must have one type.
    c = c.withColumn("way", F.explode(F.filter(F.array(there, back), lambda w: (w["back"] == 0) | F.col("bidirectional"))))
    vertical = c.select(
        "building", F.col("way.sf").alias("src_floor"), F.col("way.s").alias("src"), F.col("way.df").alias("dst_floor"), F.col("way.d").alias("dst"), "metres", "kind", "label", "accessible",
        F.struct(F.col("src_floor").alias("f"), F.lit(1).alias("t"), "n", F.col("src_node").alias("a"), F.col("dst_node").alias("b"), F.col("way.back").alias("r")).alias("ord"),
    )
    return level.unionByName(vertical)


def known_links(all_links: DataFrame, nodes: DataFrame, accessible_only: bool = False) -> DataFrame:
    """Links between existing nodes; those of stale connectors drop out silently."""
    key = nodes.select("floor", "node").distinct()
    out = all_links.where("accessible") if accessible_only else all_links
    out = out.join(key.select(F.col("floor").alias("src_floor"), F.col("node").alias("src")), ["src_floor", "src"], "left_semi")
    return out.join(key.select(F.col("floor").alias("dst_floor"), F.col("node").alias("dst")), ["dst_floor", "dst"], "left_semi")
