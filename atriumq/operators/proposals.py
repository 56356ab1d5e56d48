"""From a structural analysis to an editable model: wall segments, labelled nodes, surviving edges, places at nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriumq.checkpoint import kept
from atriumq.functions import geometry as g

from .checks import NODE_KINDS, known_kind
from .network import blocked_edges, open_edges, placed_edges

# Label prefixes by kind, and the most wall segments of a floor, for those who ask for a cut.
PREFIX = {"decision": "G", "waypoint": "N", "door": "P", "entrance": "E", "room": "S", "connector": "C"}
MAX_SEGMENTS = 4000


def ring_segments(polygons: DataFrame) -> DataFrame:
    """(floor, ord, sx, sy, ex, ey): the sides of all rings, outer and holes, in order.

    polygons: (floor, ord, rings) with rings an array of arrays of structs of x and y."""
    rings = polygons.select("floor", "ord", F.posexplode("rings").alias("ring_no", "ring")).where(F.size("ring") >= 2)
    side = F.zip_with(F.col("ring"), F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("sx"), a["y"].alias("sy"), b["x"].alias("ex"), b["y"].alias("ey")))
    out = rings.select("floor", "ord", "ring_no", F.posexplode(side).alias("side_no", "s"))
    return out.select("floor", F.struct("ord", "ring_no", "side_no").alias("ord"), "s.*")


def first_of(df: DataFrame, keys: list, order: str = "ord") -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def wall_segments(segments: DataFrame, most: int | None = None) -> DataFrame:
    """Segments of at least two pixels, one of those that lie within two pixels of each other in either direction; only the first ``most`` of a floor if given."""
    long_ = segments.where(g.distance("sx", "sy", "ex", "ey") >= 2)
    r = {c: F.bround(F.col(c) / 2).cast("long") for c in ("sx", "sy", "ex", "ey")}
    there = F.struct(r["sx"].alias("a"), r["sy"].alias("b"), r["ex"].alias("c"), r["ey"].alias("d"))
    back = F.struct(r["ex"].alias("a"), r["ey"].alias("b"), r["sx"].alias("c"), r["sy"].alias("d"))
    once = first_of(long_.withColumn("_key", F.least(there, back)), ["floor", "_key"]).drop("_key")
    if most is None:
        return once
    return once.withColumn("n", F.row_number().over(Window.partitionBy("floor").orderBy("ord"))).where(F.col("n") <= most)


def labelled_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with known kinds, and labels for those without: a letter and the node's number within its kind."""
    kind = known_kind(F.col("kind"), NODE_KINDS, "waypoint")
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("kind"))
    out = nodes.withColumn("kind", kind)
    number = F.row_number().over(Window.partitionBy("floor", "kind").orderBy("ord"))
    given = F.trim(F.coalesce("label", F.lit("")))
    return out.withColumn("label", F.when(given != "", given).otherwise(F.concat(prefix, number.cast("string"))))


def node_ids(nodes: DataFrame, key: str = "node") -> DataFrame:
    """A stable id for every proposed node: reruns give the same."""
    return nodes.withColumn("id", F.sha2(F.concat_ws(":", "floor", key), 256).substr(1, 32))


def surviving_edges(edges: DataFrame, nodes: DataFrame, walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): edges between two known nodes, the first of each undirected pair, split by whether walls let them pass."""
    known = placed_edges(edges, nodes).where("from_node <> to_node")
    pair = first_of(known.withColumn("_a", F.least("from_node", "to_node")).withColumn("_b", F.greatest("from_node", "to_node")), ["floor", "_a", "_b"]).drop("_a", "_b")
    pair = pair.withColumn("kind", F.when(F.col("kind") == "doorway", "doorway").otherwise("corridor"))
    return open_edges(pair, walls), blocked_edges(pair, walls)


def candidates(points: DataFrame, nodes: DataFrame, key: str, most: int = 400, radius: float | None = None) -> DataFrame:
    """(floor, key, place, node, distance): the ``most`` nearest nodes of the floor, nearest first, ties in node
    order, within ``radius`` if given. Points and nodes without finite coordinates take no part.

    Cells have sides of 1, 2, 4 ... pixels. A point takes the least side at which the three by three cells around it
    hold ``most`` nodes: none of its nearest lies farther than their diagonal, and cells four times as wide, again
    three by three, hold all of that. So a point meets some tens of times ``most`` nodes however many its floor
    has; where they are too few, it looks as far as its floor or the radius goes. Of nodes in one place the first ``most`` count."""
    finite = lambda df, *cs: df.where(" AND ".join(f"abs({c}) < double('infinity')" for c in cs))
    # A table's files may be small and its rows many: nothing here is to be sent whole to every task.
    large = lambda df: df.hint("merge")
    n = finite(nodes.select("floor", "node", "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "x", "y")
    n = n.withColumn("_n", F.row_number().over(Window.partitionBy("floor", "x", "y").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    box = n.groupBy("floor").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    doubled = lambda c: F.greatest(F.ceil(F.log2(F.greatest(c, F.lit(1.0)))), F.lit(0)).cast("int")
    # How far a point must look until it has seen the whole floor, or the radius, and the side, as a power of two, that is enough for it.
    asked = finite(points.select("floor", key, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")), "px", "py").join(box, "floor")
    reach = F.greatest(*[F.abs(F.col(p) - F.col(c)) for p, c in (("px", "x0"), ("px", "x1"), ("py", "y0"), ("py", "y1"))])
    asked = asked.withColumn("_all", doubled(F.least(reach, F.lit(radius)) if radius is not None else reach))
    asked = asked.select("floor", key, "px", "py", F.floor("px").alias("_i"), F.floor("py").alias("_j"), "_all")
    # Cells around which there are enough nodes, for every side up to the floor's.
    level = lambda df, top: df.withColumn("_l", F.explode(F.sequence(F.lit(0), top))).withColumns({"cx": F.expr("shiftright(_i, _l)"), "cy": F.expr("shiftright(_j, _l)")})
    widest = doubled(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    dots = n.groupBy("floor", F.floor("x").alias("_i"), F.floor("y").alias("_j")).agg(F.count("*").alias("n")).join(box, "floor")
    full = level(dots, widest).groupBy("floor", "_l", "cx", "cy").agg(F.sum("n").alias("n"))
    around = lambda df: df.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    full = around(full).groupBy("floor", "_l", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") >= most).drop("n")
    pixels = level(asked.groupBy("floor", "_i", "_j").agg(F.max("_all").alias("_all")), F.col("_all"))
    found = pixels.join(large(full), ["floor", "_l", "cx", "cy"]).groupBy("floor", "_i", "_j").agg(F.min("_l").alias("_found"))
    asked = asked.join(large(found), ["floor", "_i", "_j"], "left").withColumn("_l", F.least(F.col("_found") + 2, F.col("_all")))
    farthest = F.pow(F.lit(2.0), F.col("_found")) * 2.8285  # a diagonal of two cells, and a little
    asked = asked.withColumn("_far", F.coalesce(farthest, F.lit(float("inf"))))
    at = n.join(asked.select("floor", "_l").distinct(), "floor").withColumns({"_i": F.floor("x"), "_j": F.floor("y")})
    at = at.select("floor", "_l", F.expr("shiftright(_i, _l)").alias("cx"), F.expr("shiftright(_j, _l)").alias("cy"), "node", "ord", "x", "y")
    looked = around(asked.withColumns({"cx": F.expr("shiftright(_i, _l)"), "cy": F.expr("shiftright(_j, _l)")})).select("floor", key, "px", "py", "_far", "_l", "cx", "cy")
    met = looked.join(large(at), ["floor", "_l", "cx", "cy"]).withColumn("distance", g.distance("px", "py", "x", "y")).where(F.col("distance") <= F.col("_far"))
    if radius is not None:
        met = met.where(F.col("distance") < radius)
    place = F.row_number().over(Window.partitionBy("floor", key).orderBy("distance", "ord"))
    return met.select("floor", key, "node", "ord", "distance").withColumn("place", place).where(F.col("place") <= most).select("floor", key, "place", "node", "distance")


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, radius: float | None = None) -> DataFrame:
    """(floor, key, node, distance): the nearest node of the floor, ties to the first, within ``radius`` if given."""
    return candidates(points, nodes, key, 1, radius).select("floor", key, "node", "distance")


def thinned(points: DataFrame, keys: list[str], most: int = 40, order: str = "ord") -> DataFrame:
    """Every so-manieth point of a path, so that about ``most`` are left."""
    path = Window.partitionBy(*keys)
    at = F.row_number().over(path.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(path) / most).cast("int"))
    return points.withColumn("_at", at).withColumn("_step", step).where("_at % _step = 0").drop("_at", "_step")


def in_order(**parts: DataFrame) -> DataFrame:
    """Polygons of several kinds as one table, ordered by kind as given and by their own order within it."""
    out = None
    for rank, (kind, df) in enumerate(parts.items()):
        df = df.select("floor", "ord", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("n", F.row_number().over(Window.partitionBy("floor").orderBy("rank", "ord")))


def reattached(pois: DataFrame, nodes: DataFrame) -> DataFrame:
    """(floor, poi, node): the nearest room or connector if it is not over 2.5 times as far as the nearest node, else that."""
    every = nearest_node(pois, nodes, "poi")
    anchor = nearest_node(pois, nodes.where(F.col("kind").isin("room", "connector")), "poi").select("floor", "poi", F.col("node").alias("anchor"), F.col("distance").alias("far"))
    near: Column = F.col("far") <= 2.5 * F.greatest("distance", F.lit(1.0))
    return every.join(anchor, ["floor", "poi"], "left").select("floor", "poi", F.when(near, F.col("anchor")).otherwise(F.col("node")).alias("node"))


def without_nodes(gone: DataFrame, pois: DataFrame, edges: DataFrame, connectors: DataFrame, anchors: DataFrame) -> dict[str, DataFrame]:
    """What is left when nodes (floor, node) are deleted: their places, edges, anchors and the connectors that start there go too."""
    drop = lambda df, floor, node: df.join(gone.select(F.col("floor").alias(floor), F.col("node").alias(node)), [floor, node], "left_anti")
    return {
        "pois": drop(pois, "floor", "node"),
        "edges": drop(drop(edges, "floor", "from_node"), "floor", "to_node"),
        "connectors": drop(connectors, "src_floor", "src_node"),
        "anchors": drop(anchors, "floor", "node"),
    }


def proposal(floors: DataFrame, polygons: DataFrame, nodes: DataFrame, edges: DataFrame, pois: DataFrame) -> dict[str, DataFrame]:
    """The editable model of every analysed floor, as tables walls, nodes, edges, pois and diagnostics.

    floors: (floor, and whatever is known of it); polygons: (floor, ord, rings) of walls, obstacles and windows in
    their order; nodes: (floor, node, ord, x, y, kind, label); edges: (floor, from_node, to_node, kind, ord); pois:
    (floor, poi, x, y). Edges meet the very segments that are stored; a floor with fewer than two nodes or
    without an edge left is refused: it is in diagnostics, with the reason, and nowhere else."""
    walls = kept(wall_segments(ring_segments(polygons)), "walls")
    named = kept(node_ids(labelled_nodes(nodes)), "nodes")
    passing, crossing = surviving_edges(edges, named.drop("ord"), walls)
    passing = kept(passing.select("floor", "from_node", "to_node", "kind").withColumn("accessible", F.lit(True)), "edges")
    count = lambda df, name: df.groupBy("floor").agg(F.count("*").alias(name))
    out = floors.select("floor").distinct()
    for df, name in ((walls, "walls"), (named, "nodes"), (passing, "edges"), (crossing, "edges_rejected_by_walls")):
        out = out.join(count(df, name), "floor", "left").fillna(0, [name])
    reason = F.when(F.col("nodes") < 2, "too-few-nodes").when(F.col("edges") < 1, "no-edges")
    out = kept(out.withColumn("refused", reason), "diagnostics")
    good = out.where("refused IS NULL").select("floor")
    mine = lambda df: df.join(good, "floor", "left_semi")
    placed = pois.join(reattached(mine(pois), mine(named)).withColumnRenamed("node", "node_id"), ["floor", "poi"])
    return {"walls": mine(walls), "nodes": mine(named), "edges": mine(passing), "pois": placed, "diagnostics": out}
