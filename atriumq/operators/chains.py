"""Undirected graphs made smaller: chains contracted, spurs pruned, junctions merged, straight waypoints left out.

Edges are rows (keys, a, b, length); every rule is decided for all graphs at once, by joins and aggregates, in
rounds where one decision opens the next. Loops and edges without a length take no part unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.bitmap.sight import in_sight
from atriumq.checkpoint import dropped, kept

from .graphs import contracted_labels
from .greedy import independent


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table of a round that joins do not send through the driver, however small it is."""
    return kept(df, name).hint("merge")


def _ends(edges: DataFrame, keys: Sequence[str], *also: str) -> DataFrame:
    """(keys, node, other, also): every edge from both of its ends."""
    return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other"), *also).unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"), *also))


def _neat(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with a < b, the shortest of those between the same nodes, without loops."""
    e = edges.where(F.col("a") != F.col("b")).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in {*keys, "a", "b"}])
    rest = [c for c in e.columns if c not in {*keys, "a", "b", "length"}]
    return e.groupBy(*keys, "a", "b").agg(F.min(F.struct("length", *rest)).alias("_e")).select(*keys, "a", "b", "_e.*")


def chains(edges: DataFrame, protected: DataFrame | None = None, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, a, b, length, inner): edges once nodes of degree two are left out, but for protected ones (keys, node).

    A chain is a component of such nodes; its length is the sum of its edges, its ends are what its outer edges
    lead to. Chains between the same nodes, also as an edge, all stay; a chain from a node to itself has a = b;
    a ring with no other node in it goes from its smallest node to itself."""
    keys = list(keys)
    e = kept(edges.where(F.col("a") != F.col("b")).select(*keys, "a", "b", F.col("length").cast("double").alias("length")), "edges")
    inner = _ends(e, keys).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*keys, "node")
    if protected is not None:
        inner = inner.join(protected.select(*keys, "node"), [*keys, "node"], "left_anti")
    inner = kept(inner, "inner")
    mark = lambda df, c: df.join(inner.select(*keys, F.col("node").alias(c), F.lit(True).alias(f"in_{c}")), [*keys, c], "left").fillna(False, [f"in_{c}"])
    e = kept(mark(mark(e, "a"), "b"), "edges")
    labels = contracted_labels(e.where("in_a AND in_b"), keys)
    chain = inner.join(labels, [*keys, "node"], "left").select(*keys, "node", F.coalesce("component", "node").alias("chain"))
    chain = kept(chain, "chains")
    of = F.when(F.col("in_a"), F.col("a")).otherwise(F.col("b"))
    parts = e.where("in_a OR in_b").withColumn("node", of).join(chain, [*keys, "node"])
    outer = F.when(~(F.col("in_a") & F.col("in_b")), F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a")))
    sums = parts.groupBy(*keys, "chain").agg(F.sum("length").alias("length"), F.min(outer).alias("a"), F.max(outer).alias("b"))
    sums = sums.join(chain.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("inner")), [*keys, "chain"])
    long_ = sums.select(*keys, F.coalesce("a", "chain").alias("a"), F.coalesce("b", "chain").alias("b"), "length", "inner")
    plain = e.where("NOT in_a AND NOT in_b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length", F.lit(0).cast("long").alias("inner"))
    return plain.unionByName(long_)


def pruned(edges: DataFrame, width: DataFrame, least: float, share: float = 1.6, protected: DataFrame | None = None, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """(keys, a, b, length, inner): chains once spurs are gone: chains to a free end that are shorter than ``least`` and than
    ``share`` of the width (keys, node, width) where they hang on. What a removed spur opens is looked at again, to the fixed point.

    Of a chain with two free ends none is a spur; protected ends keep their chains."""
    keys = list(keys)
    now = kept(_neat(chains(edges, protected, keys), keys), "chains")
    while True:
        both = _ends(now, keys, "length")
        degree = both.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"))
        tip = both.join(degree.where("n = 1").select(*keys, "node"), [*keys, "node"], "left_semi")
        if protected is not None:
            tip = tip.join(protected.select(*keys, "node"), [*keys, "node"], "left_anti")
        tip = tip.join(degree.where("n > 1").select(*keys, F.col("node").alias("other")), [*keys, "other"], "left_semi")
        wide = width.select(*keys, F.col("node").alias("other"), "width")
        spur = tip.join(wide, [*keys, "other"], "left").where(F.col("length") < F.greatest(F.lit(float(least)), share * F.coalesce("width", F.lit(0.0))))
        spur = kept(spur.select(*keys, F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), "spurs")
        if spur.isEmpty():
            return now
        rest = now.join(spur, [*keys, "a", "b"], "left_anti")
        inner = rest.select(*keys, "a", "b", "length")
        after = kept(_neat(chains(inner, protected, keys), keys), "chains")
        dropped(now)
        now = after


def merged(nodes: DataFrame, edges: DataFrame, near: float, protected: DataFrame | None = None, keys: Sequence[str] = ("floor",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) once junctions of degree three and more that an edge joins and that lie nearer than ``near`` are one, halfway.

    A round takes the pairs in which each is the other's nearest, ties by number, and rounds go on while there are any;
    the smaller number stays. Of edges between the same nodes the shortest stays. Tables of a round meet by sorted
    joins: each would be small enough to broadcast, but over the rounds all of them would pass through the driver."""
    keys = list(keys)
    n = _kept(nodes.select(*keys, "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "nodes")
    e = _kept(_neat(edges.select(*keys, "a", "b", "length"), keys), "edges")
    while True:
        both = _ends(e, keys)
        hub = both.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*keys, "node")
        if protected is not None:
            hub = hub.join(protected.select(*keys, "node"), [*keys, "node"], "left_anti")
        hub = n.join(hub, [*keys, "node"], "left_semi").hint("merge")
        pair = both.join(hub, [*keys, "node"]).join(hub.select(*keys, F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), [*keys, "other"])
        far = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
        pair = pair.withColumn("far", far).where(F.col("far") < near)
        best = pair.groupBy(*keys, "node").agg(F.min(F.struct("far", F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"))).alias("m")).select(*keys, "node", "m.lo", "m.hi")
        one = _kept(best.groupBy(*keys, "lo", "hi").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select(*keys, "lo", "hi"), "pairs")
        if one.isEmpty():
            return n, e
        xy = n.select(*keys, F.col("node").alias("lo"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        mid = one.join(xy, [*keys, "lo"]).join(n.select(*keys, F.col("node").alias("hi"), F.col("x").alias("bx"), F.col("y").alias("by")), [*keys, "hi"])
        mid = mid.select(*keys, F.col("lo").alias("node"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
        gone = one.select(*keys, F.col("hi").alias("node"))
        n = _kept(n.join(gone, [*keys, "node"], "left_anti").join(mid.select(*keys, "node"), [*keys, "node"], "left_anti").unionByName(mid), "nodes")
        for c in ("a", "b"):
            e = e.join(one.select(*keys, F.col("hi").alias(c), "lo"), [*keys, c], "left").withColumn(c, F.coalesce("lo", c)).drop("lo")
        e = _kept(_neat(e, keys), "edges")


def straightened(nodes: DataFrame, edges: DataFrame, barrier: DataFrame, cosine: float = -0.94, keys: Sequence[str] = ("floor",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without waypoints of degree two that lie on a straight line between neighbours who see each other.

    edges: (keys, a, b, kind); a merged edge is a doorway if either was. Of waypoints that could go, those go at once
    of which no neighbour goes, smaller numbers first; then the rest is looked at again, to the fixed point."""
    keys = list(keys)
    n = kept(nodes.select(*keys, "node", "kind", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), "nodes")
    e = kept(edges.where(F.col("a") != F.col("b")).groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.col("kind") == "doorway").alias("door")), "edges")
    while True:
        at = n.select(*keys, F.col("node").alias("other"), F.struct(F.col("node").alias("id"), "x", "y").alias("p"))
        near = _ends(e, keys, "door").join(at, [*keys, "other"]).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"), F.max("p").alias("q"), F.max("door").alias("door"))
        w = n.where("kind = 'waypoint'").join(near.where("n = 2"), [*keys, "node"])
        ux, uy, vx, vy = F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y"), F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")
        size = F.sqrt((ux * ux + uy * uy).cast("double")) * F.sqrt((vx * vx + vy * vy).cast("double"))
        w = w.where((size > 0) & ((ux * vx + uy * vy) / size <= cosine))
        w = w.select(*keys, "node", "door", F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
        free = kept(in_sight(w, barrier, ("node",), keys).select(*keys, "node", "door", "a", "b"), "waypoints")
        if free.isEmpty():
            return n, e.select(*keys, "a", "b", F.when(F.col("door"), "doorway").otherwise("corridor").alias("kind"))
        pairs = free.select(*keys, F.col("node").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        go = kept(independent(free, pairs, "node", keys).select(*keys, "node", "door", "a", "b"), "straight")
        left = e.join(go.select(*keys, F.col("node").alias("a")), [*keys, "a"], "left_anti").join(go.select(*keys, F.col("node").alias("b")), [*keys, "b"], "left_anti")
        new = go.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "door")
        e = kept(left.unionByName(new).groupBy(*keys, "a", "b").agg(F.max("door").alias("door")), "edges")
        n = kept(n.join(go.select(*keys, "node"), [*keys, "node"], "left_anti"), "nodes")
