"""Questions about undirected graphs given as edges: degree, components, reach and a report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.checkpoint import dropped, kept
from atriumq.functions import geometry as g
from atriumq.functions.text import pair_key


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(floor, node, degree) of every node, 0 included."""
    ends = edges.select("floor", F.explode(F.array("from_node", "to_node")).alias("node"))
    return nodes.select("floor", "node").join(ends.groupBy("floor", "node").agg(F.count("*").alias("degree")), ["floor", "node"], "left").fillna(0, ["degree"])


#: Edges of a floor that one task takes whole; larger floors are labelled round by round.
MOST_EDGES = 200_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(floor, node, component): the smallest node that each node reaches on its floor. Ids may be of any type
    that can be ordered; edges with an end that is no node of the floor do not count.

    Floors of up to MOST_EDGES edges are labelled by a task each; larger ones by joins, see relaxed_labels."""
    key = nodes.select("floor", "node").distinct()
    known = edges.select("floor", "from_node", "to_node").join(key.withColumnRenamed("node", "from_node"), ["floor", "from_node"], "left_semi").join(key.withColumnRenamed("node", "to_node"), ["floor", "to_node"], "left_semi")
    known = kept(known.select("floor", "from_node", "to_node"), "edges")
    large = kept(known.groupBy("floor").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select("floor"), "large")
    kind = {f.name: f.dataType.simpleString() for f in key.schema}

    def label(floor: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([floor["from_node"].to_numpy(), floor["to_node"].to_numpy()]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(names))  # names are sorted, so the smallest number is the smallest node
        while True:
            new = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(new, root[a], least)
            np.minimum.at(new, root[b], least)
            new = new[new]
            if (new == root).all():
                return pd.DataFrame({"floor": floor["floor"].iloc[0], "node": names, "component": names[root]})
            root = new

    small = known.join(large, "floor", "left_anti").groupBy("floor").applyInPandas(label, f"floor {kind['floor']}, node {kind['node']}, component {kind['node']}")
    found = small if large.isEmpty() else small.unionByName(relaxed_labels(known.join(large, "floor", "left_semi")))
    return key.join(found, ["floor", "node"], "left").select("floor", "node", F.coalesce("component", "node").alias("component"))


def relaxed_labels(edges: DataFrame) -> DataFrame:
    """(floor, node, component) of all ends of edges, for floors that no task could hold.

    Every round takes the least label among neighbours and then the label's own label, so the
    number of rounds is about the logarithm of the longest path; it ends when no label moved."""
    both = kept(edges.select("floor", F.col("from_node").alias("node"), F.col("to_node").alias("other")).union(edges.select("floor", "to_node", "from_node")).distinct(), "pairs")
    label = kept(both.select("floor", "node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        near = both.join(label.select("floor", F.col("node").alias("other"), "component"), ["floor", "other"]).groupBy("floor", "node").agg(F.min("component").alias("c"))
        step = label.join(near, ["floor", "node"], "left").select("floor", "node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = step.join(step.select("floor", F.col("node").alias("component"), F.col("component").alias("c")), ["floor", "component"], "left")
        after = kept(jump.select("floor", "node", F.least("component", "c").alias("component"), (F.least("component", "c") < F.col("was")).alias("moved")), "labels")
        dropped(label)
        label = after.drop("moved")
        if after.where("moved").isEmpty():
            return label


#: Edges, of all floors together, that one task labels at the end; more are contracted by joins first.
LAST_EDGES = 100_000


def contracted_labels(edges: DataFrame, keys: Sequence[str] = ("floor",), last: int | None = None) -> DataFrame:
    """(keys, node, component): the smallest node that each end of an edge (keys, a, b) reaches.

    A round points every node to its least neighbour, follows pointers four steps, and maps the edges: what is
    left are the edges between fewer nodes. Rounds go on until LAST_EDGES are left, which one task labels; then
    the pointers of the rounds are followed back. Nodes are of any type that can be ordered; loops count as nothing."""
    last = LAST_EDGES if last is None else last
    keys = list(keys)
    end = lambda lo: F.least("a", "b").alias("a") if lo else F.greatest("a", "b").alias("b")
    left = kept(edges.where(F.col("a") != F.col("b")).select(*keys, end(True), end(False)).distinct(), "edges")
    pointers: list[DataFrame] = []
    while left.count() > last:
        both = left.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).union(left.select(*keys, "b", "a"))
        to = both.groupBy(*keys, "node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to"))
        for _ in range(2):
            far = to.select(*keys, F.col("node").alias("to"), F.col("to").alias("then"))
            to = kept(to.join(far, [*keys, "to"]).select(*keys, "node", F.col("then").alias("to")), "pointers")
        pointers.append(to)
        for c in ("a", "b"):
            left = left.join(to.select(*keys, F.col("node").alias(c), F.col("to").alias("_to")), [*keys, c]).drop(c).withColumnRenamed("_to", c)
        left = kept(left.where(F.col("a") != F.col("b")).select(*keys, end(True), end(False)).distinct(), "edges")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=[*keys, "a", "b"])], ignore_index=True)
        if not len(e):
            return
        ends = pd.concat([e[[*keys, "a"]].rename(columns={"a": "node"}), e[[*keys, "b"]].rename(columns={"b": "node"})], ignore_index=True)
        number = ends.groupby([*keys, "node"], sort=True).ngroup().to_numpy()  # in order, so the least number is the least node
        names = ends.iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        a, b = number.reshape(2, -1)
        root = np.arange(len(names))
        while True:
            least, new = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(new, root[a], least)
            np.minimum.at(new, root[b], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield names.assign(component=names["node"].to_numpy()[root])

    found = left.coalesce(1).mapInPandas(label, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, node {kinds['a']}, component {kinds['a']}")
    for to in reversed(pointers):
        then = found.select(*keys, F.col("node").alias("to"), "component")
        found = to.join(then, [*keys, "to"], "left").select(*keys, "node", F.coalesce("component", "to").alias("component"))
    return kept(found, "labels")


def reachable(nodes: DataFrame, labels: DataFrame, kind: str = "entrance") -> DataFrame:
    """Nodes in the component of a node of that kind."""
    open_ = nodes.where(F.col("kind") == kind).join(labels, ["floor", "node"]).select("floor", "component").distinct()
    return labels.join(open_, ["floor", "component"], "left_semi")


def crossing_edges(placed: DataFrame, walls: DataFrame) -> DataFrame:
    from .network import blocked_edges

    return blocked_edges(placed, walls)


def collinear(nodes: DataFrame, edges: DataFrame, cosine: float = -0.985) -> DataFrame:
    """Waypoints of degree two whose neighbours lie on opposite sides of them."""
    both = edges.select("floor", F.col("from_node").alias("node"), F.col("to_node").alias("other")).union(edges.select("floor", "to_node", "from_node")).distinct()
    at = nodes.select("floor", F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = both.join(at, ["floor", "other"]).groupBy("floor", "node").agg(F.count("*").alias("n"), F.min(F.struct("other", "ox", "oy")).alias("a"), F.max(F.struct("other", "ox", "oy")).alias("b"))
    rows = nodes.where("kind = 'waypoint'").join(near.where("n = 2"), ["floor", "node"])
    ax, ay, bx, by = F.col("a.ox") - F.col("x"), F.col("a.oy") - F.col("y"), F.col("b.ox") - F.col("x"), F.col("b.oy") - F.col("y")
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return rows.where((la > 0) & (lb > 0) & ((ax * bx + ay * by) / (la * lb) < cosine)).select("floor", "node")


def report(floors: DataFrame, nodes: DataFrame, edges: DataFrame, walls: DataFrame | None, spaces: DataFrame | None, openings: DataFrame | None) -> DataFrame:
    """(floor, code, severity, subject): everything that a floor's graph, spaces and openings leave to be looked at.

    nodes may carry space_id and opening_id; a code without a subject has a null one. Without walls, spaces or
    openings their rules are left out."""
    from .network import placed_edges

    def issue(df: DataFrame, code: str, severity: str, subject) -> DataFrame:
        return df.select("floor", F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))

    pair = pair_key("from_node", "to_node")
    key = nodes.select("floor", "node")
    dangling = edges.join(key.withColumnRenamed("node", "from_node"), ["floor", "from_node"], "left_anti").unionByName(
        edges.join(key.withColumnRenamed("node", "from_node"), ["floor", "from_node"], "left_semi").join(key.withColumnRenamed("node", "to_node"), ["floor", "to_node"], "left_anti").select(*edges.columns)
    )
    labels = kept(components(nodes, edges), "components")
    sizes = labels.groupBy("floor", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("floor").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    entrances = nodes.where("kind = 'entrance'").select("floor").distinct()
    rooms = nodes.where(F.col("kind").isin("room", "connector")).join(entrances, "floor", "left_semi").select("floor", "node")
    no_node = lambda df, col, ref: df.join(nodes.where(F.col(ref).isNotNull()).select("floor", F.col(ref).alias(col)).distinct(), ["floor", col], "left_anti")
    parts = [
        issue(dangling, "dangling-edge", "error", pair),
        issue(degrees(nodes, edges).where("degree = 0"), "isolated-node", "warning", F.col("node")),
        issue(labels.join(largest, ["floor", "component"], "left_anti"), "disconnected-graph", "warning", F.col("node")),
        issue(floors.join(entrances, "floor", "left_anti"), "no-entrance", "warning", F.lit(None)),
        issue(rooms.join(reachable(nodes, labels).select("floor", "node"), ["floor", "node"], "left_anti"), "room-unreachable", "warning", F.col("node")),
        issue(collinear(nodes, edges), "collinear-waypoint", "info", F.col("node")),
    ]
    if walls is not None:
        parts.append(issue(crossing_edges(placed_edges(edges, nodes), walls).select("floor", "from_node", "to_node").distinct(), "edge-crosses-wall", "error", pair))
    if spaces is not None:
        parts.append(issue(no_node(spaces.where(F.col("kind").isin("room", "vertical")), "space", "space_id"), "space-without-access", "warning", F.col("space")))
    if openings is not None:
        parts.append(issue(no_node(openings, "opening", "opening_id"), "opening-without-node", "warning", F.col("opening")))
        parts.append(issue(openings.where("confidence < 0.6"), "low-confidence-opening", "info", F.col("opening")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def status(floors: DataFrame, issues: DataFrame) -> DataFrame:
    """(floor, status, errors, warnings): errors outrank warnings, which outrank ok."""
    found = issues.groupBy("floor").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = floors.select("floor").join(found, "floor", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "errors").when(F.col("warnings") > 0, "warnings").otherwise("ok"))


def metrics(floors: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, issues: DataFrame) -> DataFrame:
    """(floor, name, value) of every floor: nodes, edges, entrances, components, and how many things the rules found."""
    count = lambda df, name: df.groupBy("floor").agg(F.count("*").alias("n")).select("floor", F.lit(name).alias("name"), "n")
    found = issues.join(F.broadcast(_metric_of(issues.sparkSession)), "code").groupBy("floor", "name").agg(F.count("*").alias("n"))
    have = count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(count(nodes.where("kind = 'entrance'"), "entrances")).unionByName(count(labels.select("floor", "component").distinct(), "components")).unionByName(found)
    every = floors.select("floor").withColumn("name", F.explode(F.array(*[F.lit(x) for x in ("nodes", "edges", "entrances", "components", *dict.fromkeys(METRICS.values()))])))
    return every.join(have, ["floor", "name"], "left").select("floor", "name", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


#: The metric that counts what a rule found.
METRICS = {"edge-crosses-wall": "edges_crossing_walls", "room-unreachable": "rooms_unreachable_from_entrance", "space-without-access": "spaces_without_node", "collinear-waypoint": "collinear_waypoints"}


def _metric_of(spark) -> DataFrame:
    return spark.createDataFrame(list(METRICS.items()), "code string, name string")


def path_lengths(points: DataFrame, key: str = "floor") -> DataFrame:
    """(key, length): length of the path through a key's points in their order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ord")
    step = g.distance(F.lag("x").over(w), F.lag("y").over(w), "x", "y")
    return points.withColumn("_step", step).groupBy(key).agg(F.sum("_step").alias("length"))
