"""Shortest routes.

Nodes that no links join, in whatever direction, have no route, so a request is searched only in the group of nodes
that its start is joined to. Small groups share a task; a larger group's requests are dealt by where they start, about
REQUESTS a task, each with the group's links. A heap does the rest, one search for all goals of a start; that holds for
groups of up to MOST_LINKS links. Networks that no task should hold
are relaxed by joins instead, all starting points together, a join and a group a round: distances first,
then the link into every node, then the paths, walked back from all goals at once. Both ways give the same
routes: ties go to the smaller "floor:node" text of the node before, then to the earlier link.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atriumq.checkpoint import dropped, kept
from atriumq.functions.geometry import LEAST_METERS
from atriumq.functions.text import one_decimal
from atriumq.operators.graphs import contracted_labels

#: Requests of a group of nodes that a task answers, and the links of a group that a task may hold.
REQUESTS, MOST_LINKS = 500, 2_000_000
#: Links of small groups that a task takes together, about.
LINKS = 100_000
_ENDS = ("src_floor", "src", "dst_floor", "dst")
_START = ["start_floor", "start", "accessible_only"]


def distances(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_floor, start, accessible_only, floor, node, metres): least metres from every start (floor, node and,
    if given, accessible_only) to all it reaches, relaxed round by round.

    Only nodes that a round improved go into the next, until none is; both tables are written every round, so
    plans stay short and a lost executor costs a round."""
    at = [*_START, "floor", "node"]
    only = F.col("accessible_only") if "accessible_only" in starts.columns else F.lit(False)
    free = F.col("accessible") if "accessible" in links.columns else F.lit(True)
    step = links.select(F.col("src_floor").alias("floor"), F.col("src").alias("node"), F.col("dst_floor").alias("to_floor"), F.col("dst").alias("to_node"), free.alias("accessible"), F.greatest("metres", F.lit(LEAST_METERS)).alias("metres"))
    step = kept(step.groupBy("floor", "node", "to_floor", "to_node", "accessible").agg(F.min("metres").alias("step")), "links")
    reached = kept(starts.select(F.col("floor").alias("start_floor"), F.col("node").alias("start"), only.alias("accessible_only"), "floor", "node", F.lit(0.0).alias("metres")).distinct(), "reached")
    frontier = reached
    while True:
        new = frontier.join(step, ["floor", "node"]).where("accessible OR NOT accessible_only").select(*_START, F.col("to_floor").alias("floor"), F.col("to_node").alias("node"), (F.col("metres") + F.col("step")).alias("metres"))
        new = new.groupBy(*at).agg(F.min("metres").alias("metres"))
        better = kept(new.join(reached.withColumnRenamed("metres", "known"), at, "left").where("known IS NULL OR metres < known").drop("known"), "frontier")
        if frontier is not reached:
            dropped(frontier)
        frontier = better
        if frontier.isEmpty():
            return reached
        before, reached = reached, kept(reached.unionByName(frontier).groupBy(*at).agg(F.min("metres").alias("metres")), "reached")
        dropped(before)


def distances_in_buildings(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The same for starts (building, floor, node), dealt over tasks with their building's links; larger buildings by distances()."""
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    net = kept(links.select("building", *text(*_ENDS), "metres"), "links")
    asked = starts.select("building", *text("floor", "node")).distinct()
    small, large = _by_size(net)

    def solve(wanted: pd.DataFrame, building: pd.DataFrame) -> pd.DataFrame:
        out = defaultdict(list)
        for sf, s, df, d, m in building[[*_ENDS, "metres"]].itertuples(index=False):
            out[sf, s].append(((df, d), m))
        rows = []
        for r in wanted.itertuples(index=False):
            best, _ = _search(out, (r.floor, r.node))
            rows += [(r.floor, r.node, *at, metres) for at, metres in best.items()]
        return pd.DataFrame(rows, columns=["start_floor", "start", "floor", "node", "metres"])

    found = _dealt(asked, net.join(large, "building", "left_anti"), large, solve, "start_floor string, start string, floor string, node string, metres double", F.xxhash64("floor", "node"))
    if small:
        return found
    far = distances(net.join(large, "building", "left_semi"), asked.join(large, "building", "left_semi"))
    return found.unionByName(far.drop("accessible_only"))


def _by_size(net: DataFrame) -> tuple[bool, DataFrame]:
    """Whether every building's links fit a task, and the buildings whose do not."""
    large = kept(net.groupBy("building").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINKS).select("building"), "large")
    return large.isEmpty(), large


def _dealt(asked: DataFrame, net: DataFrame, large: DataFrame, solve, shape: str, spread) -> DataFrame:
    """solve(requests, network) on parts of each building's requests, each part with the whole network of the building."""
    asked = asked.join(large, "building", "left_anti")
    parts = kept(asked.groupBy("building").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("parts")), "parts")
    mine = asked.join(parts, "building").withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).drop("parts")
    every = net.join(parts, "building").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return mine.groupBy("building", "part").cogroup(every.groupBy("building", "part")).applyInPandas(solve, shape)


def _search(out: dict, start: tuple, goals: set[tuple] | None = None) -> tuple[dict, dict]:
    """Distances and the link into each node, until all goals are settled; ties go to the smaller "floor:node" text, then to the earlier link."""
    best, into, heap = {start: 0.0}, {}, [(0.0, f"{start[0]}:{start[1]}", start)]
    left = None if goals is None else set(goals)
    while heap and left != set():
        d, _, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        if left is not None:
            left.discard(at)
        for link in out.get(at, ()):
            to, far = link[0], d + max(link[1], LEAST_METERS)
            if far < best.get(to, float("inf")):
                best[to], into[to] = far, (at, link)
                heapq.heappush(heap, (far, f"{to[0]}:{to[1]}", to))
    return best, into


_ROUTE = """request long, status string, pos int, floor string, node string, metres double, link_metres double, kind string, label string"""
_ORDER = ["f", "t", "n", "a", "b", "r"]


def routes(requests: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per step of every request's route: (request, status, pos, floor, node, metres so far,
    link_metres, kind, label), the kind and label being those of the link into the node. A request
    that has no route gives one row whose status says why.

    requests: (request, building, start_floor, start, goal_floor, goal, accessible_only). Ids may be of any
    type; they come out as text."""
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    known = kept(nodes.select("building", *text("floor", "node")).distinct(), "nodes")
    net = links.select("building", *text(*_ENDS), "metres", "kind", "label", "accessible", "ord.*")
    for f, n in (_ENDS[:2], _ENDS[2:]):
        net = net.join(known.select("building", F.col("floor").alias(f), F.col("node").alias(n)), ["building", f, n], "left_semi")
    net = kept(net, "links")
    name = lambda f, n: F.concat_ws(":", f, n)
    labels = contracted_labels(net.select("building", name(*_ENDS[:2]).alias("a"), name(*_ENDS[2:]).alias("b")), ["building"])

    def grouped(df: DataFrame, f: str, n: str, group: str) -> DataFrame:
        out = df.withColumn("_name", name(f, n)).join(labels.select("building", F.col("node").alias("_name"), F.col("component").alias(group)), ["building", "_name"], "left")
        return out.withColumn(group, F.coalesce(group, "_name")).drop("_name")

    # Named anew: requests may come from the same table as the nodes.
    asked = requests.select("request", F.col("building").alias("building"), *text("start_floor", "start", "goal_floor", "goal"), "accessible_only")
    asked = asked.join(known.select("building", F.lit(True).alias("mapped")).distinct(), "building", "left").join(known.select("building", F.col("floor").alias("goal_floor"), F.lit(True).alias("here")).distinct(), ["building", "goal_floor"], "left")
    for c in ("start", "goal"):
        asked = asked.join(known.select("building", F.col("floor").alias(f"{c}_floor"), F.col("node").alias(c), F.lit(True).alias(f"has_{c}")), ["building", f"{c}_floor", c], "left")
    asked = grouped(grouped(asked, "start_floor", "start", "_group"), "goal_floor", "goal", "_goal")
    wrong = F.when(F.col("mapped").isNull(), "no map for the building").when(F.col("here").isNull(), "goal in another building").when(F.col("has_start").isNull() | F.col("has_goal").isNull(), "unknown node")
    wrong = wrong.when(F.col("_group") != F.col("_goal"), F.when(F.col("accessible_only"), "no accessible route").otherwise("no route"))
    asked = kept(asked.select("request", "building", *_START, "goal_floor", "goal", "_group", wrong.alias("wrong")), "asked")
    none = asked.where("wrong IS NOT NULL").select("request", F.col("wrong").alias("status"), F.lit(0).alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in (("floor", "string"), ("node", "string"), ("metres", "double"), ("link_metres", "double"), ("kind", "string"), ("label", "string"))))
    some, group = asked.where("wrong IS NULL").drop("wrong"), ["building", "_group"]
    net = kept(net.transform(grouped, "src_floor", "src", "_group").join(some.select(*group).distinct(), group, "left_semi"), "net")
    large = kept(net.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINKS).select(*group), "large")

    def solve(wanted: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        part = around.sort_values(_ORDER, kind="stable")  # the order in which links are tried
        nets: dict[bool, dict] = {False: defaultdict(list), True: defaultdict(list)}
        for sf, s, df, d, m, kind, label, free in zip(*(part[c].tolist() for c in (*_ENDS, "metres", "kind", "label", "accessible"))):
            for only in (False, True) if free else (False,):
                nets[only][sf, s].append(((df, d), m, kind, label))
        goals: dict[tuple, set] = defaultdict(set)
        for r in wanted.itertuples(index=False):
            goals[r.start_floor, r.start, bool(r.accessible_only)].add((r.goal_floor, r.goal))
        rows, now, best, into = [], None, {}, {}
        for r in wanted.sort_values([*_START, "request"], kind="stable").itertuples(index=False):
            start, goal, only = (r.start_floor, r.start), (r.goal_floor, r.goal), bool(r.accessible_only)
            if now != (*start, only):
                now = (*start, only)
                best, into = _search(nets[only], start, goals[now])
            if goal not in best:
                rows.append((r.request, "no accessible route" if only else "no route", 0, None, None, None, None, None, None))
                continue
            path, at = [], goal
            while at != start:
                before, link = into[at]
                path.append((at, link))
                at = before
            path.append((start, (start, None, None, None)))
            for pos, (at, link) in enumerate(reversed(path)):
                rows.append((r.request, "ok", pos, at[0], at[1], best[at], link[1], link[2], link[3]))
        return pd.DataFrame(rows, columns=["request", "status", "pos", "floor", "node", "metres", "link_metres", "kind", "label"])

    # Small groups share a task; the requests of a large one are dealt, each part with the links of the group.
    few = some.join(large, group, "left_anti")
    bins = 1 + few.count() // REQUESTS + net.count() // LINKS
    parts = few.groupBy(*group).agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("parts"))
    parts = kept(parts.withColumn("deal", F.when(F.col("parts") > 1, F.col("_group")).otherwise(F.pmod(F.xxhash64("_group"), F.lit(bins)).cast("string"))), "parts")
    # Named anew, as both sides come from the same tables.
    deal = [F.col(c).alias(c) for c in ("building", "deal")]
    mine = few.join(parts, group).select("request", *_START, "goal_floor", "goal", *deal, F.pmod(F.xxhash64(*_START), F.col("parts")).cast("int").alias("part"))
    every = net.join(parts, group).select(*_ENDS, "metres", "kind", "label", "accessible", *_ORDER, *deal, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = none.unionByName(mine.groupBy("building", "deal", "part").cogroup(every.groupBy("building", "deal", "part")).applyInPandas(solve, _ROUTE))
    if large.isEmpty():
        return found
    of = lambda df: df.join(large, group, "left_semi").drop("_group")
    return found.unionByName(relaxed_routes(of(some), known.join(large.select("building").distinct(), "building", "left_semi"), of(net)))


def relaxed_routes(requests: DataFrame, nodes: DataFrame, net: DataFrame) -> DataFrame:
    """What routes() gives, by joins alone, for networks that no task should hold. Ids are text here; net is
    links with the columns of ``ord`` beside them."""
    place = nodes.select("building", "floor", "node").distinct()
    key = place.select("floor", "node")
    floors = place.select("building", F.col("floor").alias("goal_floor")).distinct().withColumn("here", F.lit(True))
    ends = [key.select(F.col("floor").alias(f), F.col("node").alias(n)) for f, n in (_ENDS[:2], _ENDS[2:])]
    net = kept(net.join(ends[0], list(_ENDS[:2]), "left_semi").join(ends[1], list(_ENDS[2:]), "left_semi"), "net")
    is_known = [key.select(F.col("floor").alias(f"{c}_floor"), F.col("node").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("start", "goal")]
    asked = requests.join(floors, ["building", "goal_floor"], "left").join(is_known[0], ["start_floor", "start"], "left").join(is_known[1], ["goal_floor", "goal"], "left")
    asked = asked.join(place.select("building").distinct().withColumn("mapped", F.lit(True)), "building", "left")
    wrong = F.when(F.col("mapped").isNull(), "no map for the building").when(F.col("here").isNull(), "goal in another building").when(F.col("has_start").isNull() | F.col("has_goal").isNull(), "unknown node")
    asked = kept(asked.select("request", *_START, "goal_floor", "goal", wrong.alias("wrong")), "asked")
    far = kept(distances(net, asked.where("wrong IS NULL").select(F.col("start_floor").alias("floor"), F.col("start").alias("node"), "accessible_only").distinct()), "far")
    # The link into every node: of those on a shortest way the one from the node reached first, then the earliest.
    u = far.select(*_START, F.col("floor").alias("src_floor"), F.col("node").alias("src"), F.col("metres").alias("du"))
    v = far.select(*_START, F.col("floor").alias("dst_floor"), F.col("node").alias("dst"), F.col("metres").alias("dv"))
    on = u.join(net, list(_ENDS[:2])).where("accessible OR NOT accessible_only").join(v, [*_START, *_ENDS[2:]])
    on = on.where(F.col("du") + F.greatest("metres", F.lit(LEAST_METERS)) == F.col("dv"))
    first = F.struct("du", F.concat_ws(":", "src_floor", "src").alias("name"), *_ORDER)
    into = kept(on.groupBy(*_START, *_ENDS[2:]).agg(F.min_by(F.struct("src_floor", "src", F.col("metres").alias("link_metres"), "kind", "label"), first).alias("l")), "into")
    goals = asked.join(far.select(*_START, F.col("floor").alias("goal_floor"), F.col("node").alias("goal"), "metres"), [*_START, "goal_floor", "goal"], "left")
    ways = kept(goals.where("metres IS NOT NULL").select("request", *_START, F.col("goal_floor").alias("dst_floor"), F.col("goal").alias("dst"), F.lit(0).alias("back")), "ways")
    steps = []
    while not ways.isEmpty():  # one step back towards the start, all requests together
        at = kept(ways.join(into, [*_START, *_ENDS[2:]], "left"), "steps")
        steps.append(at)
        ways = kept(at.where("l IS NOT NULL").select("request", *_START, F.col("l.src_floor").alias("dst_floor"), F.col("l.src").alias("dst"), (F.col("back") + 1).alias("back")), "ways")
    none = goals.where("metres IS NULL").select("request", F.coalesce("wrong", F.when(F.col("accessible_only"), "no accessible route").otherwise("no route")).alias("status"), F.lit(0).alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in (("floor", "string"), ("node", "string"), ("metres", "double"), ("link_metres", "double"), ("kind", "string"), ("label", "string"))))
    if not steps:
        return none
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    last = F.max("back").over(Window.partitionBy("request"))
    path = every.withColumn("pos", (last - F.col("back")).cast("int")).join(v, [*_START, *_ENDS[2:]])
    return none.unionByName(path.select("request", F.lit("ok").alias("status"), "pos", F.col("dst_floor").alias("floor"), F.col("dst").alias("node"), F.col("dv").alias("metres"), "l.link_metres", "l.kind", "l.label"))


# The sentences that guide a visitor.
_VERTICAL = {"elevator": "Toma el ascensor", "stairs": "Usa las escaleras"}
_VERTICAL_ELSE = "Usa la rampa"


def instructions(steps: DataFrame, nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """(request, pos, instruction): a sentence for every walk between vertical links, with its summed
    metres and the place it ends at, one for every vertical link, and one for the arrival.

    nodes: (floor, node, label); floors: (floor, floor_label)."""
    order = Window.partitionBy("request").orderBy("pos")
    names = nodes.select(F.col("floor").cast("string").alias("floor"), F.col("node").cast("string").alias("node"), F.col("label").alias("place"))
    titles = floors.select(F.col("floor").cast("string").alias("floor"), "floor_label")
    moves = steps.where("status = 'ok'").join(names, ["floor", "node"], "left").join(titles, "floor", "left")
    moves = moves.withColumn("vertical", (F.col("pos") > 0) & ~F.col("kind").isin("corridor", "doorway"))
    # Every vertical link is an island of its own, and so is every walk between two.
    moves = moves.withColumn("island", 2 * F.sum(F.col("vertical").cast("int")).over(order) - F.col("vertical").cast("int"))
    parts = moves.where("pos > 0").groupBy("request", "island").agg(
        F.max("pos").alias("pos"), F.sum("link_metres").alias("metres"), F.max("vertical").alias("vertical"), F.max_by("kind", "pos").alias("kind"), F.max_by("label", "pos").alias("label"), F.max_by("place", "pos").alias("place"), F.max_by("floor_label", "pos").alias("floor_label"),
    )
    until = F.when(F.coalesce("place", F.lit("")) != "", F.concat(F.lit(" hasta "), "place")).otherwise("")
    walk = F.concat(F.lit("Avanza "), one_decimal(F.col("metres")), F.lit(" m"), until, F.lit("."))
    how = F.lit(_VERTICAL_ELSE)
    for kind, text in _VERTICAL.items():
        how = F.when(F.col("kind") == kind, text).otherwise(how)
    named = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" ("), "label", F.lit(")"))).otherwise("")
    lift = F.concat(how, named, F.lit(" hacia "), F.coalesce("floor_label", F.lit("otro piso")), F.lit("."))
    told = parts.where("vertical OR metres > 0").select("request", "pos", F.when(F.col("vertical"), lift).otherwise(walk).alias("instruction"))
    last = moves.groupBy("request").agg((F.max("pos") + 1).alias("pos"), F.concat(F.lit("Llegaste a "), F.coalesce(F.max_by("place", "pos"), F.lit("tu destino")), F.lit(".")).alias("instruction"))
    return told.unionByName(last)


def route_totals(steps: DataFrame) -> DataFrame:
    """(request, metres, n_nodes, n_floors): links count at least LEAST_METERS each."""
    ok = steps.where("status = 'ok'")
    return ok.groupBy("request").agg(F.sum(F.when(F.col("pos") > 0, F.greatest("link_metres", F.lit(LEAST_METERS))).otherwise(0.0)).alias("metres"), F.count("*").alias("n_nodes"), F.countDistinct("floor").alias("n_floors"))


def route_floors(steps: DataFrame) -> DataFrame:
    """(request, floor, first_pos): the floors of a route in the order in which it comes to them."""
    return steps.where("status = 'ok'").groupBy("request", "floor").agg(F.min("pos").alias("first_pos"))


def on_floor(steps: DataFrame, floor: DataFrame) -> DataFrame:
    """The steps of each route that lie on the floor which is shown (request, floor)."""
    return steps.where("status = 'ok'").join(floor.select("request", F.col("floor").cast("string").alias("floor")), ["request", "floor"], "left_semi")
