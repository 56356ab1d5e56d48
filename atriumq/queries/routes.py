"""Network, routing, graph and rule queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from atriumq.checkpoint import kept
from atriumq.fixtures import duck, view
from atriumq.operators import checks, graphs, network, routing

_CROSS = """((b.x-a.x)*(w.sy-a.y)-(b.y-a.y)*(w.sx-a.x))*((b.x-a.x)*(w.ey-a.y)-(b.y-a.y)*(w.ex-a.x)) < -1e-7
  AND ((w.ex-w.sx)*(a.y-w.sy)-(w.ey-w.sy)*(a.x-w.sx))*((w.ex-w.sx)*(b.y-w.sy)-(w.ey-w.sy)*(b.x-w.sx)) < -1e-7"""
_HIT = f"""hit AS (SELECT e.floor, e.from_node, e.to_node, w.wall FROM fx_edge e JOIN fx_node a ON e.floor=a.floor AND e.from_node=a.node JOIN fx_node b ON e.floor=b.floor AND e.to_node=b.node
  JOIN fx_wall w ON w.floor=e.floor WHERE {_CROSS})"""
_LINKS = f"""{_HIT}, lvl AS (SELECT e.building, e.floor, e.from_node, e.to_node, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) / f.ppm AS metres, e.accessible
  FROM fx_edge e JOIN fx_node a ON e.floor=a.floor AND e.from_node=a.node JOIN fx_node b ON e.floor=b.floor AND e.to_node=b.node JOIN fx_floor f ON f.floor=e.floor
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.floor=e.floor AND h.from_node=e.from_node AND h.to_node=e.to_node)),
links AS (SELECT building, floor AS src_floor, from_node AS src, floor AS dst_floor, to_node AS dst, metres, 'corridor' AS kind, accessible FROM lvl
  UNION ALL SELECT building, floor, to_node, floor, from_node, metres, 'corridor', accessible FROM lvl
  UNION ALL SELECT f.building, src_floor, src_node, dst_floor, dst_node, CASE kind WHEN 'elevator' THEN 6.0 WHEN 'stairs' THEN 10.0 WHEN 'ramp' THEN 12.0 ELSE 10.0 END::DOUBLE, kind, accessible FROM fx_connector c JOIN fx_floor f ON f.floor=c.src_floor
  UNION ALL SELECT f.building, dst_floor, dst_node, src_floor, src_node, CASE kind WHEN 'elevator' THEN 6.0 WHEN 'stairs' THEN 10.0 WHEN 'ramp' THEN 12.0 ELSE 10.0 END::DOUBLE, kind, accessible FROM fx_connector c JOIN fx_floor f ON f.floor=c.src_floor WHERE bidirectional)"""
_V = ("fx_floor", "fx_node", "fx_wall", "fx_edge", "fx_connector")


def _tables(spark, d, *names):
    return [view(spark, d, n) for n in names]


def _links(spark, d):
    f, n, w, e, c = _tables(spark, d, *_V)
    return network.links(f, n, e.drop("building"), w, c)


def placed_edges(spark, d):
    n, e = _tables(spark, d, "fx_node", "fx_edge")
    return network.placed_edges(e, n).select("floor", "from_node", "to_node", "ax", "ay", "bx", "by")


def wall_crossings(spark, d):
    n, e, w = _tables(spark, d, "fx_node", "fx_edge", "fx_wall")
    return network.crossings(network.placed_edges(e, n), w)


def open_edges(spark, d):
    n, e, w = _tables(spark, d, "fx_node", "fx_edge", "fx_wall")
    return network.open_edges(network.placed_edges(e, n), w).select("floor", "from_node", "to_node")


def flagged_edges(spark, d):
    n, e, w = _tables(spark, d, "fx_node", "fx_edge", "fx_wall")
    return network.flagged_edges(network.placed_edges(e, n), w).select("floor", "from_node", "to_node", "invalid")


def floors_of_building(spark, d):
    f, n, e = _tables(spark, d, "fx_floor", "fx_node", "fx_edge")
    configs = e.groupBy("floor").agg(F.count("*").alias("n_edges"))
    return network.building_floors(f, n, configs).select("building", "floor", "other_floor", "other_ppm", "n_edges")


def sibling_floors(spark, d):
    return network.sibling_floors(view(spark, d, "fx_floor"))


def route_links(spark, d):
    return _links(spark, d).select("building", "src_floor", "src", "dst_floor", "dst", F.round("metres", 6).alias("metres"), "kind", "accessible")


def accessible_links(spark, d):
    links = network.known_links(_links(spark, d), view(spark, d, "fx_node").where("kind <> 'door'"), accessible_only=True)
    return links.select("src_floor", "src", "dst_floor", "dst", F.round("metres", 6).alias("metres"), "kind")


def _first_nodes(spark, d):
    n = view(spark, d, "fx_node")
    return n.groupBy("building").agg(F.min(F.struct("node", "floor")).alias("m")).select("building", "m.floor", "m.node")


def _distances(found):
    return found.select(F.col("start").cast("long").alias("start"), F.col("floor").cast("int").alias("floor"), F.col("node").cast("long").alias("node"), F.round("metres", 6).alias("metres"))


def distances_from_node(spark, d):
    """From the first node of every building to all nodes it reaches, past walls and over floors."""
    return _distances(routing.distances_in_buildings(_links(spark, d), _first_nodes(spark, d)))


def relaxed_distances(spark, d):
    """The same by joins alone, as networks need it that no task should hold."""
    return _distances(routing.distances(_links(spark, d), _first_nodes(spark, d)))


def _requests(spark, d):
    """A request from every node: to nodes of the same building and of others, to unknown ones, some for accessible
    routes only; and one in a building without a map."""
    n = view(spark, d, "fx_node")
    a = n.select("building", F.col("floor").alias("start_floor"), F.col("node").alias("start"))
    a = a.withColumn("goal", F.when(F.col("start") % 50 == 0, F.lit(-1)).otherwise((F.col("start") * 7 + 3) % F.lit(n.count())))
    goal = n.select(F.col("node").alias("goal"), F.col("floor").alias("goal_floor"))
    asked = a.join(goal, "goal", "left").withColumn("goal_floor", F.coalesce("goal_floor", "start_floor"))
    nowhere = asked.where("start % 97 = 1").withColumn("building", F.lit(99)).withColumn("start", F.col("start") + 1_000_000_000)
    asked = asked.unionByName(nowhere)
    return asked.withColumn("request", F.col("start").cast("long")).withColumn("accessible_only", F.col("start") % 3 == 0)


def _totals(steps):
    total = routing.route_totals(steps).select("request", "metres", "n_nodes", "n_floors")
    return steps.groupBy("request").agg(F.first("status").alias("status")).join(total, "request", "left").select("request", "status", F.round("metres", 6).alias("metres"), "n_nodes", "n_floors")


def batch_routes(spark, d):
    """Status and length of every requested route."""
    return _totals(routing.routes(_requests(spark, d), view(spark, d, "fx_node"), _links(spark, d))).drop("n_nodes", "n_floors")


def relaxed_routes(spark, d):
    """The same by joins alone."""
    asked = _requests(spark, d)
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    links = _links(spark, d).select("building", *text("src_floor", "src", "dst_floor", "dst"), "metres", "kind", "label", "accessible", "ord.*")
    asked = asked.select("request", "building", *text("start_floor", "start", "goal_floor", "goal"), "accessible_only")
    return _totals(routing.relaxed_routes(asked, view(spark, d, "fx_node").select("building", *text("floor", "node")), links)).drop("n_nodes", "n_floors")


def route_instructions(spark, d):
    steps = routing.routes(_requests(spark, d), view(spark, d, "fx_node"), _links(spark, d))
    return routing.instructions(steps, view(spark, d, "fx_node"), view(spark, d, "fx_floor"))


def route_steps(spark, d):
    """Every node of every route in its order."""
    steps = routing.routes(_requests(spark, d), view(spark, d, "fx_node"), _links(spark, d)).where("status = 'ok'")
    return steps.select("request", "pos", F.col("floor").cast("int").alias("floor"), F.col("node").cast("long").alias("node"))


def floors_of_routes(spark, d):
    """The floors of every route in the order in which it comes to them, and how much of it lies on the first."""
    steps = kept(routing.routes(_requests(spark, d), view(spark, d, "fx_node"), _links(spark, d)), "routes")
    first = steps.where("pos = 0 AND status = 'ok'").select("request", "floor")
    shown = routing.on_floor(steps, first).groupBy("request").agg(F.count("*").alias("shown"))
    return routing.route_floors(steps).join(shown, "request")


def degrees(spark, d):
    n, e = _tables(spark, d, "fx_node", "fx_edge")
    return graphs.degrees(n, e)


def graph_components(spark, d):
    """Components of every floor's graph once blocked edges are gone."""
    n, e, w = _tables(spark, d, "fx_node", "fx_edge", "fx_wall")
    return graphs.components(n, network.open_edges(network.placed_edges(e, n), w).where("from_node % 4 <> 0"))


def reachable_nodes(spark, d):
    n, e, w = _tables(spark, d, "fx_node", "fx_edge", "fx_wall")
    labels = graphs.components(n, e.where("from_node % 4 <> 0 AND to_node % 3 <> 0"))
    return graphs.reachable(n, labels).select("floor", "node")


def graph_metrics(spark, d):
    """Counts that describe every floor's graph, as name and value."""
    f, n, e = _tables(spark, d, "fx_floor", "fx_node", "fx_edge")
    edges = e.where("from_node % 4 <> 0")
    return graphs.metrics(f, n, edges, graphs.components(n, edges), _report(spark, d))


def _with_refs(spark, d):
    n = view(spark, d, "fx_node")
    return n.withColumn("space_id", F.when(F.col("node") % 2 == 0, F.col("node"))).withColumn("opening_id", F.when(F.col("node") % 3 == 0, F.col("node")))


def _report(spark, d):
    f, e, w, o = _tables(spark, d, "fx_floor", "fx_edge", "fx_wall", "fx_opening")
    spaces = view(spark, d, "fx_space").withColumn("kind", F.when(F.col("space") % 3 == 0, "room").when(F.col("space") % 3 == 1, "vertical").otherwise("void"))
    edges = e.where("from_node % 4 <> 0")
    edges = edges.unionByName(edges.where("from_node % 50 = 1").withColumn("to_node", F.col("to_node") + 10_000_000))
    return graphs.report(f, _with_refs(spark, d), edges, w, spaces, o)


def graph_report(spark, d):
    return _report(spark, d)


def report_status(spark, d):
    return graphs.status(view(spark, d, "fx_floor"), _report(spark, d).where("floor % 3 = 0 OR severity <> 'error'")).select("floor", "status", "errors", "warnings")


def spatial_rules(spark, d):
    f, w, n, p = _tables(spark, d, "fx_floor", "fx_wall", "fx_node", "fx_poi")
    bad = n.where("node % 97 = 0")
    return checks.spatial_rules(f.withColumn("ppm", F.when(F.col("floor") % 11 == 0, 0.0).otherwise(F.col("ppm"))), w.withColumn("ex", F.when(F.col("wall") % 13 == 0, F.col("sx")).otherwise(F.col("ex"))).withColumn("ey", F.when(F.col("wall") % 13 == 0, F.col("sy")).otherwise(F.col("ey"))), n.unionByName(bad), p)


def navigation_rules(spark, d):
    f, n, e, c = _tables(spark, d, "fx_floor", "fx_node", "fx_edge", "fx_connector")
    e = e.withColumn("to_node", F.when(F.col("from_node") % 83 == 0, F.col("from_node")).when(F.col("from_node") % 89 == 0, F.col("to_node") + 5_000_000).otherwise(F.col("to_node"))).withColumn("kind", F.when(F.col("from_node") % 71 == 0, "tunnel").otherwise(F.col("kind")))
    back = e.where("from_node % 61 = 0").select("building", "floor", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "accessible", "kind")
    c = c.withColumn("kind", F.when(F.col("src_floor") % 5 == 0, "slide").otherwise(F.col("kind"))).withColumn("dst_floor", F.when(F.col("src_floor") % 7 == 1, F.col("src_floor")).when(F.col("src_floor") % 7 == 2, 99).otherwise(F.col("dst_floor"))).withColumn("dst_node", F.when(F.col("src_floor") % 7 == 3, F.lit(-5)).otherwise(F.col("dst_node")))
    return checks.navigation_rules(e.unionByName(back), c, n, f)


def positioning_rules(spark, d):
    q, n = _tables(spark, d, "fx_qr", "fx_node")
    return checks.positioning_rules(q, n)


def length_rules(spark, d):
    """The longest names and categories that may be stored, on names and categories repeated up to nine times."""
    p = view(spark, d, "fx_poi")
    many = (F.col("poi") % 10).cast("int")
    return checks.length_rules(p.withColumn("name", F.repeat("name", many)).withColumn("category", F.repeat("category", many)), "poi", {k: checks.LENGTHS[k] for k in ("name", "category")})


_E_NAV = """e0 AS (SELECT building, floor, from_node, CASE WHEN from_node % 83 = 0 THEN from_node WHEN from_node % 89 = 0 THEN to_node + 5000000 ELSE to_node END AS to_node, accessible, CASE WHEN from_node % 71 = 0 THEN 'tunnel' ELSE kind END AS kind FROM fx_edge),
e AS (SELECT *, from_node || '-' || to_node AS s FROM (SELECT floor, from_node, to_node, kind FROM e0 UNION ALL SELECT floor, to_node, from_node, kind FROM e0 WHERE from_node % 61 = 0)),
c0 AS (SELECT src_floor, src_node, CASE WHEN src_floor % 7 = 1 THEN src_floor WHEN src_floor % 7 = 2 THEN 99 ELSE dst_floor END AS dst_floor, CASE WHEN src_floor % 7 = 3 THEN -5 ELSE dst_node END AS dst_node, CASE WHEN src_floor % 5 = 0 THEN 'slide' ELSE kind END AS kind FROM fx_connector),
c AS (SELECT *, CASE WHEN kind NOT IN ('elevator','stairs','ramp') THEN 'connector-kind' WHEN NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=src_floor AND n.node=src_node) THEN 'connector-source' WHEN src_floor=dst_floor THEN 'connector-same-floor'
  WHEN NOT EXISTS (SELECT 1 FROM fx_floor f WHERE f.floor=dst_floor) THEN 'connector-floor' WHEN NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=dst_floor AND n.node=dst_node) THEN 'connector-target' END AS rule FROM c0)"""
_COMP = """lab(floor, node, component) USING KEY (floor, node) AS (SELECT floor, node, node FROM fx_node UNION
  SELECT b.floor, b.o, min(l.component) FROM lab l JOIN both_ways b ON b.floor=l.floor AND b.n=l.node JOIN recurring.lab r ON r.floor=b.floor AND r.node=b.o WHERE l.component < r.component GROUP BY 1, 2)"""
_REP_E = """ee0 AS (SELECT * FROM fx_edge WHERE from_node % 4 <> 0), ee AS (SELECT floor, from_node, to_node FROM ee0 UNION ALL SELECT floor, from_node, to_node + 10000000 FROM ee0 WHERE from_node % 50 = 1),
both_ways AS (SELECT DISTINCT floor, n, o FROM (SELECT floor, from_node AS n, to_node AS o FROM ee UNION ALL SELECT floor, to_node, from_node FROM ee)),"""
_REP = f"""{_REP_E} {_COMP},
deg AS (SELECT n.floor, n.node, count(x.o) AS d FROM fx_node n LEFT JOIN (SELECT floor, from_node AS o FROM ee UNION ALL SELECT floor, to_node FROM ee) x ON x.floor=n.floor AND x.o=n.node GROUP BY 1, 2),
ent AS (SELECT DISTINCT floor FROM fx_node WHERE kind='entrance'),
reach AS (SELECT l.floor, l.node FROM lab l WHERE EXISTS (SELECT 1 FROM fx_node n JOIN lab m ON m.floor=n.floor AND m.node=n.node WHERE n.kind='entrance' AND n.floor=l.floor AND m.component=l.component)),
nb AS (SELECT b.floor, b.n, count(*) AS k, min({{'o': b.o, 'x': q.x, 'y': q.y}}) AS a, max({{'o': b.o, 'x': q.x, 'y': q.y}}) AS z FROM both_ways b JOIN fx_node q ON q.floor=b.floor AND q.node=b.o GROUP BY 1, 2),
col AS (SELECT n.floor, n.node FROM fx_node n JOIN nb ON nb.floor=n.floor AND nb.n=n.node WHERE n.kind='waypoint' AND k=2 AND ((a.x-n.x)*(z.x-n.x)+(a.y-n.y)*(z.y-n.y)) / nullif(sqrt((a.x-n.x)*(a.x-n.x)+(a.y-n.y)*(a.y-n.y)) * sqrt((z.x-n.x)*(z.x-n.x)+(z.y-n.y)*(z.y-n.y)), 0) < -0.985),
iss AS (SELECT floor, 'dangling-edge' AS code, 'error' AS severity, from_node || '-' || to_node AS subject FROM ee WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=ee.floor AND n.node=from_node) OR NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=ee.floor AND n.node=to_node)
 UNION ALL SELECT DISTINCT e.floor, 'edge-crosses-wall', 'error', e.from_node || '-' || e.to_node FROM ee e JOIN fx_node a ON e.floor=a.floor AND e.from_node=a.node JOIN fx_node b ON e.floor=b.floor AND e.to_node=b.node JOIN fx_wall w ON w.floor=e.floor WHERE {_CROSS}
 UNION ALL SELECT floor, 'isolated-node', 'warning', node::VARCHAR FROM deg WHERE d = 0
 UNION ALL SELECT l.floor, 'disconnected-graph', 'warning', l.node::VARCHAR FROM lab l WHERE (l.floor, l.component) NOT IN (SELECT floor, component FROM lab GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY floor ORDER BY count(*) DESC, component) = 1)
 UNION ALL SELECT floor, 'no-entrance', 'warning', NULL FROM fx_floor WHERE floor NOT IN (SELECT floor FROM ent)
 UNION ALL SELECT floor, 'room-unreachable', 'warning', node::VARCHAR FROM fx_node n WHERE kind IN ('room','connector') AND floor IN (SELECT floor FROM ent) AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.floor=n.floor AND r.node=n.node)
 UNION ALL SELECT floor, 'collinear-waypoint', 'info', node::VARCHAR FROM col
 UNION ALL SELECT floor, 'space-without-access', 'warning', space::VARCHAR FROM fx_space s WHERE space % 3 <> 2 AND NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=s.floor AND n.node=s.space AND n.node % 2 = 0)
 UNION ALL SELECT floor, 'opening-without-node', 'warning', opening::VARCHAR FROM fx_opening o WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=o.floor AND n.node=o.opening AND n.node % 3 = 0)
 UNION ALL SELECT floor, 'low-confidence-opening', 'info', opening::VARCHAR FROM fx_opening WHERE confidence < 0.6)"""
_REP_V = ("fx_floor", "fx_node", "fx_wall", "fx_edge", "fx_space", "fx_opening")

_DISTANCES = duck(
    f"""WITH {_LINKS}, l0 AS (SELECT src, dst_floor, dst, min(greatest(metres, 0.001)) AS m FROM links GROUP BY 1, 2, 3), s AS (SELECT floor, node FROM fx_node QUALIFY row_number() OVER (PARTITION BY building ORDER BY node) = 1),
d(start, floor, node, metres) USING KEY (start, node) AS (SELECT node, floor, node, 0.0::DOUBLE FROM s UNION SELECT d.start, l.dst_floor, l.dst, min(d.metres + l.m) FROM d JOIN l0 l ON l.src=d.node LEFT JOIN recurring.d r ON r.start=d.start AND r.node=l.dst WHERE r.metres IS NULL OR d.metres + l.m < r.metres GROUP BY 1, 2, 3)
SELECT start, floor, node, round(metres, 6) AS metres FROM d""", *_V, recursive=True)  # fmt: skip
_ASKED = f"""{_LINKS}, r0 AS (SELECT a.building, a.node AS request, a.floor AS sf, a.node AS s, a.node % 3 = 0 AS acc, CASE WHEN a.node % 50 = 0 THEN -1 ELSE (a.node * 7 + 3) % (SELECT count(*) FROM fx_node) END AS g FROM fx_node a),
rq AS (SELECT r0.*, b.building AS gb FROM r0 LEFT JOIN fx_node b ON b.node = r0.g), ask AS (SELECT DISTINCT building, s, acc FROM rq WHERE gb = building),
l0 AS (SELECT src, dst, min(greatest(metres, 0.001)) AS m, FALSE AS acc FROM links GROUP BY 1, 2 UNION ALL SELECT src, dst, min(greatest(metres, 0.001)), TRUE FROM links WHERE accessible GROUP BY 1, 2),
d(s, acc, node, metres) USING KEY (s, node) AS (SELECT s, acc, s, 0.0::DOUBLE FROM ask UNION
  SELECT d.s, d.acc, l.dst, min(d.metres + l.m) FROM d JOIN l0 l ON l.src=d.node AND l.acc=d.acc LEFT JOIN recurring.d r ON r.s=d.s AND r.node=l.dst WHERE r.metres IS NULL OR d.metres + l.m < r.metres GROUP BY 1, 2, 3)"""
_ROUTES = duck(
    f"""WITH {_ASKED} SELECT rq.request::BIGINT AS request, CASE WHEN gb IS NULL THEN 'unknown node' WHEN gb <> rq.building THEN 'goal in another building' WHEN d.metres IS NOT NULL THEN 'ok' WHEN rq.acc THEN 'no accessible route' ELSE 'no route' END AS status, round(d.metres, 6) AS metres
FROM rq LEFT JOIN d ON d.s=rq.s AND d.node=rq.g UNION ALL SELECT node + 1000000000, 'no map for the building', NULL FROM fx_node WHERE node % 97 = 1""", *_V, recursive=True)  # fmt: skip
_COST = "CASE kind WHEN 'elevator' THEN 6.0 WHEN 'stairs' THEN 10.0 WHEN 'ramp' THEN 12.0 ELSE 10.0 END::DOUBLE"
#: Steps of every route, walked back from its goal over the link into each node: the one from the node reached first, then the earliest.
_STEPS = f"""{_ASKED}, ln AS (SELECT floor AS sf, from_node AS src, to_node AS dst, metres, accessible, floor AS f, 0 AS t, from_node AS a, to_node AS b, 0 AS r, 'corridor' AS kind FROM lvl UNION ALL SELECT floor, to_node, from_node, metres, accessible, floor, 0, from_node, to_node, 1, 'corridor' FROM lvl
  UNION ALL SELECT src_floor, src_node, dst_node, {_COST}, accessible, src_floor, 1, src_node, dst_node, 0, kind FROM fx_connector UNION ALL SELECT dst_floor, dst_node, src_node, {_COST}, accessible, src_floor, 1, src_node, dst_node, 1, kind FROM fx_connector WHERE bidirectional),
into_ AS (SELECT v.s, v.node, min({{'d': u.metres, 'x': ln.sf || ':' || ln.src, 'f': f, 't': t, 'a': a, 'b': b, 'r': r, 'p': u.node, 'm': ln.metres, 'k': ln.kind}}) AS l FROM d v JOIN ln ON ln.dst = v.node JOIN d u ON u.s = v.s AND u.node = ln.src
  WHERE (ln.accessible OR NOT v.acc) AND v.node <> v.s AND u.metres + greatest(ln.metres, 0.001) = v.metres GROUP BY 1, 2),
way(request, s, node, back) AS (SELECT rq.request, rq.s, rq.g, 0 FROM rq JOIN d ON d.s = rq.s AND d.node = rq.g WHERE gb = building UNION ALL SELECT w.request, w.s, i.l.p, w.back + 1 FROM way w JOIN into_ i ON i.s = w.s AND i.node = w.node),
st AS (SELECT w.request, w.node, n.floor, max(back) OVER (PARTITION BY w.request) - back AS pos FROM way w JOIN fx_node n ON n.node = w.node)"""

#: A number with one decimal, halves away from nought.
_DECIMAL = "printf('%.1f', floor({} * 10 + 0.5) / 10)"

QUERIES = {
    "J02_placed_edges": placed_edges,
    "J03_wall_crossings": wall_crossings,
    "J03_open_edges": open_edges,
    "J05_flagged_edges": flagged_edges,
    "J01_building_floors": floors_of_building,
    "F07_sibling_floors": sibling_floors,
    "U05_route_links": route_links,
    "J19_accessible_links": accessible_links,
    "G01_distances_from_node": distances_from_node,
    "G01_relaxed_distances": relaxed_distances,
    "G02_batch_routes": batch_routes,
    "G02_relaxed_routes": relaxed_routes,
    "T07_route_steps": route_steps,
    "A18_floors_of_routes": floors_of_routes,
    "W05_route_instructions": route_instructions,
    "G17_degrees": degrees,
    "G16_components": graph_components,
    "G18_reachable_nodes": reachable_nodes,
    "M13_graph_report": graph_report,
    "M14_report_status": report_status,
    "A13_graph_metrics": graph_metrics,
    "M01_spatial_rules": spatial_rules,
    "M08_navigation_rules": navigation_rules,
    "M11_positioning_rules": positioning_rules,
    "X15_length_rules": length_rules,
}

ORACLES = {
    "J02_placed_edges": duck("SELECT e.floor, from_node, to_node, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM fx_edge e JOIN fx_node a ON e.floor=a.floor AND e.from_node=a.node JOIN fx_node b ON e.floor=b.floor AND e.to_node=b.node", "fx_edge"),
    "J03_wall_crossings": duck(f"WITH {_HIT} SELECT * FROM hit", "fx_edge", "fx_wall"),
    "J03_open_edges": duck(f"WITH {_HIT} SELECT floor, from_node, to_node FROM fx_edge e WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.floor=e.floor AND h.from_node=e.from_node AND h.to_node=e.to_node)", "fx_edge", "fx_wall"),
    "J05_flagged_edges": duck(f"WITH {_HIT} SELECT floor, from_node, to_node, EXISTS (SELECT 1 FROM hit h WHERE h.floor=e.floor AND h.from_node=e.from_node AND h.to_node=e.to_node) AS invalid FROM fx_edge e", "fx_edge", "fx_wall"),
    "J01_building_floors": duck("SELECT a.building, a.floor, b.floor AS other_floor, b.ppm AS other_ppm, c.n AS n_edges FROM fx_floor a JOIN fx_floor b USING (building) LEFT JOIN (SELECT floor, count(*) AS n FROM fx_edge GROUP BY 1) c ON c.floor=b.floor WHERE b.floor IN (SELECT floor FROM fx_node)", "fx_floor", "fx_edge"),
    "F07_sibling_floors": duck("SELECT a.building, a.floor, b.floor AS sibling FROM fx_floor a JOIN fx_floor b USING (building) WHERE a.floor <> b.floor", "fx_floor"),
    "U05_route_links": duck(f"WITH {_LINKS} SELECT building, src_floor, src, dst_floor, dst, round(metres, 6) AS metres, kind, accessible FROM links", *_V),
    "J19_accessible_links": duck(f"WITH {_LINKS} SELECT src_floor, src, dst_floor, dst, round(metres, 6) AS metres, kind FROM links l WHERE accessible AND EXISTS (SELECT 1 FROM fx_node n WHERE n.kind <> 'door' AND n.floor=src_floor AND n.node=src) AND EXISTS (SELECT 1 FROM fx_node n WHERE n.kind <> 'door' AND n.floor=dst_floor AND n.node=dst)", *_V),
    "G01_distances_from_node": _DISTANCES,
    "G01_relaxed_distances": _DISTANCES,
    "G02_batch_routes": _ROUTES,
    "G02_relaxed_routes": _ROUTES,
    "T07_route_steps": duck(f"WITH {_STEPS} SELECT request, pos, floor, node FROM st", *_V, recursive=True),
    # A walk between vertical links is what lies between two of them: the number of vertical links before it tells which.
    "W05_route_instructions": duck(f"""WITH {_STEPS}, mv AS (SELECT st.request, st.pos, n.label AS place, f.floor_label, i.l.m AS m, i.l.k AS k, i.l.t = 1 AS up FROM st JOIN rq ON rq.request = st.request JOIN fx_node n ON n.node = st.node JOIN fx_floor f ON f.floor = st.floor LEFT JOIN into_ i ON i.s = rq.s AND i.node = st.node AND st.pos > 0),
c AS (SELECT *, count(*) FILTER (up) OVER (PARTITION BY request ORDER BY pos) AS n FROM mv WHERE pos > 0), w AS (SELECT request, max(pos) AS pos, sum(m) AS m, arg_max(place, pos) AS place FROM c WHERE NOT up GROUP BY request, n)
SELECT request::BIGINT AS request, pos::INT AS pos, 'Avanza ' || {_DECIMAL.format("m")} || ' m' || CASE WHEN coalesce(place, '') <> '' THEN ' hasta ' || place ELSE '' END || '.' AS instruction FROM w WHERE m > 0
UNION ALL SELECT request, pos, CASE k WHEN 'elevator' THEN 'Toma el ascensor' WHEN 'stairs' THEN 'Usa las escaleras' ELSE 'Usa la rampa' END || ' hacia ' || coalesce(floor_label, 'otro piso') || '.' FROM c WHERE up
UNION ALL SELECT request, max(pos) + 1, 'Llegaste a ' || coalesce(arg_max(place, pos), 'tu destino') || '.' FROM mv GROUP BY request""", *_V, recursive=True),
    "A18_floors_of_routes": duck(f"WITH {_STEPS}, o AS (SELECT st.request, count(*) AS shown FROM st JOIN st h ON h.request = st.request AND h.pos = 0 AND h.floor = st.floor GROUP BY 1) SELECT st.request, st.floor::VARCHAR AS floor, min(pos) AS first_pos, any_value(shown) AS shown FROM st JOIN o USING (request) GROUP BY 1, 2", *_V, recursive=True),
    "G17_degrees": duck("SELECT n.floor, n.node, count(e.o) AS degree FROM fx_node n LEFT JOIN (SELECT floor, from_node AS o FROM fx_edge UNION ALL SELECT floor, to_node FROM fx_edge) e ON e.floor=n.floor AND e.o=n.node GROUP BY 1, 2", "fx_node", "fx_edge"),
    "G16_components": duck(f"WITH {_HIT}, oe AS (SELECT * FROM fx_edge e WHERE from_node % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.floor=e.floor AND h.from_node=e.from_node AND h.to_node=e.to_node)), both_ways AS (SELECT floor, from_node AS n, to_node AS o FROM oe UNION SELECT floor, to_node, from_node FROM oe), {_COMP} SELECT floor, node, component FROM lab", "fx_edge", "fx_wall", recursive=True),
    "G18_reachable_nodes": duck(f"WITH oe AS (SELECT * FROM fx_edge WHERE from_node % 4 <> 0 AND to_node % 3 <> 0), both_ways AS (SELECT floor, from_node AS n, to_node AS o FROM oe UNION SELECT floor, to_node, from_node FROM oe), {_COMP} SELECT floor, node FROM lab l WHERE EXISTS (SELECT 1 FROM fx_node n JOIN lab m ON m.floor=n.floor AND m.node=n.node WHERE n.kind='entrance' AND n.floor=l.floor AND m.component=l.component)", "fx_edge", recursive=True),
    "M13_graph_report": duck(f"WITH {_REP} SELECT * FROM iss", *_REP_V, recursive=True),
    "A13_graph_metrics": duck(f"""WITH {_REP}, v AS (SELECT floor, 'nodes' AS name, count(*) AS n FROM fx_node GROUP BY 1 UNION ALL SELECT floor, 'edges', count(*) FROM ee0 GROUP BY 1 UNION ALL SELECT floor, 'entrances', count(*) FROM fx_node WHERE kind = 'entrance' GROUP BY 1
 UNION ALL SELECT floor, 'components', count(DISTINCT component) FROM lab GROUP BY 1 UNION ALL SELECT floor, CASE code WHEN 'edge-crosses-wall' THEN 'edges_crossing_walls' WHEN 'room-unreachable' THEN 'rooms_unreachable_from_entrance' WHEN 'space-without-access' THEN 'spaces_without_node' WHEN 'collinear-waypoint' THEN 'collinear_waypoints' END, count(*) FROM iss GROUP BY 1, 2)
SELECT f.floor, m.name, coalesce(v.n, 0)::DOUBLE AS value FROM fx_floor f CROSS JOIN (VALUES ('nodes'), ('edges'), ('entrances'), ('components'), ('edges_crossing_walls'), ('rooms_unreachable_from_entrance'), ('spaces_without_node'), ('collinear_waypoints')) m(name) LEFT JOIN v ON v.floor = f.floor AND v.name = m.name""", *_REP_V, recursive=True),
    "M14_report_status": duck(f"WITH {_REP}, i AS (SELECT * FROM iss WHERE floor % 3 = 0 OR severity <> 'error') SELECT f.floor, CASE WHEN coalesce(e, 0) > 0 THEN 'errors' WHEN coalesce(w, 0) > 0 THEN 'warnings' ELSE 'ok' END AS status, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM fx_floor f LEFT JOIN (SELECT floor, count(*) FILTER (severity='error') AS e, count(*) FILTER (severity='warning') AS w FROM i GROUP BY 1) g ON g.floor=f.floor", *_REP_V, recursive=True),
    "M01_spatial_rules": duck("""WITH n AS (SELECT floor, node, label FROM fx_node UNION ALL SELECT floor, node, label FROM fx_node WHERE node % 97 = 0)
SELECT floor, 'wall-length' AS rule, wall::VARCHAR AS subject FROM fx_wall WHERE wall % 13 = 0 OR sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) < 1
UNION ALL SELECT floor, 'node-label', node::VARCHAR FROM n WHERE trim(label) = '' UNION ALL SELECT floor, 'poi-name', poi::VARCHAR FROM fx_poi WHERE trim(name) = '' UNION ALL SELECT floor, 'poi-category', poi::VARCHAR FROM fx_poi WHERE trim(category) = ''
UNION ALL SELECT floor, 'scale', floor::VARCHAR FROM fx_floor WHERE floor % 11 = 0 UNION ALL SELECT floor, 'node-twice', node::VARCHAR FROM n GROUP BY floor, node HAVING count(*) > 1
UNION ALL SELECT floor, 'poi-node', poi::VARCHAR FROM fx_poi p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.floor=p.floor AND n.node=p.node)""", "fx_floor", "fx_wall", "fx_node", "fx_poi"),
    "M08_navigation_rules": duck(f"""WITH {_E_NAV} SELECT floor, 'edge-loop' AS rule, s AS subject FROM e WHERE from_node = to_node UNION ALL SELECT floor, 'edge-kind', s FROM e WHERE kind NOT IN ('corridor','doorway')
UNION ALL SELECT floor, 'edge-twice', least(from_node,to_node) || '-' || greatest(from_node,to_node) FROM e GROUP BY floor, least(from_node,to_node), greatest(from_node,to_node) HAVING count(*) > 1
UNION ALL SELECT floor, 'edge-from', s FROM e WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=e.floor AND n.node=e.from_node) UNION ALL SELECT floor, 'edge-to', s FROM e WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=e.floor AND n.node=e.to_node)
UNION ALL SELECT src_floor, rule, src_node || '-' || dst_floor || '-' || dst_node FROM c WHERE rule IS NOT NULL""", "fx_floor", "fx_node", "fx_edge", "fx_connector"),
    "M11_positioning_rules": duck("""SELECT floor, 'qr-code' AS rule, qr::VARCHAR AS subject FROM fx_qr WHERE trim(code) = '' UNION ALL SELECT floor, 'qr-label', qr::VARCHAR FROM fx_qr WHERE trim(label) = ''
UNION ALL SELECT floor, 'qr-twice', lower(trim(code)) FROM fx_qr GROUP BY floor, lower(trim(code)) HAVING count(*) > 1 UNION ALL SELECT floor, 'qr-node', qr::VARCHAR FROM fx_qr q WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=q.floor AND n.node=q.node)""", "fx_qr", "fx_node"),
    "X15_length_rules": duck("SELECT floor, 'length-name' AS rule, poi::VARCHAR AS subject FROM fx_poi WHERE length(repeat(coalesce(name, ''), poi % 10)) NOT BETWEEN 1 AND 160 UNION ALL SELECT floor, 'length-category', poi::VARCHAR FROM fx_poi WHERE length(repeat(coalesce(category, ''), poi % 10)) NOT BETWEEN 1 AND 80", "fx_poi"),
}
