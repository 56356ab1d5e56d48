"""Routes on small networks and on the sample floor."""

import pytest
from pyspark.sql import functions as F

from atriumq.operators import network, routing
from atriumq.sources.sample import sample

LINK = "building int, src_floor int, src string, dst_floor int, dst string, metres double, kind string, label string, accessible boolean"


def _links(spark, rows):
    data = [(0, 1, a, 1, b, m, k, None, ok) for a, b, m, k, ok in rows]
    order = F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).alias("t"), F.monotonically_increasing_id().alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("r"))
    return spark.createDataFrame(data, LINK).coalesce(1).withColumn("ord", order)


def _route(spark, links, nodes, start, goal, only=False):
    n = spark.createDataFrame([(0, 1, x) for x in nodes], "building int, floor int, node string")
    ask = spark.createDataFrame([(1, 0, 1, start, 1, goal, only)], "request long, building int, start_floor int, start string, goal_floor int, goal string, accessible_only boolean")
    steps = sorted(routing.routes(ask, n, links).collect(), key=lambda r: r.pos)
    return steps[0].status, [r.node for r in steps], steps[-1].metres


def test_two_cheap_links_beat_a_direct_one(spark):
    links = _links(spark, [("A", "B", 2.0, "corridor", True), ("B", "C", 2.0, "corridor", True), ("A", "C", 10.0, "corridor", True)])
    assert _route(spark, links, "ABC", "A", "C") == ("ok", ["A", "B", "C"], 4.0)


def test_accessible_routes_avoid_stairs(spark):
    links = _links(spark, [("A", "C", 1.0, "stairs", False), ("A", "B", 3.0, "corridor", True), ("B", "C", 3.0, "corridor", True)])
    assert _route(spark, links, "ABC", "A", "C", True) == ("ok", ["A", "B", "C"], 6.0)
    assert _route(spark, links, "ABC", "A", "C")[2] == 1.0


def test_reasons(spark):
    links = _links(spark, [("A", "B", 1.0, "stairs", False)])
    assert _route(spark, links, "ABC", "A", "C")[0] == "no route"
    assert _route(spark, links, "ABC", "A", "B", True)[0] == "no accessible route"
    assert _route(spark, links, "ABC", "A", "Z")[0] == "unknown node"


def _floor(spark, walls):
    nodes = [(0, 1, "A", 0.0, 0.0), (0, 1, "B", 10.0, 0.0), (0, 1, "C", 0.0, 3.0), (0, 1, "D", 10.0, 3.0)]
    edges = [(1, a, b, "corridor", True) for a, b in ("AB", "AC", "CD", "DB")]
    n = spark.createDataFrame(nodes, "building int, floor int, node string, x double, y double")
    e = spark.createDataFrame(edges, "floor int, from_node string, to_node string, kind string, accessible boolean")
    w = spark.createDataFrame([(1, k, *x) for k, x in enumerate(walls)], "floor int, wall int, sx double, sy double, ex double, ey double")
    return n, network.open_edges(network.placed_edges(e, n), w)


def _names(df):
    return {r.from_node + r.to_node for r in df.collect()}


def test_walls_block_what_they_cross_and_not_what_they_touch(spark):
    _, left = _floor(spark, [(5.0, -1.0, 5.0, 1.0)])
    assert _names(left) == {"AC", "CD", "DB"}
    _, left = _floor(spark, [(10.0, 0.0, 10.0, 5.0), (2.0, 0.0, 8.0, 0.0)])
    assert _names(left) == {"AB", "AC", "CD", "DB"}


WANT = {
    "entrada": (0.0, 1), "recepcion": (9.8522, 2), "espera": (21.9212, 3), "cruce_oeste": (31.5271, 4), "pasillo_norte": (42.3645, 5), "consultorio_101": (49.0148, 6), "ascensor": (53.9409, 7),
    "escaleras": (59.6059, 8), "pasillo_norte_este": (62.3153, 6), "consultorio_103": (67.4877, 7), "pasillo_este": (73.1527, 7), "consultorio_104": (76.6010, 8), "pasillo_sur": (39.4089, 5),
    "laboratorio": (51.2315, 6), "rayos_x": (41.1330, 6), "farmacia": (50.7389, 6), "salida": (64.7783, 7),
}


def test_sample_floor(spark):
    s = sample(spark)
    placed = network.placed_edges(s["edges"], s["nodes"])
    assert {r.wall for r in network.crossings(placed, s["walls"]).collect()} == {2, 6, 8}
    assert {r.ord for r in network.blocked_edges(placed, s["walls"]).collect()} == {10, 12}
    links = network.links(s["floors"], s["nodes"], s["edges"], s["walls"], s["connectors"])
    ask = s["nodes"].select(F.col("ord").cast("long").alias("request"), "building", F.lit(1).alias("start_floor"), F.lit("entrada").alias("start"), F.col("floor").alias("goal_floor"), F.col("node").alias("goal"), F.lit(False).alias("accessible_only"))
    steps = routing.routes(ask, s["nodes"], links)
    got = {r.node: (r.metres, r.n) for r in steps.where("status = 'ok'").groupBy("request").agg(F.max_by("node", "pos").alias("node"), F.max("metres").alias("metres"), F.count("*").alias("n")).collect()}
    assert set(got) == set(WANT)
    for node, (metres, n) in WANT.items():
        assert got[node] == (pytest.approx(metres, abs=1e-4), n)
    assert [r.status for r in steps.where("status <> 'ok'").collect()] == ["no route"]
    told = routing.instructions(steps.where("request = 2"), s["nodes"], s["floors"])
    assert [r.instruction for r in told.orderBy("pos").collect()] == ["Avanza 21.9 m hasta Sala de espera.", "Llegaste a Sala de espera."]
    relaxed = routing.distances(links, s["nodes"].where("node = 'entrada'").select("floor", "node"))
    assert {r.node: r.metres for r in relaxed.collect()} == {k: pytest.approx(v[0], abs=1e-4) for k, v in WANT.items()}


def test_joins_alone_give_the_same_routes(spark, monkeypatch):
    """Ties and all, step by step; and buildings that no task should hold take that way."""
    import random

    rnd = random.Random(4)
    names = [f"n{k}" for k in range(30)]
    links = _links(spark, [(rnd.choice(names), rnd.choice(names), float(rnd.randint(1, 3)), "corridor", rnd.random() < 0.7) for _ in range(110)])
    nodes = spark.createDataFrame([(0, 1, x) for x in names[:28]], "building int, floor int, node string")
    asks = [(k, rnd.choice([0, 0, 0, 7]), 1, rnd.choice(names), rnd.choice([1, 1, 2]), rnd.choice(names), rnd.random() < 0.3) for k in range(60)]
    ask = spark.createDataFrame(asks, "request long, building int, start_floor int, start string, goal_floor int, goal string, accessible_only boolean")
    rows = lambda: sorted(map(tuple, routing.routes(ask, nodes, links).collect()), key=str)
    want = rows()
    assert len({r[1] for r in want}) >= 4
    monkeypatch.setattr(routing, "MOST_LINKS", 10)
    assert rows() == want
    monkeypatch.setattr(routing, "REQUESTS", 3)
    monkeypatch.setattr(routing, "MOST_LINKS", 10**6)
    assert rows() == want


def test_floors_from_the_catalog_with_ids_of_text(spark):
    from atriumq.operators import graphs
    from atriumq.sources.sample import sample

    s = sample(spark)
    labels = {r.node: r.component for r in graphs.components(s["nodes"], s["edges"]).collect()}
    relaxed = {r.node: r.component for r in graphs.relaxed_labels(s["edges"]).collect()}
    assert len(labels) == s["nodes"].count() and all(labels[k] == v for k, v in relaxed.items()) and set(labels.values()) == {min(labels)}
    issues = graphs.report(s["floors"], s["nodes"], s["edges"], s["walls"], None, None)
    found = {(r.code, r.subject) for r in issues.collect()}
    assert sum(c == "edge-crosses-wall" for c, _ in found) == 2


def test_long_edges_and_walls_meet_in_the_cells_along_them(spark):
    import random

    from pyspark.sql import functions as F

    from atriumq.functions import geometry as g
    from atriumq.operators import network

    rng = random.Random(4)
    at = lambda: float(rng.randrange(-3000, 3000))
    ends = [(at(), at(), at(), at()) for _ in range(60)] + [(0.0, 0.0, 0.0, 2000.0), (-500.0, 128.0, 900.0, 128.0), (128.0, -900.0, 128.0, 900.0), (-1000.0, -1000.0, 1000.0, 1000.0)]
    edges = spark.createDataFrame([(0, k, k + 1000, *e) for k, e in enumerate(ends)], "floor int, from_node int, to_node int, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame([(0, k, at(), at(), at(), at()) for k in range(60)] + [(0, 90 + k, *e) for k, e in enumerate(ends[-4:])], "floor int, wall int, sx double, sy double, ex double, ey double")
    got = sorted(map(tuple, network.crossings(edges, walls).collect()))
    every = edges.join(walls, "floor").where(g.crosses(*(F.col(c) for c in ("ax", "ay", "bx", "by", "sx", "sy", "ex", "ey"))))
    assert got == sorted(map(tuple, every.select("floor", "from_node", "to_node", "wall").collect())) and len(got) > 100
    side = network.along_cells(edges, ("ax", "ay", "bx", "by")).groupBy("from_node").count().collect()
    assert max(r["count"] for r in side) <= 2 * (6000 // 128 + 2)


def test_requests_meet_only_the_links_that_their_start_is_joined_to(spark, monkeypatch):
    """Pairs of nodes apart from each other: every request is searched in its own pair, whatever the number of requests of the building."""
    n = 40
    nodes = spark.createDataFrame([(1, 0, k) for k in range(2 * n)], "building int, floor int, node int")
    links = spark.createDataFrame([(1, 0, 2 * k + i, 0, 2 * k + 1 - i, 2.0, "corridor", None, True, (0, 0, 2 * k, 2 * k + 1, i)) for k in range(n) for i in (0, 1)], "building int, src_floor int, src int, dst_floor int, dst int, metres double, kind string, label string, accessible boolean, ord struct<f: int, t: int, n: int, a: int, b: int>".replace("f: int, t: int, n: int, a: int, b: int", "f: int, t: int, n: int, a: int, r: int"))
    links = links.withColumn("ord", F.expr("named_struct('f', 0, 't', 0, 'n', 0, 'a', ord.n, 'b', ord.a, 'r', ord.r)"))
    asked = spark.createDataFrame([(k, 1, 0, k, 0, k ^ 1 if k % 4 else (k + 2) % (2 * n), k % 8 == 0) for k in range(2 * n)], "request long, building int, start_floor int, start int, goal_floor int, goal int, accessible_only boolean")
    sent, real = [], routing.kept
    monkeypatch.setattr(routing, "REQUESTS", 1)
    monkeypatch.setattr(routing, "kept", lambda df, name: (sent.append(real(df, name)) or sent[-1]) if name == "parts" else real(df, name))
    got = {r.request: (r.status, r.n) for r in routing.routes(asked, nodes, links).groupBy("request").agg(F.first("status").alias("status"), F.count("*").alias("n")).collect()}
    assert got == {k: ("ok", 2) if k % 4 else ("no accessible route" if k % 8 == 0 else "no route", 1) for k in range(2 * n)}
    assert sent[0].agg(F.max("parts")).first()[0] <= 2  # before: one part a request, each with all links of the building
