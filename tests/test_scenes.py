"""Whole plans: synthetic floors against the labels they are drawn from, and proposals against known values."""

import base64

import pytest
from pyspark.sql import functions as F

from atriumq.operators import proposals
from atriumq.plans import structural
from atriumq.raster import drawings
from atriumq.sources import synthetic


@pytest.fixture(scope="module")
def scenes():
    """Scenes of some synthetic floors beside their cases."""
    out = {}
    for seed in (180, 183, 188, 189):
        case = synthetic.clinic(seed)
        page = drawings.parse(synthetic.drawing(case).encode(), 1.0)
        out[seed] = case, structural.scene_of(page, None, structural.Options(raster_scale=1.0), float(synthetic.PX_PER_METER))
    return out


def test_rooms_doors_and_entrances_are_those_of_the_case(scenes):
    for case, scene in scenes.values():
        kinds = lambda part: [x["kind"] for x in scene[part]]  # noqa: E731, B023
        assert kinds("spaces").count("room") == len(case["rooms"]) and kinds("spaces").count("circulation") == 1
        assert kinds("openings").count("door") == len(case["doors"]) and kinds("openings").count("entrance") == 2
        px = synthetic.PX_PER_METER
        for d in case["doors"]:  # every door is found where it was drawn, about as wide
            near = min((o for o in scene["openings"] if o["kind"] == "door"), key=lambda o: (o["center"][0] - d["x"] * px) ** 2 + (o["center"][1] - d["y"] * px) ** 2)  # noqa: B023
            assert abs(near["center"][0] - d["x"] * px) < 6 and abs(near["center"][1] - d["y"] * px) < 12 and 0.6 * px <= near["width_px"] <= 1.3 * px
        assert len({s["label"] for s in scene["spaces"] if s["kind"] == "room"}) >= 1


def test_graphs_join_all_rooms_and_pass_no_wall(scenes):
    for case, scene in scenes.values():
        nodes, edges = scene["graph"]["nodes"], scene["graph"]["edges"]
        assert dict(scene["validation"]["metrics"])["edges_crossing_walls"] == 0
        root = {n["id"]: n["id"] for n in nodes}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            root[top(e["from"])] = top(e["to"])
        assert len({top(n["id"]) for n in nodes}) == 1
        assert sum(n["kind"] == "room" for n in nodes) == len(case["rooms"])
        assert len(nodes) < 3 * len(case["doors"]) + 10


def test_analysis_and_its_report(spark):
    svg = synthetic.drawing(synthetic.clinic(183)).encode()
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"0" * 60)
    plans = spark.createDataFrame([("a", svg, 28.0), ("b", b"", 28.0), ("c", png, None), ("d", b"<svg", None), ("e", None, None)], "floorplan_id string, content binary, pixels_per_meter double")
    got = {r.floorplan_id: r for r in structural.validated(structural.analyze(plans, structural.Options(raster_scale=1.0))).collect()}
    assert got["b"].status == got["e"].status == "empty file" and got["c"].status == "unsupported content" and got["d"].status.startswith("ParseError") and got["d"].scene is None
    v, d = got["a"].scene.validation, got["a"].scene.diagnostics
    assert v.metrics["components"] == 1 and v.metrics["entrances"] == 2 and v.metrics["edges_crossing_walls"] == 0 and v.metrics["nodes"] == len(got["a"].scene.graph.nodes)
    assert v.status in ("ok", "warnings") and {"backend", "source_kind", "scale_source", "pixels_per_meter", "wall_polygons", "obstacles", "windows", "doors", "entrances", "spaces", "circulation_spaces", "nodes", "edges", "edges_dropped_crossing", "labels"} <= set(d)
    assert d["source_kind"] == "svg-vector" and int(d["doors"]) == 10 and int(d["spaces"]) == 11


def test_cases_are_written_as_files(spark, tmp_path):
    synthetic.write_clinics(synthetic.clinics(spark, 180, 2), str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "svg").glob("stem=*")) == ["stem=clinic_00180", "stem=clinic_00181"]
    assert "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "json" / "stem=clinic_00180")).collect()).startswith('{\n  "schema_version": 1')


def test_a_proposal(spark):
    """Two walls, an obstacle, six nodes and five edges, of which one passes a wall; a place beside a room."""
    rect = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d)]]
    ring = "array<array<struct<x:double,y:double>>>"
    f = lambda r: [[tuple(map(float, q)) for q in ring] for ring in r]
    polygons = spark.createDataFrame([("f", 0, f(rect(0, 45, 180, 55))), ("f", 1, f(rect(220, 45, 500, 55))), ("f", 2, f(rect(300, 70, 310, 80)))], f"floor string, ord int, rings {ring}")
    points = [("j1", 20, 100, "decision", None), ("j2", 200, 100, "decision", None), ("d1", 200, 50, "door", None), ("r1", 200, 20, "room", "Consultorio 1"), ("j3", 400, 100, "waypoint", None), ("bad", 100, 20, "waypoint", " ")]
    nodes = spark.createDataFrame([("f", k, i, float(x), float(y), kind, label) for i, (k, x, y, kind, label) in enumerate(points)], "floor string, node string, ord int, x double, y double, kind string, label string")
    pairs = [("j1", "j2", "corridor"), ("j2", "d1", "doorway"), ("d1", "r1", "doorway"), ("j2", "j3", "corridor"), ("j1", "bad", "corridor")]
    edges = spark.createDataFrame([("f", a, b, k, i) for i, (a, b, k) in enumerate(pairs)], "floor string, from_node string, to_node string, kind string, ord int")
    pois = spark.createDataFrame([("f", "p", 190.0, 25.0)], "floor string, poi string, x double, y double")
    floors = spark.createDataFrame([("f",), ("empty",)], "floor string")
    got = proposals.proposal(floors, polygons, nodes, edges, pois)
    assert got["walls"].count() == 12
    assert {(r.from_node, r.to_node, r.kind) for r in got["edges"].collect()} == set(pairs[:4])
    assert [r.node_id for r in got["pois"].collect()] == ["r1"]
    assert {r.node: r.label for r in got["nodes"].collect()} == {"j1": "G1", "j2": "G2", "d1": "P1", "r1": "Consultorio 1", "j3": "N1", "bad": "N2"}
    assert {r.floor: (r.edges_rejected_by_walls, r.refused) for r in got["diagnostics"].collect()} == {"f": (1, None), "empty": (0, "too-few-nodes")}
    again = proposals.proposal(floors, polygons, nodes, edges, pois)
    assert {(r.node, r.id) for r in again["nodes"].collect()} == {(r.node, r.id) for r in got["nodes"].collect()}
    assert got["nodes"].select(F.countDistinct("id")).first()[0] == 6
