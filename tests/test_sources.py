"""Files, catalog, payloads and synthetic floors."""

import base64
import json

from pyspark.sql import functions as F

from atriumq.functions import geometry as g
from atriumq.functions import text as t
from atriumq.operators import checks, graphs
from atriumq.plans import structural
from atriumq.sources import catalog, payload, synthetic, uploads
from atriumq.sources.sample import sample
from atriumq.streaming import arriving_plans

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 60


def test_content_wins_over_names(spark):
    files = [("a.jpg", PNG, "image/png"), ("b.jpg", b"\xff\xd8\xff\xe0x", "image/jpeg"), ("c", b"%PDF-1.4", "application/pdf"), ("d", b"\n <svg/>", "image/svg+xml"), ("e.svg", b"<SVG/>", "application/octet-stream"), ("f", b"", "application/octet-stream")]
    df = spark.createDataFrame(files, "name string, content binary, want string")
    assert df.where(t.media_type(F.col("content")) != F.col("want")).count() == 0
    assert df.where(t.is_svg(F.col("content"))).count() == 2


def test_base64_is_unwrapped_only_into_known_files(spark):
    wrapped = base64.b64encode(PNG)
    rows = [(1, wrapped, PNG), (2, b"data:image/png;base64," + wrapped, PNG), (3, wrapped.rstrip(b"="), PNG), (4, base64.b64encode(b"hello, this is no file"), None), (5, PNG, PNG), (6, b"<svg/>", b"<svg/>")]
    df = spark.createDataFrame(rows, "k int, content binary, want binary").select("k", t.unwrapped(F.col("content")).alias("got"), F.coalesce("want", "content").alias("want"))
    assert [r.k for r in df.where("got <> want").collect()] == []


def test_uploads(spark):
    rows = [("plan.PDF", "n", "b", "1", b"%PDF-1"), ("plan.exe", "n", "b", "1", b"x"), ("plan.png", "n", "b", "1", b""), ("plan.png", " ", "b", "1", PNG), ("plan.png", " n ", "b", "1", PNG)]
    df = spark.createDataFrame(rows, "filename string, name string, building string, floor_label string, content binary")
    assert [r.error for r in uploads.checked(df).collect()] == [None, "unsupported file type", "empty file", "blank name", None]
    kept = uploads.registered(df).collect()
    assert {r.name for r in kept} == {"n"} and {r.stored_filename.rsplit(".", 1)[1] for r in kept} == {"pdf", "png"}
    names = spark.createDataFrame([("a.png", True), ("../a", False), ("x/../../a", False), ("/etc/a", False), ("x/../a", True), ("", False)], "n string, ok boolean")
    assert names.where(uploads.inside(F.col("n")) != F.col("ok")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(b"",), (b"x",), (None,)], "c binary").select(uploads.analysable(F.col("c"))).collect()] == [400, 200, 400]


def test_binary_files_and_images(spark, tmp_path):
    from pathlib import Path

    gif = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")
    Path(tmp_path, "a.gif").write_bytes(gif)
    assert uploads.files(spark, str(tmp_path)).first().content == gif
    one = uploads.images(spark, str(tmp_path)).first()
    assert (one.height, one.width) == (1, 1)


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    rows = catalog.created(spark.createDataFrame([("f1", " A ", "B", "1"), ("f2", "C", "B", "2")], "id string, name string, building_name string, floor_label string"))
    c.upsert("floorplans", rows)
    c.upsert("floorplans", rows.where("id = 'f2'").withColumn("name", F.lit("D")))
    assert {(r.id, r.name) for r in c.list_floorplans().collect()} == {("f1", "A"), ("f2", "D")}
    s = sample(spark)
    nodes = s["nodes"].groupBy().agg(F.collect_list(F.struct(F.col("node").alias("id"), F.struct("x", "y").alias("position"), F.when(F.col("ord") > 0, F.col("label")).alias("label"), F.lit(None).cast("string").alias("kind"))).alias("nodes"))
    c.upsert("spatial_models", nodes.select(F.lit("f1").alias("floorplan_id"), F.lit(20.3).alias("pixels_per_meter"), "nodes"))
    got = catalog.nodes_of(c.get("spatial_models", "f1"))
    assert got.count() == 18 and {r.kind for r in got.collect()} == {"waypoint"} and got.where("ord = 0").first().label == "Nodo"
    c.delete_floorplans(spark.createDataFrame([("f1",)], "id string"))
    assert c.table("spatial_models").count() == 0 and c.table("floorplans").count() == 1
    urls = spark.createDataFrame([("x", "application/pdf"), ("y", "image/png")], "i string, m string").select(catalog.preview_url(F.col("i"), F.col("m"))).collect()
    assert [r[0] for r in urls] == ["/api/v1/floorplans/x/preview", None]


def test_payload_reader(spark):
    poly = {"outer": [[0, 0], [4, 0], [4, 1]], "holes": []}
    new = {"image_size": {"width": 9, "height": 8}, "scale": {"pixels_per_meter": 20.5, "source": "estimated"}, "openings": [{"id": "o1", "kind": "entrance", "polygon": poly, "spaces": ["s1"]}], "doors": [poly, poly], "validation": {"status": "warnings"}, "walls": [poly]}
    old = {"image_size": {"width": 9, "height": 8}, "doors": [poly], "openings": [], "spaces": [{"id": "s", "polygon": {"outer": [[0, 0]], "holes": []}}]}
    df = spark.createDataFrame([("a", json.dumps(new)), ("b", json.dumps(old))], "floorplan_id string, payload string")
    got = {r.floorplan_id: r for r in payload.read_analysis(df).collect()}
    assert got["a"].openings[0].kind == "entrance" and got["a"].openings[0].spaces == ["s1", None] and got["a"].estimated_pixels_per_meter == 20.5 and got["a"].status == "warnings"
    assert len(got["b"].openings) == 1 and got["b"].openings[0].kind == "door" and got["b"].spaces == [] and got["b"].status == "ok"


def test_synthetic_clinic_is_its_seed_and_no_more():
    a, b = synthetic.clinic(180), synthetic.clinic(180)
    assert a == b and a != synthetic.clinic(181)
    assert len(a["rooms"]) == len(a["doors"]) == len(a["pois"]) and a["seed"] == 180
    ids = {n["id"] for n in a["navigation"]["nodes"]}
    assert all(e["from"] in ids and e["to"] in ids for e in a["navigation"]["edges"]) and {"entry", "exit"} <= ids
    assert synthetic.drawing(a).count("<path") == len(a["doors"])


def test_scenes_of_files(spark, tmp_path):
    made = synthetic.clinics(spark, 183, 1)
    plans = made.select(F.col("seed").cast("string").alias("floorplan_id"), F.col("svg").cast("binary").alias("content")).unionByName(spark.createDataFrame([("bad", b"<svg"), ("none", b""), ("pdf", b"%PDF-1")], "floorplan_id string, content binary"))
    got = structural.analyze(plans.withColumn("pixels_per_meter", F.lit(28.0)).coalesce(1), structural.Options(raster_scale=1.0)).cache()
    by = {r.floorplan_id: r for r in got.collect()}
    case = synthetic.clinic(183)
    scene = by["183"].scene
    assert sum(s.kind == "room" for s in scene.spaces) == len(case["rooms"]) and sum(s.kind == "circulation" for s in scene.spaces) == 1
    assert sum(o.kind == "door" for o in scene.openings) == len(case["doors"]) and sum(o.kind == "entrance" for o in scene.openings) == 2
    assert all(s.label for s in scene.spaces if s.kind == "room") and len(scene.graph.nodes) < 3 * len(case["doors"]) + 10
    assert by["bad"].scene is None and by["bad"].status != "ok" and by["none"].status == "empty file" and by["pdf"].status == "unsupported content"
    back = payload.read_analysis(payload.write_payload(got.where("scene IS NOT NULL"))).first()
    assert len(back.openings) == len(scene.openings) and back.estimated_pixels_per_meter == 28.0
    assert all(x == round(x, 2) for ring in back.walls for point in ring.outer for x in point)
    t_ = structural.tables(got)
    assert t_["edges"].count() == len(scene.graph.edges) and t_["polygons"].count() >= 1
    from pathlib import Path

    Path(tmp_path, "in").mkdir()
    Path(tmp_path, "in", "p.svg").write_text('<svg width="60" height="40"><rect x="5" y="5" width="50" height="30" fill="none" stroke="#000" stroke-width="4"/></svg>')
    q = arriving_plans(spark, str(tmp_path / "in"), structural.Options(pixels_per_meter=10.0)).select("status").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [r.status for r in spark.table("arrived").collect()] == ["ok"]


def test_scalars_and_rules(spark):
    one = spark.range(1)
    got = one.select(g.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("d"), g.calibrated(F.lit(500.0), F.lit(10.0))["ppm"].alias("ppm"), g.measured_meters(F.lit(250.0), F.lit(50.0)).alias("m"), g.calibrated(F.lit(5.0), F.lit(0.0))["error"].alias("e"), g.measured_meters(F.lit(1.0), F.lit(0.0)).alias("none")).first()
    assert tuple(got) == (5.0, 50.0, 5.0, "distance must be positive", None)
    words = spark.createDataFrame([("VESTÍBULO", True), ("sala de espera", True), ("ñhall", False), ("hallway", False)], "w string, c boolean")
    assert words.where(t.is_circulation(F.col("w")) != F.col("c")).count() == 0
    n = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "floor int, node string, label string")
    e = spark.createDataFrame([(1, "a", "a", "corridor"), (1, "a", "b", "corridor"), (1, "b", "a", "corridor")], "floor int, from_node string, to_node string, kind string")
    c = spark.createDataFrame([], "src_floor int, src_node string, dst_floor int, dst_node string, kind string")
    f = spark.createDataFrame([(1,)], "floor int")
    assert {(r.rule, r.subject) for r in checks.navigation_rules(e, c, n, f).collect()} == {("edge-loop", "a-a"), ("edge-twice", "a-b")}
    q = spark.createDataFrame([(1, 1, "QR-1", "x", "a"), (1, 2, " qr-1 ", "y", "z")], "floor int, qr int, code string, label string, node string")
    assert {(r.rule, r.subject) for r in checks.positioning_rules(q, n).collect()} == {("qr-twice", "qr-1"), ("qr-node", "2")}


def test_pairs_without_an_end_have_no_name(spark):
    n = spark.createDataFrame([(1, 1, "door", 0.0, 0.0), (1, 2, "door", 1.0, 0.0)], "floor int, node int, kind string, x double, y double")
    e = spark.createDataFrame([(1, 1, None, "corridor"), (1, None, 2, "tunnel"), (1, 1, 2, "corridor"), (1, None, None, "doorway"), (1, None, None, "doorway")], "floor int, from_node int, to_node int, kind string")
    c = spark.createDataFrame([(1, None, 1, 2, "stairs"), (1, 1, 7, 2, "stairs")], "src_floor int, src_node int, dst_floor int, dst_node int, kind string")
    f = spark.createDataFrame([(1,)], "floor int")
    got = sorted((r.rule, str(r.subject)) for r in checks.navigation_rules(e, c, n, f).collect())
    lost = [("edge-from", "None")] * 3 + [("edge-kind", "None")] + [("edge-to", "None")] * 3 + [("edge-twice", "None")]
    assert got == [("connector-floor", "1-7-2"), ("connector-source", "None"), *lost]
    report = graphs.report(f, n.withColumn("ord", F.col("node")), e.withColumn("accessible", F.lit(True)), None, None, None)
    assert {r.subject for r in report.where("code = 'dangling-edge'").collect()} == {None}


def test_stored_bytes_are_found_only_inside_the_folder(spark):
    catalog_rows = spark.createDataFrame([("a", "x.png"), ("b", "../x.png"), ("c", "gone.png")], "id string, stored_filename string")
    found = spark.createDataFrame([("x.png", b"1"), ("../x.png", b"2")], "name string, content binary")
    assert {r.id: r.content for r in uploads.stored_bytes(catalog_rows, found).collect()} == {"a": b"1", "b": None, "c": None}
