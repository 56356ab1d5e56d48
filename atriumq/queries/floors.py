"""Plan and payload queries: whole floors through the kernels, and documents in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from atriumq.checkpoint import kept
from atriumq.functions import text as t
from atriumq.operators import graphs
from atriumq.plans import structural
from atriumq.sources import payload, synthetic


def _seeds(spark, d):
    """A synthetic floor for every five hundred suppliers of a nation."""
    site = F.floor(F.col("s_suppkey") / 500) * 25 + F.col("s_nationkey") + 180
    return spark.read.parquet(f"{d}/supplier.parquet").select(site.cast("long").alias("seed")).distinct()


def _clinics(spark, d):
    # A floor takes seconds, so floors are dealt one by one over the tasks.
    return synthetic.clinics_of(_seeds(spark, d).repartitionByRange(480, "seed"))


def clinics(spark, d):
    """Rooms, doors and nodes of every synthetic floor."""
    case = F.from_json("json", "rooms array<struct<id:string>>, doors array<struct<room_id:string>>, navigation struct<nodes:array<struct<id:string>>,edges:array<struct<from:string>>>")
    return _clinics(spark, d).select("seed", case.alias("c"), "svg").select("seed", F.size("c.rooms").alias("rooms"), F.size("c.doors").alias("doors"), F.size("c.navigation.nodes").alias("nodes"), F.size("c.navigation.edges").alias("edges"), F.length("svg").alias("svg_chars"))


def _scenes(spark, d):
    plans = _clinics(spark, d).select(F.col("seed").alias("floorplan_id"), F.col("svg").cast("binary").alias("content"), F.lit(float(synthetic.PX_PER_METER)).alias("pixels_per_meter"))
    return structural.analyze(plans, structural.Options(raster_scale=1.0))


def scene_counts(spark, d):
    """What the pipeline understands of every floor, by kind."""
    s = structural.validated(_scenes(spark, d))
    kind = lambda c, k: F.size(F.filter(f"scene.{c}", lambda x: x["kind"] == k))
    return s.select(
        "floorplan_id", "status", kind("spaces", "room").alias("rooms"), kind("spaces", "circulation").alias("circulation"), kind("openings", "door").alias("doors"), kind("openings", "entrance").alias("entrances"),
        F.size("scene.graph.nodes").alias("nodes"), F.size("scene.graph.edges").alias("edges"), F.element_at("scene.validation.metrics", "edges_crossing_walls").alias("crossing"), F.col("scene.validation.status").alias("verdict"),
        F.array_join(F.transform("scene.validation.issues", lambda i: i["code"]), ",").alias("codes"), F.element_at("scene.diagnostics", "wall_polygons").cast("int").alias("wall_polygons"),
    )


def scene_payloads(spark, d):
    """Scenes written as JSON and read again: parts of every floor."""
    out = payload.read_analysis(payload.write_payload(_scenes(spark, d)))
    return out.select("floorplan_id", F.size("walls").alias("walls"), F.size("openings").alias("openings"), F.size("spaces").alias("spaces"), F.size("nodes").alias("nodes"), "status", "scale_source")


def scene_components(spark, d):
    """Components of every floor's graph, by the graph operators on the scene's tables."""
    t_ = structural.tables(kept(_scenes(spark, d), "scenes"))  # both tables are read several times
    nodes = t_["nodes"].select(F.col("floorplan_id").alias("floor"), F.col("id").alias("node"))
    edges = t_["edges"].select(F.col("floorplan_id").alias("floor"), F.col("from").alias("from_node"), F.col("to").alias("to_node"))
    return graphs.components(nodes, edges).groupBy("floor").agg(F.countDistinct("component").alias("components"))


def read_payloads(spark, d):
    """Old and new payloads made from parts, through the tolerant reader."""
    k = F.col("p_partkey")
    door = '{"outer":[[0,0],[4,0],[4,1]],"holes":[]}'
    new = F.concat(F.lit('"openings":['), F.concat_ws(",", F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.concat(F.lit('{"id":"o'), i.cast("string"), F.lit('","kind":"'), F.when(k % 5 == 0, "entrance").when(k % 5 == 1, "gate").otherwise("door"), F.lit(f'","polygon":{door},"width_px":'), (i * 10).cast("string"), F.lit(',"spaces":["s1"]}')))), F.lit("],"))
    shape = F.when(k % 4 == 0, F.concat(F.lit(f'"doors":[{door},{door}],'))).when(k % 4 == 1, F.lit(f'"openings":[],"doors":[{door}],')).otherwise(new)
    text = F.concat(F.lit('{"image_size":{"width":'), (k % 900 + 100).cast("string"), F.lit(',"height":50},'), shape, F.lit('"scale":{"pixels_per_meter":'), (k % 7).cast("string"), F.lit(',"source":"estimated"},"spaces":[{"id":"s1","polygon":{"outer":[[0,0],[1,1]],"holes":[]}},{"id":"s2","polygon":'), F.lit(door), F.lit('}],"validation":{"status":"warnings"}}'))
    df = spark.read.parquet(f"{d}/part.parquet").select(k.alias("floorplan_id"), text.alias("payload"))
    out = payload.read_analysis(df)
    return out.select("floorplan_id", "image_width", F.size("openings").alias("n_openings"), F.get("openings", F.lit(0))["kind"].alias("kind"), F.element_at("openings", -1)["width_px"].alias("width"), F.element_at(F.get("openings", F.lit(0))["spaces"], 1).alias("side"), F.size("spaces").alias("n_spaces"), "estimated_pixels_per_meter", "status")


def media_types(spark, d):
    """Media types of files told by their first bytes."""
    k = F.col("p_partkey")
    heads = [b"\x89PNG\r\n\x1a\nx", b"\xff\xd8\xff\xe0", b"GIF89a..", b"%PDF-1.7", b"  <svg a>", b"<?xml v?><svg>", b"plain", b"<?xml v?><html>"]
    content = F.element_at(F.array(*[F.lit(h) for h in heads]), (k % len(heads) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", t.media_type(content).alias("media_type"), t.is_svg(content).alias("svg"))


QUERIES = {
    "S22_clinics": clinics,
    "V08_scene_counts": scene_counts,
    "S19_scene_payloads": scene_payloads,
    "G16_scene_components": scene_components,
    "S18_read_payloads": read_payloads,
    "S03_media_types": media_types,
}

ORACLES = {
    "S18_read_payloads": """SELECT p_partkey AS floorplan_id, (p_partkey % 900 + 100)::INT AS image_width, CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 1 ELSE p_partkey % 3 + 1 END::INT AS n_openings,
CASE WHEN p_partkey % 4 > 1 AND p_partkey % 5 = 0 THEN 'entrance' ELSE 'door' END AS kind, CASE WHEN p_partkey % 4 > 1 THEN (p_partkey % 3 + 1) * 10 ELSE 0 END::DOUBLE AS width, CASE WHEN p_partkey % 4 > 1 THEN 's1' END AS side,
1::INT AS n_spaces, nullif(p_partkey % 7, 0)::DOUBLE AS estimated_pixels_per_meter, 'warnings' AS status FROM part""",
    "S03_media_types": "SELECT p_partkey, ['image/png','image/jpeg','image/gif','application/pdf','image/svg+xml','image/svg+xml','application/octet-stream','application/octet-stream'][p_partkey % 8 + 1] AS media_type, p_partkey % 8 IN (4, 5) AS svg FROM part",
}
