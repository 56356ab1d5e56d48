"""Structural analyses as JSON: a tolerant reader of old and new payloads, and the writer of new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atriumq.operators.checks import OPENING_KINDS, SPACE_KINDS, known_kind

_RING = "array<array<double>>"
_POLY = f"struct<outer:{_RING},holes:array<{_RING}>>"
SCHEMA = (
    "struct<parser:string,parser_version:string,image_size:struct<width:int,height:int>,scale:struct<pixels_per_meter:double,source:string>,"
    f"walls:array<{_POLY}>,obstacles:array<{_POLY}>,windows:array<{_POLY}>,doors:array<{_POLY}>,"
    f"openings:array<struct<id:string,kind:string,polygon:{_POLY},center:array<double>,width_px:double,confidence:double,spaces:array<string>,sources:array<string>>>,"
    f"spaces:array<struct<id:string,kind:string,label:string,connector_kind:string,polygon:{_POLY},openings:array<string>,area_px:double,confidence:double>>,"
    f"walkable:array<struct<polygon:{_POLY},kind:string>>,"
    "graph:struct<nodes:array<struct<id:string,x:double,y:double,kind:string,space_id:string,opening_id:string,label:string,connector_kind:string>>,edges:array<struct<from:string,to:string,kind:string,length_px:double>>>,"
    "validation:struct<status:string,issues:array<struct<code:string,severity:string,message:string,subjects:array<string>>>,metrics:map<string,double>>,diagnostics:map<string,string>>"
)


def read_analysis(df: DataFrame, json_col: str = "payload", id_col: str = "floorplan_id") -> DataFrame:
    """One row per payload with typed parts. Missing parts are empty; payloads without openings, or
    with an empty list of them, have their ``doors`` instead; areas need three points, kinds not in the list are
    unknown; a scale of 0 is none."""
    p = F.from_json(json_col, SCHEMA)
    empty = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    rows = df.select(F.col(id_col).alias("floorplan_id"), p.alias("p"))
    polys = f"array<{_POLY}>"
    door = lambda d: F.struct(
        F.lit(None).cast("string").alias("id"), F.lit("door").alias("kind"), d.alias("polygon"), F.lit(None).cast("array<double>").alias("center"), F.lit(0.0).alias("width_px"), F.lit(1.0).alias("confidence"),
        F.array(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("spaces"), F.array().cast("array<string>").alias("sources"),
    )
    known = lambda o: F.struct(
        o["id"].alias("id"), known_kind(o["kind"], OPENING_KINDS, "door").alias("kind"), o["polygon"].alias("polygon"), o["center"].alias("center"),
        F.coalesce(o["width_px"], F.lit(0.0)).alias("width_px"), F.coalesce(o["confidence"], F.lit(1.0)).alias("confidence"),
        F.array(F.get(o["spaces"], F.lit(0)), F.get(o["spaces"], F.lit(1))).alias("spaces"), F.coalesce(o["sources"], F.array().cast("array<string>")).alias("sources"),
    )
    openings = F.when(F.coalesce(F.size("p.openings") > 0, F.lit(False)), F.transform("p.openings", known)).otherwise(F.transform(empty(F.col("p.doors"), polys), door))
    solid = lambda x: F.filter(x, lambda s: F.size(s["polygon"]["outer"]) >= 3)
    return rows.select(
        "floorplan_id",
        F.coalesce("p.parser", F.lit("unknown")).alias("parser"),
        F.coalesce("p.parser_version", F.lit("1")).alias("parser_version"),
        F.col("p.image_size.width").alias("image_width"),
        F.col("p.image_size.height").alias("image_height"),
        F.when(F.col("p.scale.pixels_per_meter") != 0, F.col("p.scale.pixels_per_meter")).alias("estimated_pixels_per_meter"),
        F.col("p.scale.source").alias("scale_source"),
        *(empty(F.col(f"p.{c}"), polys).alias(c) for c in ("walls", "obstacles", "windows")),
        openings.alias("openings"),
        F.transform(solid(F.col("p.spaces")), lambda x: x.withField("kind", known_kind(x["kind"], SPACE_KINDS, "unknown"))).alias("spaces"),
        F.transform(solid(F.col("p.walkable")), lambda x: x.withField("kind", known_kind(x["kind"], SPACE_KINDS, "unknown"))).alias("walkable"),
        F.col("p.graph.nodes").alias("nodes"),
        F.col("p.graph.edges").alias("edges"),
        F.coalesce("p.validation.status", F.lit("ok")).alias("status"),
        F.col("p.validation.issues").alias("issues"),
        F.col("p.validation.metrics").alias("metrics"),
        F.col("p.diagnostics").alias("diagnostics"),
    )


def rounded_ring(ring: Column, digits: int = 2) -> Column:
    """A ring of points as pairs, rounded half to even, not closed."""
    return F.transform(ring, lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def write_payload(scenes: DataFrame) -> DataFrame:
    """(floorplan_id, payload): scenes, one struct column ``scene`` in the shape of SCHEMA, as JSON with
    coordinates rounded to 2 digits, areas to 1 and confidences to 3."""
    poly = lambda p: F.struct(F.transform(p["outer"], _pair).alias("outer"), F.transform(p["holes"], lambda r: F.transform(r, _pair)).alias("holes"))
    s = F.col("scene")
    made = F.struct(
        s["parser"].alias("parser"), s["parser_version"].alias("parser_version"), s["image_size"].alias("image_size"), s["scale"].alias("scale"),
        *(F.transform(s[c], poly).alias(c) for c in ("walls", "obstacles", "windows")),
        F.transform(s["openings"], lambda o: F.struct(o["id"].alias("id"), o["kind"].alias("kind"), poly(o["polygon"]).alias("polygon"), _pair(o["center"]).alias("center"), F.bround(o["width_px"], 2).alias("width_px"), F.bround(o["confidence"], 3).alias("confidence"), o["spaces"].alias("spaces"), o["sources"].alias("sources"))).alias("openings"),
        F.transform(F.filter(s["openings"], lambda o: o["kind"] != "entrance"), lambda o: poly(o["polygon"])).alias("doors"),
        F.transform(s["spaces"], lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["label"].alias("label"), x["connector_kind"].alias("connector_kind"), poly(x["polygon"]).alias("polygon"), x["openings"].alias("openings"), F.bround(x["area_px"], 1).alias("area_px"), F.bround(x["confidence"], 3).alias("confidence"))).alias("spaces"),
        F.transform(s["walkable"], lambda w: F.struct(poly(w["polygon"]).alias("polygon"), F.lit("walkable").alias("kind"))).alias("walkable"),
        F.struct(
            F.transform(s["graph"]["nodes"], lambda n: F.struct(n["id"].alias("id"), F.bround(n["x"], 2).alias("x"), F.bround(n["y"], 2).alias("y"), n["kind"].alias("kind"), n["space_id"].alias("space_id"), n["opening_id"].alias("opening_id"), n["label"].alias("label"), n["connector_kind"].alias("connector_kind"))).alias("nodes"),
            F.transform(s["graph"]["edges"], lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), e["kind"].alias("kind"), F.bround(e["length_px"], 2).alias("length_px"))).alias("edges"),
        ).alias("graph"),
        s["validation"].alias("validation"), s["diagnostics"].alias("diagnostics"),
    )
    return scenes.select("floorplan_id", F.to_json(made, {"ignoreNullFields": "false"}).alias("payload"))


def _pair(p: Column) -> Column:
    """A point given as an array of two numbers, rounded."""
    return F.transform(p, lambda v: F.bround(v, 2))
