"""From plan files to structural scenes: one floor a task, kernels inside, typed rows outside.

A floor is what a task holds at a time; floors are dealt by Spark. The scene of a floor is one
nested row, from which normalised tables and the JSON payload follow without Python.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.checkpoint import kept
from atriumq.functions import text as t
from atriumq.operators import graphs
from atriumq.raster import bitmaps as bm
from atriumq.raster import drawings, navigation, structure

_RING = "array<array<double>>"
_POLY = f"struct<outer:{_RING},holes:array<{_RING}>>"
SCENE = (
    "struct<parser:string,parser_version:string,image_size:struct<width:int,height:int>,scale:struct<pixels_per_meter:double,source:string>,"
    f"walls:array<{_POLY}>,obstacles:array<{_POLY}>,windows:array<{_POLY}>,"
    f"openings:array<struct<id:string,kind:string,polygon:{_POLY},center:array<double>,width_px:double,confidence:double,spaces:array<string>,sources:array<string>>>,"
    f"spaces:array<struct<id:string,kind:string,label:string,connector_kind:string,polygon:{_POLY},openings:array<string>,area_px:double,confidence:double>>,"
    f"walkable:array<struct<polygon:{_POLY}>>,"
    "graph:struct<nodes:array<struct<id:string,x:double,y:double,kind:string,space_id:string,opening_id:string,label:string,connector_kind:string>>,edges:array<struct<from:string,to:string,kind:string,length_px:double>>>,"
    "validation:struct<status:string,issues:array<struct<code:string,severity:string,message:string,subjects:array<string>>>,metrics:map<string,double>>,diagnostics:map<string,string>>"
)


@dataclass(frozen=True)
class Options:
    """How plans are read: a known scale, the zoom of drawings, which perceivers run. ``perceive`` takes
    (gray, ppm) and returns masks walls, door, window and probability: the place of a learned model, which
    runs if ``use_ml``; ``backend`` is what it is called."""

    pixels_per_meter: float | None = None
    raster_scale: float = 2.0
    use_classical: bool = True
    use_ml: bool = True
    perceive: object = None
    backend: str = "learned"


def _poly(p: dict) -> dict:
    pairs = lambda r: np.asarray(r, float).tolist()
    return {"outer": pairs(p["outer"]), "holes": [pairs(h) for h in p.get("holes", ())]}


def resolved(calibrated: float | None, drawn: float | None, walls: np.ndarray) -> tuple[float, str]:
    if calibrated and calibrated > 0:
        return float(calibrated), "calibrated"
    if drawn:
        return float(drawn), "vector"
    return float(np.clip(bm.stroke_thickness(walls) / 0.2, 8.0, 400.0)), "estimated"


def scene_of(page: dict | None, gray: np.ndarray | None, options: Options, ppm: float | None = None) -> dict:
    """One floor's scene, from a parsed drawing, a gray image or both."""
    took, began = [], time.perf_counter()
    ended = lambda stage: took.append((f"t_{stage}", f"{time.perf_counter() - began:.3f}"))
    drawn = drawings.draw(page) if page else None
    seen = structure.perceive_gray(gray) if gray is not None and options.use_classical else None
    scale, source = resolved(ppm or options.pixels_per_meter, drawn and drawn["vector_scale"], (drawn or seen)["walls"])
    learned = options.perceive(gray, scale) if options.perceive and options.use_ml and gray is not None else None
    masks = structure.fuse([seen] if seen else [], scale, drawn, learned)
    shape = masks["walls"].shape
    ended("perception")
    built = structure.reconstruct(masks, scale)
    doors = structure.openings(masks, built["blocked"], scale)
    ended("reconstruction")
    found, doors_kept, labels, glass = structure.spaces(built["blocked"], doors, masks["thin"], drawn["labels"] if drawn else [], scale)
    ended("inference")
    blocked = built["blocked"] | glass
    walk = structure.walkable(found, labels, scale)
    g = navigation.build(found, doors_kept, walk, blocked, scale)
    ended("graph")
    slack = max(1.0, 0.04 * scale)
    windows = [e for e in built["elements"] if e["kind"] == "window"] + bm.polygons(glass, slack)
    bridges = bm.rasterized([{"outer": o["ring"]} for o in doors_kept if o["kind"] != "entrance"], shape, max(1, int(round(0.1 * scale))))
    name = lambda k, letter: f"{letter}{k}" if k else None
    lines = []
    for s in found:
        p = max(bm.polygons(np.pad(s["crop"], 1), slack), key=lambda q: abs(bm.signed_area(q["outer"])))
        at = np.array(s["at"]) - 1
        lines.append({"id": f"s{s['id']}", "kind": s["kind"], "label": s["label"], "connector_kind": s["connector_kind"], "polygon": _poly({"outer": p["outer"] + at, "holes": [h + at for h in p["holes"]]}), "openings": [f"o{o['id']}" for o in s["doors"]], "area_px": s["area"], "confidence": s["confidence"]})
    crossing = sum(not g.sees(g.at(a), g.at(b)) for a, b in g.edges)
    return {
        "parser": "atriumq", "parser_version": "3", "image_size": {"width": shape[1], "height": shape[0]}, "scale": {"pixels_per_meter": scale, "source": source},
        "walls": [_poly(e) for e in built["elements"] if e["kind"] == "wall"], "obstacles": [_poly(e) for e in built["elements"] if e["kind"] == "obstacle"], "windows": [_poly(w) for w in windows],
        "openings": [{"id": f"o{o['id']}", "kind": o["kind"], "polygon": _poly({"outer": o["ring"]}), "center": o["center"].tolist(), "width_px": o["width"], "confidence": o["confidence"], "spaces": [name(k, "s") for k in o["spaces"]], "sources": list(o["sources"])} for o in doors_kept],
        "spaces": lines, "walkable": [{"polygon": _poly(p)} for p in bm.polygons((walk > 0) | bridges, slack)],
        "graph": {
            "nodes": [{"id": f"n{n}", "x": v["x"], "y": v["y"], "kind": v["kind"], "space_id": name(v["space"], "s"), "opening_id": name(v["opening"], "o"), "label": v["label"], "connector_kind": v["connector_kind"]} for n, v in g.nodes.items()],
            "edges": [{"from": f"n{a}", "to": f"n{b}", "kind": k, "length_px": float(np.hypot(*(np.array(g.at(a)) - g.at(b))))} for (a, b), k in g.edges.items()],
        },
        "validation": {"status": "errors" if crossing else "ok", "issues": [], "metrics": [("edges_crossing_walls", float(crossing)), ("nodes", float(len(g.nodes))), ("edges", float(len(g.edges)))]},
        "diagnostics": [(k, str(v)) for k, v in _diagnostics(options, drawn, seen, learned, source, scale, built, windows, doors_kept, found, g).items()] + took,
    }


def _diagnostics(options: Options, drawn, seen, learned, source: str, scale: float, built: dict, windows: list, kept: list, found: list, g) -> dict:
    """What was understood of a floor, by kind."""
    count = lambda rows, *kinds: sum(r["kind"] in kinds for r in rows)
    used = [name for name, on in ((options.backend, learned), ("classical", seen), ("vector", drawn)) if on]
    return {
        "backend": "+".join(used), "source_kind": "svg-vector" if drawn else "raster", "scale_source": source, "pixels_per_meter": round(scale, 3),
        "wall_polygons": count(built["elements"], "wall"), "obstacles": count(built["elements"], "obstacle"), "windows": len(windows),
        "doors": count(kept, "door", "passage"), "entrances": count(kept, "entrance"), "spaces": len(found), "circulation_spaces": count(found, "circulation"),
        "nodes": len(g.nodes), "edges": len(g.edges), "edges_dropped_crossing": g.dropped, "labels": len(drawn["labels"]) if drawn else 0,
    }


def _gray(rgb: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray of rows as Spark's image source has them, blue first; the longer side at most 4096 pixels by averaging."""
    a = np.frombuffer(rgb, np.uint8).reshape(height, width, channels)
    g = a[..., 0].astype(float) if channels < 3 else 0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]
    k = -(-max(height, width) // 4096)
    if k > 1:  # the last rows and columns are repeated to fill their block
        g = np.pad(g, ((0, -height % k), (0, -width % k)), mode="edge")
        g = g.reshape(g.shape[0] // k, k, -1, k).mean((1, 3))
    return np.rint(g).astype(np.uint8)


def analyze(plans: DataFrame, options: Options = Options()) -> DataFrame:
    """(floorplan_id, status, scene) of plans (floorplan_id, content and, if known, pixels_per_meter).

    Content may be wrapped in base64. SVG is read as a drawing; images must have been decoded (columns height,
    width, channels, pixels). Content that cannot be read gives a null scene and the reason; PDF needs a
    renderer that is not part of this engine."""
    have = [c for c in ("pixels_per_meter", "height", "width", "channels", "pixels") if c in plans.columns]
    content = t.unwrapped(F.col("content")) if "content" in plans.columns else F.lit(None).cast("binary")
    rows = plans.select("floorplan_id", *have, content.alias("content")).withColumn("svg", F.coalesce(t.is_svg(F.col("content")), F.lit(False)))
    kind, shape = rows.schema["floorplan_id"].dataType.simpleString(), _arrow_scene()

    def read(row: dict) -> tuple[str, dict | None, np.ndarray | None]:
        if row.get("pixels"):
            return "ok", None, _gray(row["pixels"], row["height"], row["width"], row["channels"])
        if not row["content"]:
            return "empty file", None, None
        return ("ok", drawings.parse(row["content"], options.raster_scale), None) if row["svg"] else ("unsupported content", None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            for row in batch.to_pylist():
                try:  # one bad file must not stop the others; its reason is a value of the table
                    status, page, gray = read(row)
                except (ValueError, ParseError) as reason:
                    status, page, gray = f"{type(reason).__name__}: {reason}"[:200], None, None
                scene = scene_of(page, gray, options, row.get("pixels_per_meter")) if page or gray is not None else None
                target = target or pa.schema([("floorplan_id", batch.schema.field("floorplan_id").type), ("status", pa.string()), ("scene", shape)])
                yield pa.RecordBatch.from_pylist([{"floorplan_id": row["floorplan_id"], "status": status, "scene": scene}], target)

    return rows.mapInArrow(run, f"floorplan_id {kind}, status string, scene {SCENE}")


#: What an issue says, by code; # stands for the number of its subjects.
MESSAGES = {
    "dangling-edge": "Edge references a missing node.",
    "edge-crosses-wall": "# edges cross a wall or obstacle.",
    "isolated-node": "# nodes have no connections.",
    "disconnected-graph": "# nodes are unreachable from the main network.",
    "no-entrance": "No entrance was detected; mark one manually so routes can start outside.",
    "room-unreachable": "# rooms cannot be reached from any entrance.",
    "space-without-access": "# spaces have no detected door; add an opening if they are reachable.",
    "opening-without-node": "# openings are not represented as transitions.",
    "collinear-waypoint": "# collinear waypoints remain (kept to avoid wall crossings).",
    "low-confidence-opening": "# openings have low confidence; verify them.",
}


def validated(scenes: DataFrame) -> DataFrame:
    """Scenes with the report on their graphs: status, issues with their subjects, metrics.

    The rules are those of atriumq.operators.graphs on the scenes' tables; that no edge passes a wall is
    counted where walls are pixels, in the kernel."""
    scenes = kept(scenes, "scenes")
    parts = tables(scenes)
    floor = F.col("floorplan_id").alias("floor")
    floors = scenes.where("scene IS NOT NULL").select(floor)
    nodes = kept(parts["nodes"].select(floor, F.col("id").alias("node"), "x", "y", "kind", "space_id", "opening_id"), "nodes")
    edges = kept(parts["edges"].select(floor, F.col("from").alias("from_node"), F.col("to").alias("to_node"), "kind"), "edges")
    spaces, openings = (parts[f"{k}s"].select(floor, F.col("id").alias(k), "kind", "confidence") for k in ("space", "opening"))
    issues = kept(graphs.report(floors, nodes, edges, None, spaces, openings), "issues")
    said = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("code"))
    subjects = F.array_sort(F.collect_list("subject"))
    found = issues.groupBy("floor", "code", "severity").agg(subjects.alias("subjects"), F.count("*").alias("n"))
    issue = F.struct("code", "severity", F.replace(said, F.lit("#"), F.col("n").cast("string")).alias("message"), "subjects")
    listed = found.groupBy("floor").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    named = graphs.metrics(floors, nodes, edges, graphs.components(nodes, edges), issues).where("name <> 'edges_crossing_walls'")
    values = named.groupBy("floor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    crossing = F.coalesce(F.element_at("scene.validation.metrics", "edges_crossing_walls"), F.lit(0.0))
    state = F.when(crossing > 0, "errors").otherwise(F.col("state"))
    report = graphs.status(floors, issues).select("floor", F.col("status").alias("state")).join(listed, "floor", "left").join(values, "floor")
    none = F.array().cast("array<struct<code:string,severity:string,message:string,subjects:array<string>>>")
    full = F.struct(state.alias("status"), F.coalesce("issues", none).alias("issues"), F.map_concat("metrics", F.create_map(F.lit("edges_crossing_walls"), crossing)).alias("metrics"))
    out = scenes.join(report.withColumnRenamed("floor", "floorplan_id"), "floorplan_id", "left")
    return out.select("floorplan_id", "status", F.when(F.col("scene").isNotNull(), F.col("scene").withField("validation", full)).alias("scene"))


def _arrow_scene() -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(SCENE))


def tables(scenes: DataFrame) -> dict[str, DataFrame]:
    """The scene's parts as tables keyed by floorplan_id: nodes, edges, spaces, openings, and polygons with their kind."""
    s = scenes.where("scene IS NOT NULL")
    part = lambda c: s.select("floorplan_id", F.inline(f"scene.{c}"))
    named = lambda c, k: F.transform(f"scene.{c}", lambda p: F.struct(F.lit(k).alias("kind"), p["outer"].alias("outer"), p["holes"].alias("holes")))
    kinds = F.explode(F.concat(named("walls", "wall"), named("obstacles", "obstacle"), named("windows", "window")))
    return {"nodes": part("graph.nodes"), "edges": part("graph.edges"), "spaces": part("spaces"), "openings": part("openings"), "polygons": s.select("floorplan_id", kinds.alias("p")).select("floorplan_id", "p.*")}
