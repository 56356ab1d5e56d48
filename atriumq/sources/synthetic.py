"""Synthetic clinics: a corridor between two rows of rooms, labelled by construction.

The values follow from Python's random generator and the seed, in a fixed order of draws: width,
height, corridor width, number of bays, then the kind of each lower room.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# What a clinic is drawn from.
WIDTHS, HEIGHTS = (36.0, 42.0, 48.0), (22.0, 26.0, 30.0)
CORRIDOR, BAYS = (2.2, 3.2), (5, 8)
LOWER_KINDS = ("consultorio", "laboratorio", "servicio")
MARGIN, DOOR = 0.2, 0.9
PX_PER_METER = 28


def clinic(seed: int) -> dict:
    """One labelled floor in metres."""
    draw = random.Random(seed)
    width, height = draw.choice(list(WIDTHS)), draw.choice(list(HEIGHTS))
    middle, aisle, bays = height / 2, draw.uniform(*CORRIDOR), draw.randint(*BAYS)
    depth, bay = (height - aisle) / 2, width / bays
    case = {"schema_version": 1, "seed": seed, "canvas_meters": {"width": width, "height": height}, "corridor": {"center_y": middle, "width": aisle}, "rooms": [], "doors": [], "pois": []}
    nodes, edges = [{"id": "entry", "x": 1.0, "y": middle, "kind": "entrance"}], []
    spine = ["entry"]
    for k in range(bays):
        at = k * bay + bay / 2
        spine.append(f"j{k}")
        nodes.append({"id": f"j{k}", "x": at, "y": middle, "kind": "decision"})
        rows = [("top", "t", MARGIN, middle - aisle / 2, "consultorio"), ("bottom", "b", middle + aisle / 2, middle + aisle / 2, draw.choice(list(LOWER_KINDS)))]
        for row, short, y, door_y, kind in rows:
            room, node = f"room_{row}_{k}", f"d{k}{short}"
            rect = {"x": k * bay + MARGIN, "y": y, "w": bay - 2 * MARGIN, "h": depth - MARGIN}
            case["rooms"].append({"id": room, "kind": kind, "rect": rect})
            case["doors"].append({"x": at, "y": door_y, "width": DOOR, "orientation": "horizontal", "room_id": room})
            case["pois"].append({"id": f"poi_{room}", "name": f"{kind.title()} {k + 1}{short.upper()}", "room_id": room, "node_id": node, "x": at, "y": y + rect["h"] / 2})
            nodes.append({"id": node, "x": at, "y": door_y, "kind": "waypoint"})
            edges.append({"from": f"j{k}", "to": node})
    nodes.append({"id": "exit", "x": width - 1.0, "y": middle, "kind": "entrance"})
    spine.append("exit")
    edges += [{"from": a, "to": b} for a, b in zip(spine, spine[1:])]
    return case | {"navigation": {"nodes": nodes, "edges": edges}}


def drawing(case: dict, px: int = PX_PER_METER) -> str:
    """The floor as SVG: rooms as outlined boxes, doors as gaps with a swing."""
    # Colours, widths and the form of every element.
    size = [round(case["canvas_meters"][k] * px) for k in ("width", "height")]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" viewBox="0 0 {size[0]} {size[1]}">', '<rect width="100%" height="100%" fill="#fffdf8"/>']
    n = lambda v: f"{v * px:.1f}"
    for room in case["rooms"]:
        r = room["rect"]
        out.append(f'<rect x="{n(r["x"])}" y="{n(r["y"])}" width="{n(r["w"])}" height="{n(r["h"])}" fill="#faf7f0" stroke="#1f2329" stroke-width="8"/>')
        out.append(f'<text x="{n(r["x"] + r["w"] / 2)}" y="{n(r["y"] + r["h"] / 2)}" text-anchor="middle" font-family="Arial" font-size="18" fill="#333">{room["kind"].title()}</text>')
    for d in case["doors"]:
        left, right, y, w = d["x"] - d["width"] / 2, d["x"] + d["width"] / 2, d["y"], d["width"]
        out.append(f'<line x1="{n(left)}" y1="{n(y)}" x2="{n(right)}" y2="{n(y)}" stroke="#fffdf8" stroke-width="12"/>')
        out.append(f'<path d="M {n(left)},{n(y)} A {n(w)},{n(w)} 0 0 1 {n(right)},{n(y - w)}" fill="none" stroke="#777" stroke-width="2"/>')
    return "\n".join([*out, "</svg>"])


def clinics_of(seeds: DataFrame) -> DataFrame:
    """(seed, stem, json, svg), one row per row of ``seeds`` (seed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("seed").to_pylist()
            cases = [clinic(s) for s in numbers]
            yield pa.RecordBatch.from_pydict(
                {"seed": numbers, "stem": [f"clinic_{s:05d}" for s in numbers], "json": [json.dumps(c, ensure_ascii=False, indent=2) for c in cases], "svg": [drawing(c) for c in cases]}
            )

    return seeds.select("seed").mapInArrow(run, "seed long, stem string, json string, svg string")


def clinics(spark: SparkSession, first: int = 180, count: int = 20, partitions: int | None = None) -> DataFrame:
    """The cases of ``count`` seeds from ``first`` on."""
    return clinics_of(spark.range(first, first + count, numPartitions=partitions).withColumnRenamed("id", "seed"))


def write_clinics(df: DataFrame, path: str) -> None:
    """Every case as a JSON and an SVG file, in folders json/stem=... and svg/stem=... under ``path``."""
    for kind in ("json", "svg"):
        df.select("stem", kind).write.mode("overwrite").partitionBy("stem").text(f"{path.rstrip('/')}/{kind}")
