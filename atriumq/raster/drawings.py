"""Vector drawings: SVG to a wall mask, thin strokes and labels, drawn in the order of the file."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np

from . import bitmaps as bm

# Dark and light ink, the least width of a wall stroke, the largest share of a page that a filled wall covers.
DARK, LIGHT, WALL_STROKE, FILL_SHARE = 0.55, 0.85, 2.0, 0.25
_SCALE = re.compile(r"(?:escala|scale)\s*[:=]?\s*1\s*[:/]\s*(\d{2,4})", re.I)
_NAMES = {"black": "#000000", "white": "#ffffff", "gray": "#808080", "grey": "#808080"}


def ink(colour: str | None) -> float | None:
    """Luminance of a colour, null for none."""
    c = _NAMES.get((colour or "none").strip().lower(), (colour or "none").strip().lower())
    if re.fullmatch(r"#[0-9a-f]{3}", c):
        c = "#" + "".join(x * 2 for x in c[1:])
    if not re.fullmatch(r"#[0-9a-f]{6}", c):
        return None
    r, g, b = (int(c[k : k + 2], 16) / 255 for k in (1, 3, 5))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def _number(text: str | None, of: float = 0.0) -> float:
    m = re.match(r"\s*(-?[\d.]+)\s*(%?)", text or "")
    return 0.0 if not m else float(m[1]) * (of / 100 if m[2] else 1)


def _arc(p, rx, ry, turn, large, sweep, q, n: int = 16) -> list[tuple[float, float]]:
    """Points of an elliptical arc, from its ends to its centre as the SVG standard has it."""
    if rx == 0 or ry == 0 or p == q:
        return [q]
    a = np.deg2rad(turn)
    c, s = np.cos(a), np.sin(a)
    x, y = np.array([[c, s], [-s, c]]) @ ((np.array(p) - q) / 2)
    grow = max(1.0, np.sqrt((x / rx) ** 2 + (y / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    root = max(0.0, (rx * ry) ** 2 - (rx * y) ** 2 - (ry * x) ** 2) / ((rx * y) ** 2 + (ry * x) ** 2)
    k = (1 if large != sweep else -1) * np.sqrt(root)
    cx, cy = k * rx * y / ry, -k * ry * x / rx
    t0, t1 = np.arctan2((y - cy) / ry, (x - cx) / rx), np.arctan2((-y - cy) / ry, (-x - cx) / rx)
    if sweep and t1 < t0:
        t1 += 2 * np.pi
    if not sweep and t1 > t0:
        t1 -= 2 * np.pi
    t = np.linspace(t0, t1, n + 1)[1:]
    mid = (np.array(p) + q) / 2
    return [(c * rx * np.cos(u) - s * ry * np.sin(u) + c * cx - s * cy + mid[0], s * rx * np.cos(u) + c * ry * np.sin(u) + s * cx + c * cy + mid[1]) for u in t]


def path_points(d: str) -> list[list[tuple[float, float]]]:
    """Polylines of a path: moves, lines, cubic curves in thirteen points, arcs; absolute and relative."""
    out: list[list[tuple[float, float]]] = []
    at = (0.0, 0.0)
    for letter, body in re.findall(r"([MmLlHhVvCcAaZz])([^MmLlHhVvCcAaZz]*)", d or ""):
        v = [float(x) for x in re.findall(r"-?\d*\.?\d+(?:e-?\d+)?", body)]
        base = at if letter.islower() else (0.0, 0.0)
        rel = lambda x, y: (base[0] + x, base[1] + y)
        kind = letter.upper()
        if kind == "M":
            for k in range(0, len(v) - 1, 2):
                at = rel(v[k], v[k + 1])
                out.append([at]) if k == 0 else out[-1].append(at)
                base = at if letter.islower() else (0.0, 0.0)
        elif kind == "Z" and out:
            out[-1].append(out[-1][0])
            at = out[-1][0]
        elif out:
            width = {"L": 2, "H": 1, "V": 1, "C": 6, "A": 7}[kind]
            for k in range(0, len(v) - width + 1, width):
                base = at if letter.islower() else (0.0, 0.0)
                w = v[k : k + width]
                if kind == "L":
                    new = [rel(*w)]
                elif kind == "H":
                    new = [(base[0] + w[0], at[1])]
                elif kind == "V":
                    new = [(at[0], base[1] + w[0])]
                elif kind == "C":
                    p, t = np.array([at, rel(*w[:2]), rel(*w[2:4]), rel(*w[4:])]), np.linspace(0, 1, 13)[1:, None]
                    new = [tuple(q) for q in (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3]]
                else:
                    new = _arc(at, w[0], w[1], w[2], w[3] != 0, w[4] != 0, rel(w[5], w[6]))
                out[-1] += new
                at = new[-1]
    return out


def parse(svg: bytes | str, zoom: float = 1.0) -> dict:
    """{width, height, items, labels} of a drawing; items keep their order: points, stroke and fill ink, width."""
    root = ET.fromstring(svg)
    box = [float(x) for x in re.findall(r"-?[\d.]+", root.get("viewBox") or "")]
    w, h = _number(root.get("width"), box[2] if len(box) == 4 else 0), _number(root.get("height"), box[3] if len(box) == 4 else 0)
    if len(box) == 4 and (not w or not h):
        w, h = box[2], box[3]
    items, labels = [], []

    def walk(node, style: dict) -> None:
        tag = node.tag.rsplit("}", 1)[-1]
        own = dict(x.split(":", 1) for x in (node.get("style") or "").split(";") if ":" in x)
        style = style | {k: own.get(k, node.get(k)) for k in ("stroke", "fill", "stroke-width") if own.get(k, node.get(k)) is not None}
        lines: list[list[tuple[float, float]]] = []
        g = lambda k, of=0.0: _number(node.get(k), of)
        if tag == "rect":
            x, y, rw, rh = g("x", w), g("y", h), g("width", w), g("height", h)
            lines = [[(x, y), (x + rw, y), (x + rw, y + rh), (x, y + rh), (x, y)]]
        elif tag == "line":
            lines = [[(g("x1"), g("y1")), (g("x2"), g("y2"))]]
        elif tag in ("polyline", "polygon"):
            v = [float(x) for x in re.findall(r"-?[\d.]+", node.get("points") or "")]
            pts = list(zip(v[::2], v[1::2]))
            lines = [pts + pts[:1] if tag == "polygon" and pts else pts] if pts else []
        elif tag == "path":
            lines = path_points(node.get("d"))
        elif tag == "text":
            text = " ".join("".join(node.itertext()).split())
            if text:
                labels.append((text, g("x") * zoom, g("y") * zoom))
        for pts in lines:
            if len(pts) > 1:
                fill = None if tag == "line" else style.get("fill", "#000000" if tag != "polyline" else None)
                items.append({"points": np.array(pts) * zoom, "stroke": ink(style.get("stroke")), "fill": ink(fill), "width": _number(style.get("stroke-width") or "1") if ink(style.get("stroke")) is not None else 0.0})
        for child in node:
            walk(child, style)

    walk(root, {})
    return {"width": int(round(w * zoom)), "height": int(round(h * zoom)), "items": items, "labels": labels, "zoom": zoom}


def wall_width(items: list[dict], share: float = 0.9) -> float:
    """Half the width that ``share`` of the dark stroke length does not exceed, at least WALL_STROKE."""
    found = sorted((i["width"], float(np.hypot(*np.diff(i["points"], axis=0).T).sum())) for i in items if i["stroke"] is not None and i["stroke"] < DARK and i["width"] > 0)
    run, total = 0.0, sum(x for _, x in found)
    for width, length in found:
        run += length
        if run >= share * total:
            return max(WALL_STROKE, width * 0.5)
    return WALL_STROKE


def draw(page: dict) -> dict:
    """{walls, thin, labels, vector_scale}: dark wide strokes and dark fills wall, light wide strokes clear what is below them."""
    shape, zoom = (page["height"], page["width"]), page["zoom"]
    walls, thin = np.zeros(shape, bool), np.zeros(shape, bool)
    least = wall_width(page["items"])
    for item in page["items"]:
        p, s, f, w = item["points"], item["stroke"], item["fill"], item["width"]
        area = float(np.ptp(p[:, 0]) * np.ptp(p[:, 1]))
        if f is not None and f < DARK and len(p) >= 3 and area < FILL_SHARE * shape[0] * shape[1]:
            walls |= bm.fill([p], shape)
        if s is None:
            continue
        if s < DARK and w >= WALL_STROKE and w >= least:
            bm.stroke(walls, p, w * zoom)
        elif s > LIGHT and w >= 0.5 * least:
            bm.stroke(walls, p, w * zoom, False)
        elif s < DARK:
            bm.stroke(thin, p, max(1.0, w * zoom))
    scale = next((1000 / 25.4 * 72 / int(m[1]) * zoom for m in (_SCALE.search(t) for t, _, _ in page["labels"]) if m), None)
    return {"walls": walls, "thin": thin & ~bm.box_dilate(walls, 1), "labels": page["labels"], "vector_scale": scale}
