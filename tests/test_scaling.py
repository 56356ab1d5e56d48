"""Work that has to grow with its input: joins that meet by equality, searches that see what lies nearby."""

import math
import random

import pytest

from atriumq import checkpoint
from atriumq.bitmap import closing, rings, runs
from atriumq.fixtures import view
from atriumq.operators import chains, inference, proposals
from atriumq.queries import bitmaps

SF = "/root/testdata/sf0.001"


def _nearest(points, nodes, most, radius=None):
    out = set()
    for floor, key, px, py in points:
        if px is None:
            continue
        near = sorted((math.sqrt((x - px) * (x - px) + (y - py) * (y - py)), o, n) for f, n, o, x, y in nodes if f == floor and x is not None)
        near = [t for t in near if radius is None or t[0] < radius][:most]
        out |= {(floor, key, i + 1, n, round(d, 6)) for i, (d, _, n) in enumerate(near)}
    return out


def test_edges_meet_their_nodes_by_place(spark):
    plan = view(spark, SF, "fx_edge")._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan.upper()


def test_nearest_nodes_of_crowds_and_empty_quarters(spark):
    draw = random.Random(3)
    places = [(draw.gauss(500, 3), draw.gauss(-40, 3)) for _ in range(150)] + [(draw.uniform(-5000, 5000), draw.uniform(-5000, 5000)) for _ in range(20)] + [(7.0, 7.0)] * 30
    nodes = [(0, 1000 - i, i, x, y) for i, (x, y) in enumerate(places)] + [(1, 1, 1, 10.0, 10.0), (0, 5000, 5000, None, 1.0)]
    points = [(0, i, draw.gauss(500, 6), draw.gauss(-40, 6)) for i in range(40)] + [(0, 100 + i, draw.uniform(-9000, 9000), draw.uniform(-9000, 9000)) for i in range(20)]
    points += [(0, 200, 7.0, 7.0), (0, 201, 7.0, 7.0), (1, 300, -900.5, 4000.25), (2, 400, 1.0, 1.0), (0, 500, None, 1.0)]
    n = spark.createDataFrame(nodes, "floor int, node int, ord int, x double, y double")
    p = spark.createDataFrame(points, "floor int, poi int, x double, y double")
    written = len(checkpoint._WRITTEN)
    for most, radius in ((1, None), (1, 60.0), (20, None), (300, None), (5, 2.5)):
        got = {(r.floor, r.poi, r.place, r.node, round(r.distance, 6)) for r in proposals.candidates(p, n, "poi", most, radius).collect()}
        assert got == _nearest(points, nodes, most, radius), (most, radius)
    assert len(checkpoint._WRITTEN) == written  # no tables on the way, whatever is read of a proposal
    lost = n.union(spark.createDataFrame([(0, 9, 9, float("nan"), 3.0)], n.schema))
    assert {(r.floor, r.poi, r.node) for r in proposals.nearest_node(p, lost, "poi").collect()} == {t[:2] + t[3:4] for t in _nearest(points, nodes, 1)}


def test_gaps_over_the_borders_of_tiles_are_closed_once(spark):
    draw = random.Random(5)
    dots = {(x0 + draw.randrange(-20, 20), y0 + draw.randrange(-20, 20)) for x0 in (-256, 0, 256) for y0 in (0, 256) for _ in range(60)}
    pixels = spark.createDataFrame([("a", x, y) for x, y in dots] * 2 + [("b", 250, 0), ("b", 260, 0), ("c", 0, 0), ("c", 40, 0), (None, 1, 1)], "floor string, px int, py int")
    out = closing.bridged(pixels, 15)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("angle" in line for line in plan.splitlines() if "Exchange" in line)  # a pixel is not sent once for every direction
    want = {("b", 0, x, 0) for x in range(251, 260)}
    for k, (flat, step, _, _) in enumerate(closing.slopes()):
        lines = {}
        for x, y in dots:
            t, o = (x, y) if flat else (y, x)
            lines.setdefault(o - math.floor(t * step + 0.5), []).append(t)
        for line, places in lines.items():
            places.sort()
            for t, to in zip(places, places[1:]):
                if 1 <= to - t - 1 <= closing.longest_gap(15, k):
                    want |= {("a", k, *((u, o) if flat else (o, u))) for u in range(t + 1, to) for o in [line + math.floor(u * step + 0.5)]}
    got = [(r.floor, r.angle, r.px, r.py) for r in out.collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] == "a" or g[1] == 0} == {w for w in want}
    assert not [g for g in got if g[0] == "c"]


def test_labels_and_rings_never_meet_as_rows(spark, monkeypatch):
    monkeypatch.setattr(inference, "MOST_LABELS", 7)
    draw = random.Random(11)
    points = [(0, i, draw.uniform(-200, 300), draw.uniform(-200, 300)) for i in range(120)] + [(1, 5, 10.0, 10.0), (0, 500, None, 1.0), (None, 501, 10.0, 10.0), (0, 7, 40.0, 40.0)]
    rings = [(0, i % 20, 100 - i, [(draw.uniform(-250, 350), draw.uniform(-250, 350)) for _ in range(3 + i % 3)]) for i in range(60)] + [(1, 3, 1, [(0.0, 0.0), (20.0, 0.0), (0.0, 40.0)]), (None, 1, 1, [(0.0, 0.0), (20.0, 0.0), (0.0, 40.0)]), (2, 1, 1, [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)])]

    def holds(ring, x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    labels = spark.createDataFrame([(*p, f"t{p[1]}") for p in points], "floor int, label_no int, x double, y double, text string")
    spaces = spark.createDataFrame(rings, "floor int, ord int, space int, ring array<struct<x:double,y:double>>")
    out = inference.first_containing(labels, spaces)
    want = {}
    for floor, no, x, y in points:
        held = [(o, s) for f, o, s, ring in rings if floor is not None and f == floor and x is not None and holds(ring, x, y)]
        if held:
            want[floor, no] = min([*held, *([want[floor, no]] if (floor, no) in want else [])])
    assert {(r.floor, r.label_no, r.space) for r in out.collect()} == {(*k, s) for k, (_, s) in want.items()} and len(want) > 60
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "zip_with" not in plan


def test_rounds_of_merging_send_no_tables_through_the_driver(spark):
    nodes = spark.createDataFrame([(0, i, float(i % 6 * 10 + i // 6 % 2), float(i // 6 * 10)) for i in range(36)], "floor int, node int, x double, y double")
    edges = spark.createDataFrame([(0, i, j, 1.0) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j == i + 6 or j % 6)], "floor int, a int, b int, length double")
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint.kept(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chains, "kept", seen)
        n, e = chains.merged(nodes, edges, 10.5)
        assert 1 < n.count() < 36 and e.count() > 0
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)


def test_pixels_move_as_words_and_fill_back(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint.kept(df, name)

    monkeypatch.setattr(rings, "kept", seen)
    out = bitmaps.refilled(spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    moved = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("px" in line or "x0" in line for line in moved)  # no pixel or crossing is a row of a shuffle

    draw = random.Random(17)
    at = [x + d for x in (-512, -256, 0, 64, 256, 512) for d in (-2, -1, 0, 1)]
    dots = {("a", draw.choice(at), draw.choice(at)) for _ in range(400)} | {("a", x, 90) for x in range(-300, 600)} | {("b", 63, -1), ("b", 64, 0), ("b", 255, 255), ("b", 256, 256)}
    pixels = spark.createDataFrame([*dots, *list(dots)[:50], ("a", None, 3), (None, 3, 3)], "floor string, px int, py int")
    edges = rings.sides(pixels)
    for c in ("x", "y", "bx", "by"):
        edges = edges.withColumn(c, edges[c] - 0.5)
    back = runs.pixels_of(rings.filled(edges))
    got = [(r.floor, r.px, r.py) for r in back.collect()]
    assert len(got) == len(set(got)) and set(got) == dots
    bits = {(r.floor, r.word * 64 + i, r.y) for r in runs.words_of(rings.filled(edges)).collect() for i in range(64) if r.bits >> i & 1}
    assert bits == dots
