"""Bitmap and graph operators on rows: fixtures, brute force, frames that no task could hold, and rounds forced by small limits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atriumq.bitmap import boxes, closing, fields, rings, runs, sight
from atriumq.operators import chains, graphs, greedy
from atriumq.raster import bitmaps as bm


def pixels(spark, *masks):
    rows = [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "floor int, px int, py int")


def noise(seed, h=40, w=60, share=0.45):
    return np.random.default_rng(seed).random((h, w)) < share


@pytest.mark.parametrize("tile, last", [(256, 100_000), (7, 20)])
def test_components_are_those_of_the_pixels(spark, monkeypatch, tile, last):
    monkeypatch.setattr(runs, "TILE", tile)
    monkeypatch.setattr(graphs, "LAST_EDGES", last)
    masks = [noise(1), noise(2, share=0.3)]
    got = runs.pixels_of(runs.labelled(runs.runs(pixels(spark, *masks).union(pixels(spark, *masks)))), "component").collect()
    for k, m in enumerate(masks):
        labels, n = bm.components(m)
        mine = {(r.px, r.py): r.component for r in got if r.floor == k}
        assert len(mine) == m.sum() and len({(labels[y, x], c) for (x, y), c in mine.items()}) == n == len(set(mine.values()))


def test_components_of_a_wide_frame(spark, monkeypatch):
    """A spiral of one pixel over 10,000 by 10,000 is one group; bars beside it are groups of their own."""
    monkeypatch.setattr(graphs, "LAST_EDGES", 500)
    n, gap = 10_000, 200
    turns = range(n // gap // 2 - 1)
    top = [(0, k * gap, k * gap - (gap if k else 0), n - 1 - k * gap) for k in turns]
    bottom = [(0, n - 1 - k * gap, k * gap, n - 1 - k * gap) for k in turns]
    sides = [(k * gap, n - 1 - k * gap, n - 1 - k * gap, k * gap) for k in turns]
    left = [((k + 1) * gap, n - 1 - k * gap, k * gap) for k in turns]
    level = spark.createDataFrame(top + bottom, "floor int, y long, x0 long, x1 long")
    upright = spark.createDataFrame([(0, x, a + 1, b - 1) for a, b, x, _ in sides] + [(0, x, a + 1, b - 1) for a, b, x in left], "floor int, x long, a long, b long")
    upright = upright.where("a <= b").select("floor", F.explode(F.sequence("a", "b")).alias("y"), F.col("x").alias("x0"), F.col("x").alias("x1"))
    bars = spark.range(1000).selectExpr("0 AS floor", "id * 9 + 400 AS y", "CAST(5 AS BIGINT) AS x0", "CAST(9 AS BIGINT) AS x1")
    rows = runs.labelled(level.unionByName(upright).unionByName(bars))
    sizes = {r["component"]: r["count"] for r in rows.groupBy("component").count().collect()}
    assert len(sizes) == 1001 and sorted(sizes.values())[-2] == 1
    box = runs.group_boxes(rows).orderBy(F.desc("area")).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (0, 0, n - 1, n - 1)


def test_complement_and_exterior(spark):
    m = np.zeros((30, 40), bool)
    m[5:25, 5:35] = True
    m[8:22, 8:32] = False
    m[10, 10:30] = True
    frames = spark.createDataFrame([(0, 40, 30)], "floor int, width int, height int")
    rows = runs.runs(pixels(spark, m))
    free = runs.pixels_of(runs.complement(rows, frames)).collect()
    assert {(r.px, r.py) for r in free} == {(int(x), int(y)) for y, x in zip(*np.nonzero(~m))}
    out = {(r.px, r.py) for r in runs.pixels_of(runs.exterior(rows, frames)).collect()}
    assert out == {(x, y) for y in range(30) for x in range(40) if not (5 <= y < 25 and 5 <= x < 35)}
    assert runs.runs(pixels(spark, m).limit(0)).count() == 0 and runs.complement(rows.limit(0), frames).count() == 30


def test_line_closing_seals_gaps_and_leaves_margins(spark):
    m = np.zeros((120, 200), bool)
    m[56:64, 20:90] = m[56:64, 110:180] = True
    done = closing.sealed(pixels(spark, m), closing.odd_length(40)).collect()
    got = {(r.px, r.py) for r in done}
    assert all((x, 60) in got for x in range(90, 110)) and not any(y == 60 and (x < 20 or x >= 180) for x, y in got)
    assert not any(y < 50 or y > 70 for _, y in got)


@pytest.mark.parametrize("k", [0, 6])
def test_closing_level_and_upright_is_that_of_the_element(spark, k):
    m = noise(5, share=0.12)
    got = {(r.px, r.py) for r in closing.bridged(pixels(spark, m), 9).where(F.col("angle") == k).collect()}
    want = bm.close_line(m, 9, 15 * k) & ~m
    assert got == {(int(x), int(y)) for y, x in zip(*np.nonzero(want))}


def test_rings_and_back(spark):
    hole = np.zeros((100, 100), bool)
    hole[20:80, 20:80] = True
    hole[40:60, 40:60] = False
    masks = [hole, noise(3), noise(4, share=0.55)]
    corners = rings.rings(pixels(spark, *masks))
    edges = rings.closed_edges(corners)
    got = {k: sorted(r.area for r in rings.areas(edges).where(f"floor = {k}").collect()) for k in range(3)}
    assert got == {k: sorted(map(bm.signed_area, bm.outlines(m))) for k, m in enumerate(masks)}
    assert [len(got[0]), sum(got[0])] == [2, hole.sum()]
    back = runs.pixels_of(rings.filled(rings.closed_edges(corners.withColumns({"x": F.col("x") - 0.5, "y": F.col("y") - 0.5}))))
    for k, m in enumerate(masks):
        assert {(r.px, r.py) for r in back.where(f"floor = {k}").collect()} == {(int(x), int(y)) for y, x in zip(*np.nonzero(m))}


def test_simplified_is_the_recursion(spark):
    rng = np.random.default_rng(7)
    lines = [np.cumsum(rng.integers(-3, 4, (int(n), 2)), axis=0).astype(float) for n in rng.integers(2, 40, 3000)]
    lines[0] = np.array([[0, 0], [5, 5], [0, 0]], float)
    df = spark.createDataFrame([(k % 5, k, i, float(x), float(y)) for k, p in enumerate(lines) for i, (x, y) in enumerate(p)], "floor int, ring int, ord int, x double, y double")
    got = {}
    for r in rings.simplified(df, 2.0).collect():
        got.setdefault(r.ring, []).append((r.ord, r.x, r.y))
    for k, p in enumerate(lines):
        assert [xy[1:] for xy in sorted(set(got[k]))] == [tuple(q) for q in bm.simplify(p, 2.0).tolist()], k


def _box(p):
    """Area of the least box by every pair of points as its side."""
    best = math.inf
    for a in p:
        for b in p:
            u = b - a
            if (u == 0).all():
                continue
            u = u / np.hypot(*u)
            v = np.array([-u[1], u[0]])
            if (p @ v).min() >= a @ v - 1e-9:
                best = min(best, np.ptp(p @ u) * np.ptp(p @ v))
    return best


def test_least_boxes(spark, monkeypatch):
    monkeypatch.setattr(boxes, "BLOCK", 5)
    rng = np.random.default_rng(2)
    sets = {k: rng.integers(0, 30, (n, 2)).astype(float) for k, n in enumerate([1, 2, 3, 8, 40, 90])}
    sets[9] = np.array([[0, 0], [1, 1], [2, 2]], float)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, p in sets.items() for x, y in p], "g int, x double, y double")
    got = {r.g: r for r in boxes.least_boxes(df, ["g"]).collect()}
    assert set(got) == set(sets) and got[0].long_side == got[0].short_side == 0
    for k in (2, 3, 4, 5):
        assert got[k].long_side * got[k].short_side == pytest.approx(_box(sets[k]))
        c, u = np.array([got[k].cx, got[k].cy]), np.array([got[k].ux, got[k].uy])
        v = np.array([-u[1], u[0]])
        assert (np.abs((sets[k] - c) @ u) <= got[k].long_side / 2 + 1e-9).all() and (np.abs((sets[k] - c) @ v) <= got[k].short_side / 2 + 1e-9).all()
    assert got[9].long_side == pytest.approx(2 * 2**0.5) and got[9].short_side == pytest.approx(0)


def test_distances(spark, monkeypatch):
    monkeypatch.setattr(fields, "STRIP", 16)
    m = noise(6, share=0.9)
    m[10:30, 20:55] = True
    frames = spark.createDataFrame([(0, 60, 40), (1, 5, 4)], "floor int, width int, height int")
    out = fields.distances(runs.runs(pixels(spark, m, np.ones((4, 5), bool))), frames)
    got = {(r.floor, r.px, r.py): r.distance for r in out.collect()}
    obstacles = np.argwhere(~m)
    for y, x in np.argwhere(m):
        assert got[0, x, y] == pytest.approx(np.sqrt(((obstacles - (y, x)) ** 2).sum(1).min()))
    assert all(math.isinf(got[1, x, y]) for x in range(5) for y in range(4))
    best = fields.poles(out.where("floor = 0"), ["floor"]).first()
    assert best.radius == pytest.approx(max(v for k, v in got.items() if k[0] == 0))


def _touches(a, b, p):
    """Whether a closed unit square around p meets the segment from a to b."""
    (ax, ay), (bx, by), (px, py) = a, b, p
    return min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by) and 2 * abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) <= abs(bx - ax) + abs(by - ay)


def test_cells_of_segments(spark):
    rng = random.Random(3)
    ends = [tuple(rng.randrange(-9, 10) for _ in range(4)) for _ in range(400)] + [(1, 1, 1, 1), (0, 0, 5, 5), (3, 2, 3, -6), (-4, 1, 7, 1)]
    df = spark.createDataFrame(ends, "ax int, ay int, bx int, by int").select("*", sight.cells("ax", "ay", "bx", "by").alias("c"))
    for r in df.collect():
        got = [(c.x, c.y) for c in r.c]
        a, b = (r.ax, r.ay), (r.bx, r.by)
        want = {(x, y) for x in range(-10, 11) for y in range(-10, 11) if _touches(a, b, (x, y))}
        assert set(got) == want and len(got) == len(want) <= 3 * (abs(a[0] - b[0]) + abs(a[1] - b[1])) + 1


def test_sides_of_openings(spark):
    spaces = spark.createDataFrame([(0, y, 0, 9, 1) for y in range(20)] + [(0, y, 14, 30, 2) for y in range(20)], "floor int, y long, x0 long, x1 long, space int")
    outside = spark.createDataFrame([(0, y, 36, 39) for y in range(20)], "floor int, y long, x0 long, x1 long")
    frames = spark.createDataFrame([(0, 40, 20)], "floor int, width int, height int")
    doors = [(1, 12.0, 5.0, 1.0, 0.0, 2.0), (2, 33.0, 5.0, 1.0, 0.0, 4.0), (3, 12.0, 5.0, 0.0, 1.0, 2.0), (4, 5.0, 1.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(0, *d, 10.0) for d in doors], "floor int, opening int, cx double, cy double, nx double, ny double, depth double, ppm double")
    got = {r.opening: (r.side_a, r.side_b) for r in runs.opening_sides(df, spaces, outside, frames).collect()}
    assert got == {1: (2, 1), 2: (-1, 2), 3: (0, -1), 4: (1, -1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_independent_is_the_loop(spark, seed):
    rng = random.Random(seed)
    pairs = [(f, rng.randrange(60), rng.randrange(60)) for f in (0, 1) for _ in range(120)] + [(2, k, k + 1) for k in range(40)]
    ranks = [(f, k) for f in (0, 1) for k in range(60)] + [(2, k) for k in range(41)]
    got = {}
    for r in greedy.independent(spark.createDataFrame(ranks, "floor int, rank int"), spark.createDataFrame(pairs, "floor int, a int, b int"), "rank").collect():
        got.setdefault(r.floor, set()).add(r["rank"])
    for f in (0, 1, 2):
        met, taken = {frozenset(p[1:]) for p in pairs if p[0] == f and p[1] != p[2]}, []
        for k in sorted(k for g, k in ranks if g == f):
            if not any(frozenset((k, t)) in met for t in taken):
                taken.append(k)
        assert got[f] == set(taken)


def _graph(seed, n=60, m=70):
    rng = random.Random(seed)
    edges = {tuple(sorted((k, k + 1))) for k in range(0, n - 1) if k % 17} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m // 8)}
    return [(a, b, float(rng.randrange(1, 40))) for a, b in sorted(edges)]


def _plain_chains(edges, keep=()):
    near = {}
    for k, (a, b, _) in enumerate(edges):
        near.setdefault(a, []).append(k)
        near.setdefault(b, []).append(k)
    inner = {v for v, e in near.items() if len(e) == 2 and v not in keep}
    out, seen = [], set()
    for k, (a, b, length) in enumerate(edges):
        for v in (a, b):
            if k in seen or v in inner:
                continue
            path, at, total, n = [k], (b if v == a else a), length, 0
            while at in inner:
                nxt = next(e for e in near[at] if e != path[-1])
                path.append(nxt)
                total += edges[nxt][2]
                n += 1
                at = edges[nxt][1] if edges[nxt][0] == at else edges[nxt][0]
            seen.update(path)
            out.append((min(v, at), max(v, at), total, n))
    rest = [k for k in range(len(edges)) if k not in seen]
    while rest:  # rings of nothing but inner nodes
        ring, grow = set(), [rest[0]]
        while grow:
            k = grow.pop()
            if k not in ring:
                ring.add(k)
                grow += [e for v in edges[k][:2] for e in near[v]]
        least = min(v for k in ring for v in edges[k][:2])
        out.append((least, least, sum(edges[k][2] for k in ring), len({v for k in ring for v in edges[k][:2]})))
        rest = [k for k in rest if k not in ring]
    return sorted(out)


def _rows(df):
    return sorted((r.a, r.b, r.length, r.inner) for r in df.collect())


@pytest.mark.parametrize("last", [100_000, 2])
def test_chains(spark, monkeypatch, last):
    monkeypatch.setattr(graphs, "LAST_EDGES", last)
    edges = _graph(4) + [(100, 101, 1.0), (101, 102, 2.0), (102, 100, 3.0), (7, 110, 1.0), (110, 111, 1.0), (111, 7, 1.0)]
    df = spark.createDataFrame([(0, *e) for e in edges], "floor int, a int, b int, length double")
    assert _rows(chains.chains(df)) == _plain_chains(edges)
    keep = spark.createDataFrame([(0, 5), (0, 30)], "floor int, node int")
    assert _rows(chains.chains(df, keep)) == _plain_chains(edges, {5, 30})


def test_pruned(spark):
    edges = _graph(6)
    width = {k: float(k % 13) for k in range(60)}
    df = spark.createDataFrame([(0, *e) for e in edges], "floor int, a int, b int, length double")
    got = _rows(chains.pruned(df, spark.createDataFrame([(0, k, w) for k, w in width.items()], "floor int, node int, width double"), 12.0))

    def neat(rows):
        best = {}
        for a, b, length, n in rows:
            if a != b:
                best[a, b] = min(best.get((a, b), (math.inf, 0)), (length, n))
        return sorted((a, b, *x) for (a, b), x in best.items())

    now = neat(_plain_chains(edges))
    while True:
        degree = {}
        for a, b, *_ in now:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        spurs = [r for r in now if any(degree[t] == 1 and degree[o] > 1 and r[2] < max(12.0, 1.6 * width[o]) for t, o in (r[:2], r[1::-1]))]
        if not spurs:
            break
        now = neat(_plain_chains([r[:3] for r in now if r not in spurs]))
    assert [r[:3] for r in got] == [r[:3] for r in now]


def test_merged_and_straightened(spark):
    nodes = [(0, 1, "decision", 0, 0), (0, 2, "decision", 4, 0), (0, 3, "room", 50, 0), (0, 4, "room", 50, 9), (0, 5, "room", -50, 0), (0, 6, "room", -50, 9)]
    edges = [(0, 1, 2, 4.0), (0, 1, 5, 50.0), (0, 1, 6, 51.0), (0, 2, 3, 46.0), (0, 2, 4, 47.0)]
    n = spark.createDataFrame(nodes, "floor int, node int, kind string, x int, y int")
    got, left = chains.merged(n, spark.createDataFrame(edges, "floor int, a int, b int, length double"), 5.0)
    assert {(r.node, r.x, r.y) for r in got.collect() if r.node < 3} == {(1, 2.0, 0.0)}
    assert sorted((r.a, r.b) for r in left.collect()) == [(1, 3), (1, 4), (1, 5), (1, 6)]
    line = [(0, k, "waypoint" if 0 < k < 9 else "room", 10 * k, k % 2) for k in range(10)]
    e = spark.createDataFrame([(0, k, k + 1, "doorway" if k == 4 else "corridor") for k in range(9)], "floor int, a int, b int, kind string")
    wall = spark.createDataFrame([(0, 45, 9)], "floor int, px int, py int")
    n2 = spark.createDataFrame(line, "floor int, node int, kind string, x int, y int")
    kept, out = chains.straightened(n2, e, wall)
    assert sorted(r.node for r in kept.collect()) == [0, 9] and [(r.a, r.b, r.kind) for r in out.collect()] == [(0, 9, "doorway")]
    shut = spark.createDataFrame([(0, 45, 0), (0, 45, 1), (0, 45, 2)], "floor int, px int, py int")
    kept, out = chains.straightened(n2, e, shut)
    assert sorted((r.a, r.b) for r in out.collect())[-1][1] == 9 and kept.count() == 4


def test_mutual_sight(spark):
    at = spark.createDataFrame([(0, 1, "a", 0, 0), (0, 2, "a", 10, 0), (0, 3, "a", 0, 10), (0, 4, "a", 90, 90), (0, 5, "b", 1, 1)], "floor int, point int, room string, x int, y int")
    wall = spark.createDataFrame([(0, 5, 0)], "floor int, px int, py int")
    assert sorted((r.a, r.b) for r in sight.mutual(at, wall, "room", 20.0).collect()) == [(1, 3), (2, 3)]


@pytest.mark.parametrize("rx, ry", [(0, 0), (2, 1), (0, 3)])
def test_dilated_and_eroded(spark, rx, ry):
    m = noise(8, share=0.3)
    frames = spark.createDataFrame([(0, 60, 40)], "floor int, width int, height int")
    rows = runs.runs(pixels(spark, m))
    offsets = [(y, x) for y in range(-ry, ry + 1) for x in range(-rx, rx + 1)]
    for got, want in ((runs.dilated(rows, rx, ry, frames), bm.dilate(m, offsets)), (runs.eroded(rows, rx, ry, frames), bm.erode(m, offsets))):
        assert {(r.px, r.py) for r in runs.pixels_of(got).collect()} == {(int(x), int(y)) for y, x in zip(*np.nonzero(want))}


def test_inked_boxes(spark):
    m = noise(9, share=0.5)
    rng = random.Random(2)
    cut = [(k, *sorted((rng.randrange(61), rng.randrange(61))), *sorted((rng.randrange(41), rng.randrange(41)))) for k in range(50)]
    df = spark.createDataFrame([(0, k, x0, y0, x1, y1) for k, x0, x1, y0, y1 in cut], "floor int, box int, x0 long, y0 long, x1 long, y1 long")
    got = {r.box: r.n for r in runs.inked(df, pixels(spark, m), ["box"], side=16).collect()}
    assert got == {k: int(m[y0:y1, x0:x1].sum()) for k, x0, x1, y0, y1 in cut}


def test_groups_within_a_tile_are_left_to_its_task(spark, monkeypatch):
    """No pair of runs of one tile comes to the joins, and tiles of any size give the same groups."""
    seen, contracted = [], runs.contracted_labels
    monkeypatch.setattr(runs, "contracted_labels", lambda e, keys: (seen.append(e.count()), contracted(e, keys))[1])
    rows = runs.runs(pixels(spark, noise(8, share=0.6), noise(9)))
    whole = [sorted(map(tuple, runs.labelled(rows, reach=r).collect())) for r in (0, 1)]
    assert seen == [0, 0]
    monkeypatch.setattr(runs, "TILE", 6)
    assert [sorted(map(tuple, runs.labelled(rows, reach=r).collect())) for r in (0, 1)] == whole and min(seen[2:]) > 0


def test_sealed_runs_come_as_runs(spark, monkeypatch):
    """What several directions or tiles fill is told once, as runs of scan lines."""
    p = pixels(spark, noise(10, share=0.1))
    got = closing.sealed_runs(p, 9)
    pix = [(r.px, r.py) for r in runs.pixels_of(got).collect()]
    own = {(r.px, r.py) for r in p.collect()}
    assert len(pix) == len(set(pix)) and set(pix) == own | {(r.px, r.py) for r in closing.bridged(p, 9).collect()} and got.count() < len(pix)
    monkeypatch.setattr(closing, "TILE", 8)
    assert sorted(map(tuple, closing.sealed_runs(p, 9).collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("tile", [5, 16])
def test_rings_that_leave_their_tile_are_the_same(spark, monkeypatch, tile):
    masks = [noise(3), noise(4, share=0.55), np.ones((20, 30), bool)]
    p = pixels(spark, *masks).selectExpr("floor", "px + 3 AS px", "py + 2 AS py")
    want = sorted(map(tuple, rings.sides(p).collect()))
    assert sorted(r[:-2] for r in want) == sorted(map(tuple, rings.rings(p).collect()))
    assert sorted(r[:2] + r[3:] for r in want) == sorted((f, ring, x, y, bx, by) for f, ring, x, y, bx, by in map(tuple, rings.closed_edges(rings.rings(p)).collect()))
    monkeypatch.setattr(rings, "TILE", tile)
    assert sorted(map(tuple, rings.sides(p).collect())) == want


def test_distances_send_runs_and_reach_over_strips(spark):
    draw = np.random.default_rng(2)
    mask = np.ones((40, 700), bool)
    for y, x in zip(draw.integers(0, 40, 12), draw.integers(0, 700, 12)):
        mask[y, x] = False
    free = [("a", y, int(a), int(b) - 1) for y in range(40) for a, b in zip(*(np.flatnonzero(np.diff(np.pad(mask[y].astype(int), 1)) == s) for s in (1, -1)))]
    rows = spark.createDataFrame([*free, ("b", 0, 0, 9)], "floor string, y long, x0 long, x1 long")
    out = fields.distances(rows, spark.createDataFrame([("a", 700, 40), ("b", 10, 1)], "floor string, width int, height int"))
    got = {(r.floor, r.px, r.py): r.distance for r in out.collect()}
    ys, xs = np.nonzero(~mask)
    want = {("a", int(x), int(y)): np.sqrt(((xs - x) ** 2 + (ys - y) ** 2).min()) for y, x in np.argwhere(mask)} | {("b", x, 0): np.inf for x in range(10)}
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(x0" not in plan  # pixels are made in the strips, not sent there
