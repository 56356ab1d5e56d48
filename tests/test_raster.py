"""Bitmap kernels on small masks: exact results where there is one, invariants elsewhere."""

import time

import numpy as np

from atriumq.raster import bitmaps as bm
from atriumq.raster import drawings, navigation, structure


def _rooms(door=24, wall=8, size=300):
    w = np.zeros((size, size), bool)
    w[:wall] = w[-wall:] = True
    w[:, :wall] = w[:, -wall:] = True
    m = size // 2
    w[:, m - wall // 2 : m + wall // 2] = True
    w[m - door // 2 : m + door // 2, m - wall // 2 : m + wall // 2] = False
    return w


def _masks(walls):
    none = np.zeros_like(walls)
    return {"walls": walls, "door": none, "window": none, "thin": none}


def test_line_closing_seals_a_gap_and_leaves_margins():
    w = np.zeros((120, 200), bool)
    w[60:66, 20:90] = w[60:66, 110:180] = True
    c = bm.close_lines(w, 40)
    assert c[63, 100] and not c[5, 100] and not c[63, 5]


def test_one_door_between_two_rooms():
    built = structure.reconstruct(_masks(_rooms()), 20.0)
    assert any(e["kind"] == "wall" for e in built["elements"])
    (o,) = structure.openings(_masks(_rooms()), built["blocked"], 20.0)
    assert np.abs(o["center"] - 150).max() < 6 and 20 <= o["width"] <= 30 and abs(abs(o["normal"][0]) - 1) < 0.05


def test_corners_and_corridors_are_no_doors():
    w = np.zeros((300, 300), bool)
    w[:8] = w[-8:] = True
    w[:, :8] = w[:, -8:] = True
    w[100:108, :160] = w[100:200, 152:160] = w[220:228, :120] = w[250:258, :120] = True
    assert structure.openings(_masks(w), structure.reconstruct(_masks(w), 20.0)["blocked"], 20.0) == []


def test_outlines_keep_holes_and_fill_back():
    m = np.zeros((100, 100), bool)
    m[10:90, 10:90] = True
    m[40:60, 40:60] = False
    (p,) = bm.polygons(m)
    assert len(p["holes"]) == 1 and (bm.rasterized([p], m.shape) ^ m).mean() < 0.02
    r = np.random.default_rng(0).random((60, 80)) < 0.5
    assert (bm.rasterized(bm.polygons(r, 0, 1), r.shape) == r).all()


def test_components_and_distances_against_plain_loops():
    r = np.random.default_rng(1).random((40, 50)) < 0.45
    labels, n = bm.components(r)
    seen, k = np.zeros(r.shape, int), 0
    for y, x in zip(*np.nonzero(r)):
        if not seen[y, x]:
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 50 and r[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == k and (labels == seen).all()
    zy, zx = np.nonzero(~r)
    want = np.array([[np.hypot(zy - y, zx - x).min() if r[y, x] else 0 for x in range(50)] for y in range(40)])
    assert np.abs(bm.distances(r) - want).max() < 1e-9


def test_skeleton_of_a_t_has_one_junction():
    m = np.zeros((200, 200), bool)
    m[95:105, 20:180] = True
    m[20:105, 95:105] = True
    sk = navigation.Skeleton(m)
    crossings = [p for p, q in sk.next.items() if len(q) >= 3]
    assert len(crossings) >= 1 and max(np.hypot(a[0] - b[0], a[1] - b[1]) for a in crossings for b in crossings) <= 4
    left = sk.nearest((22, 100))
    sk.prune({left, sk.nearest((178, 100))})
    assert not any(len(q) >= 3 for q in sk.next.values()) and left in sk.next


def test_simplification_is_strict_and_boxes_turn():
    line = np.array([(0, 0), (5, 1), (10, 0)], float)
    assert len(bm.simplify(line, 1.0)) == 2 and len(bm.simplify(line, 0.99)) == 3
    centre, long_, short, axis = bm.oriented_box(np.array([(0, 0), (10, 10), (9, 11), (-1, 1)]))
    assert np.allclose(centre, (4.5, 5.5)) and abs(long_ - 200**0.5) < 1e-9 and abs(short - 2**0.5) < 1e-9 and abs(abs(axis[0]) - 0.5**0.5) < 1e-9
    assert bm.boxes_overlap(bm.corners((0, 0), (1, 0), 4, 2), bm.corners((3, 0), (0, 1), 4, 4)) and not bm.boxes_overlap(bm.corners((0, 0), (1, 0), 4, 2), bm.corners((9, 0), (1, 0), 4, 2))


def test_ink_of_a_gray_plan():
    gray = np.full((300, 300), 250, np.uint8)
    gray[_rooms()] = 20
    gray[200:201, 40:100] = 30
    seen = structure.perceive_gray(gray, 20.0)
    assert (seen["walls"] ^ _rooms()).mean() < 0.02 and seen["thin"][200, 40:100].all()
    found, kept, labels, glass = structure.spaces(_rooms(), structure.openings(_masks(_rooms()), _rooms(), 20.0), np.zeros((300, 300), bool), [("Pasillo", 60, 60), ("Sala", 220, 60)], 20.0)
    assert {(s["kind"], s["label"]) for s in found} == {("circulation", "Pasillo"), ("room", "Sala")} and len(kept) == 1


def test_learned_masks_join_what_is_drawn():
    drawn = _masks(_rooms())
    extra = np.zeros_like(drawn["walls"])
    extra[150:160, 20:60] = True
    learned = {"walls": extra, "probability": np.full(extra.shape, 0.9), "door": np.zeros_like(extra), "window": np.zeros_like(extra)}
    assert structure.fuse([], 20.0, drawn, learned)["walls"][155, 40]
    learned["probability"][:] = 0.5
    assert not structure.fuse([], 20.0, drawn, learned)["walls"][155, 40]


def test_drawings():
    svg = """<svg width="100" height="80"><g stroke="#000"><path d="M10,10 l30,0 v20 h-30 z" stroke-width="6" fill="none"/></g>
      <line x1="20" y1="10" x2="30" y2="10" stroke="#fff" stroke-width="8"/><path d="M 50,40 A 10,10 0 0 1 60,50" fill="none" stroke="#777" stroke-width="1"/>
      <text x="5" y="70"> Escala
       1:100 </text></svg>"""
    page = drawings.parse(svg)
    out = drawings.draw(page)
    assert out["walls"][10, 12] and not out["walls"][10, 25] and out["thin"].any() and page["labels"][0][0] == "Escala 1:100"
    assert abs(out["vector_scale"] - 1000 / 25.4 * 72 / 100) < 1e-9
    assert len(drawings.path_points("M0,0 C0,10 10,10 10,0")[0]) == 13


def test_dilation_in_packed_rows_against_plain_shifts():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (5, 7), (40, 63), (33, 130)):
        m = rng.random((h, w)) < 0.1
        offsets = [(int(a), int(b)) for a, b in rng.integers(-45, 46, (30, 2))] + bm.line(41, 30) + bm.disc(5)
        want = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m)):
            for dy, dx in offsets:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    want[y + dy, x + dx] = True
        assert (bm.dilate(m, offsets) == want).all()


def test_long_lines_cost_little_more_than_short_ones():
    draw = np.random.default_rng(4)
    mask = draw.random((900, 1100)) < 0.02

    def took(offsets):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            bm.dilate(mask, offsets)
            best = min(best, time.perf_counter() - began)
        return best

    level = lambda n: [(0, d) for d in range(-n, n + 1)]
    assert took(level(400)) < 15 * took(level(3))  # 114 times the offsets: runs are doubled, not laid on one by one


def test_kernels_against_their_definitions():
    draw = np.random.default_rng(8)
    for k in range(60):
        h, w = draw.integers(1, 30, 2)
        mask = draw.random((h, w)) < (0.05, 0.4, 0.8)[k % 3]
        offsets = bm.line(int(draw.integers(1, 40)) | 1, float(draw.integers(180))) if k % 2 else [(int(y), int(x)) for y, x in draw.integers(-35, 35, (6, 2))]
        want = np.zeros((h, w), bool)
        for y, x in np.argwhere(mask):
            for dy, dx in offsets:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    want[y + dy, x + dx] = True
        assert np.array_equal(bm.dilate(mask, offsets), want)
        rings = bm.outlines(mask)
        assert sum(bm.signed_area(r) for r in rings) == mask.sum()
        firsts = [(r[0][1], r[0][0]) for r in rings]
        assert all(any(np.all(r[0] + 0.5 == (x, y)) for y, x in np.argwhere(mask)) for r in rings) and firsts == sorted(firsts)
    far = np.ones((3, 900), bool)
    far[1, 450] = False
    assert bm.distances(far)[1, 0] == 450 and bm.distances(far)[0, 0] == np.sqrt(450 * 450 + 1)


def test_kernels_hold_little_beside_their_image():
    """Outlines, fillings and groups look at bits, boxes and runs: no numbers for every pixel of an image."""
    import tracemalloc

    mask = np.zeros((2000, 2000), bool)
    mask[10:1990, 10:1990] = True
    mask[40:60, 40:60] = mask[500:1500, 700:701] = False
    ring = np.array([[100.0, 100.0], [140.0, 100.0], [140.0, 130.0], [100.0, 130.0]])
    for most, call in ((20e6, lambda: bm.outlines(mask)), (6e6, lambda: bm.fill([ring], mask.shape)), (20e6, lambda: bm.close_line(mask, 85, 15.0)), (6e6, lambda: bm.Labels(mask).boxes)):
        tracemalloc.start()
        call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    assert sorted(bm.signed_area(r) for r in bm.outlines(mask)) == [-1000.0, -400.0, 1980.0**2]
    assert bm.fill([ring], mask.shape).sum() == 1200 and bm.fill([ring], mask.shape)[100:130, 100:140].all()


def test_bits_and_runs_are_the_pixels():
    draw = np.random.default_rng(7)
    for h, w in ((1, 1), (7, 63), (9, 64), (30, 65), (41, 130)):
        mask = draw.random((h, w)) < 0.4
        r, p = bm.Labels(mask), bm.Packed(mask, 5)
        assert (r.at == np.flatnonzero(mask)).all() and (r.label_at(r.at) == r.of).all() and (r.image.ravel()[r.at] == r.of).all() and ((r.image > 0) == mask).all()
        assert (p.mask(p.bits) == mask).all() and (p.places(p.bits) == r.at).all() and (p.labels(p.bits).image == r.image).all()
        for k, (crop, x, y) in enumerate(bm.groups(mask), 1):
            at = np.argwhere(r.image == k)
            assert (at.min(0) == (y, x)).all() and (np.argwhere(crop) + (y, x) == at).all()
        at = np.argwhere(~mask)
        far = [min(((at - q) ** 2).sum(1)) ** 0.5 for q in np.argwhere(mask)] if len(at) else []
        assert not len(far) or np.allclose(bm.distances(mask)[mask], far)
