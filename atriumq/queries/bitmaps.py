"""Bitmap operators on rows, over all pixels of every floor, with DuckDB twins that do the same pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from atriumq.bitmap import boxes, closing, fields, rings, runs, sight
from atriumq.checkpoint import kept
from atriumq.fixtures import duck, view
from atriumq.operators import chains, greedy

#: The frame that the strokes of fx_ink lie in.
WIDTH, HEIGHT = 200, 150
#: Length of the line that closes, in pixels; what sight reaches, in pixels.
LENGTH, FAR = 15, 40


def _ink(spark, d):
    return view(spark, d, "fx_ink")


def _drawn(spark, d):
    """Ink as it is drawn: pixels may repeat, which operators count once."""
    return view(spark, d, "fx_ink", repeats=True)


def _frames(spark, d):
    return kept(_ink(spark, d).select("floor").distinct(), "frames").withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def ink_runs(spark, d):
    """Runs of ink of every scan line."""
    return runs.runs(_ink(spark, d))


def ink_groups(spark, d):
    """Groups of ink by their first pixel: size, box and centre."""
    x, y = runs.first_pixel()
    out = runs.group_boxes(runs.labelled(runs.runs(_ink(spark, d)))).withColumns({"fx": x, "fy": y})
    return out.select("floor", "fx", "fy", "area", "x0", "y0", "x1", "y1", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def bridged_gaps(spark, d):
    """Free pixels that closing along each of twelve directions fills."""
    out = closing.bridged(_ink(spark, d), LENGTH)
    return out.groupBy("floor", "angle").agg(F.count("*").alias("n"), F.sum("px").alias("sx"), F.sum("py").alias("sy"))


def exterior_pixels(spark, d):
    """Free pixels that reach the frame once gaps are sealed."""
    shut = closing.sealed_runs(_ink(spark, d), LENGTH).where(f"y >= 0 AND y < {HEIGHT}")
    shut = shut.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("x1", F.least("x1", F.lit(WIDTH - 1))).where("x0 <= x1")
    out = runs.pixels_of(runs.exterior(shut, _frames(spark, d)))
    return out.groupBy("floor").agg(F.count("*").alias("n"), F.sum("px").alias("sx"), F.sum("py").alias("sy"))


def outlines(spark, d):
    """Rings of every floor: outer ones and holes, their area and length."""
    a = rings.areas(rings.sides(_drawn(spark, d)))
    hole = F.col("area") < 0
    return a.groupBy("floor").agg(F.count_if(~hole).alias("outer_rings"), F.count_if(hole).alias("holes"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


def refilled(spark, d):
    """Rings filled again against the pixels that they came from."""
    edges = rings.sides(_drawn(spark, d)).withColumns({c: F.col(c) - 0.5 for c in ("x", "y", "bx", "by")})
    back = runs.words_of(rings.filled(edges, width=WIDTH, height=HEIGHT)).withColumnRenamed("bits", "b")
    both = runs.words(_drawn(spark, d)).withColumnRenamed("bits", "a").join(back, ["floor", "y", "word"], "full")
    none, pixels = F.lit(0).cast("long"), lambda c: F.sum(F.bit_count(c)).cast("long")
    both = both.select("floor", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.groupBy("floor").agg(pixels(F.col("a")).alias("drawn"), pixels(F.col("b")).alias("filled"), pixels(F.col("a").bitwiseXOR(F.col("b"))).alias("different"))


def gate_sides(spark, d):
    """What lies on both sides of every gate: a group of ink as a space, the strip along the left edge as outside."""
    ink = runs.labelled(runs.runs(_ink(spark, d)).where("x1 >= 8").withColumn("x0", F.greatest("x0", F.lit(8))))
    strip = runs.runs(_ink(spark, d).where("px < 8"))
    gates = view(spark, d, "fx_gate").withColumn("ppm", F.lit(10.0))
    return runs.opening_sides(gates, ink.withColumn("space", F.col("component")), strip, _frames(spark, d)).select("floor", "opening", *(F.when(F.col(c) > 0, F.shiftright(c, 32) * WIDTH + F.col(c) - F.shiftleft(F.shiftright(c, 32), 32)).otherwise(F.col(c)).alias(c) for c in ("side_a", "side_b")))


def sight_lines(spark, d):
    """Gates of a floor that see each other past the ink, touching included."""
    at = view(spark, d, "fx_gate").select("floor", F.col("opening").alias("point"), F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("opening") % 2).alias("room"))
    return sight.mutual(at, _ink(spark, d), "room", FAR).select("floor", "room", "a", "b")


def standing_gates(spark, d):
    """Gates that stay when they are taken by depth and number, and none near one that was taken."""
    g = view(spark, d, "fx_gate").withColumn("rank", F.col("depth").cast("long") * 1_000_000_000 + F.col("opening"))
    cell = lambda c: F.floor(F.col(c) / 30)
    a = g.select("floor", F.col("rank").alias("a"), "cx", "cy", cell("cx").alias("i"), cell("cy").alias("j"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = a.select("floor", F.col("a").alias("b"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), "i", "j", F.explode(around).alias("o")).select("floor", "b", "ox", "oy", (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j"))
    near = a.join(b, ["floor", "i", "j"]).where((F.col("a") < F.col("b")) & ((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2 <= 900)).select("floor", "a", "b")
    return greedy.independent(g, near, "rank").select("floor", "opening")


def _free(spark, d):
    return runs.complement(runs.runs(_ink(spark, d)), _frames(spark, d))


def free_distances(spark, d):
    """How far free pixels lie from the ink."""
    out = fields.distances(_free(spark, d), _frames(spark, d))
    return out.groupBy("floor").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 3).alias("total"), F.round(F.max("distance"), 6).alias("most"))


def space_poles(spark, d):
    """The middle of the free pixels of every floor and quarter of it, and how wide they are there."""
    at = fields.distances(_free(spark, d), _frames(spark, d)).withColumn("quarter", (F.floor(F.col("px") / 100) + 2 * F.floor(F.col("py") / 75)).cast("int"))
    return fields.poles(at, ("floor", "quarter")).select("floor", "quarter", "px", "py", F.round("radius", 6).alias("radius"))


def ink_boxes(spark, d):
    """The least box around every group of ink of at least five pixels, by the group's first pixel."""
    groups = runs.labelled(runs.runs(_ink(spark, d)))
    large = runs.group_boxes(groups).where("area >= 5").select("floor", "component")
    ends = groups.join(large, ["floor", "component"], "left_semi").select("floor", "component", "y", F.explode(F.array("x0", "x1")).alias("x"))
    x, y = runs.first_pixel()
    out = boxes.least_boxes(ends, ("floor", "component"))
    return out.select("floor", x.alias("fx"), y.alias("fy"), F.round(F.col("long_side") * F.col("short_side"), 6).alias("area"))


def node_lines(spark, d):
    """Polylines through the nodes of every floor, a hundred each, without points near their chords."""
    p = view(spark, d, "fx_node").select("floor", F.floor(F.col("ord") / 100).alias("line"), "ord", "x", "y")
    return rings.simplified(p, 200.0, line="line").select("floor", "line", "ord")


def _sparse(spark, d):
    """Edges along each floor, and every eleventh of those across."""
    e = view(spark, d, "fx_edge").where("kind = 'corridor' OR from_node % 11 = 0")
    n = view(spark, d, "fx_node")
    a, b = (n.select("floor", F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in ("a", "b"))
    e = e.select("floor", F.col("from_node").alias("a"), F.col("to_node").alias("b"), "kind").join(a, ["floor", "a"]).join(b, ["floor", "b"])
    return e.select("floor", "a", "b", "kind", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("length"))


def graph_chains(spark, d):
    """Graphs of floors without nodes of degree two."""
    return chains.chains(_sparse(spark, d)).select("floor", "a", "b", F.round("length", 4).alias("length"), "inner")


def pruned_graphs(spark, d):
    """Graphs of floors without short chains to a free end."""
    width = view(spark, d, "fx_node").select("floor", "node", (F.col("node") % 400).cast("double").alias("width"))
    return chains.pruned(_sparse(spark, d), width, 300.0).select("floor", "a", "b", F.round("length", 4).alias("length"))


def merged_graphs(spark, d):
    """Nodes of floors once junctions near each other are one."""
    n, _ = chains.merged(view(spark, d, "fx_node"), view(spark, d, "fx_edge").select("floor", F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.lit(1.0).alias("length")), 150.0)
    return n.select("floor", "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def straight_graphs(spark, d):
    """Edges of floors once waypoints on straight lines in sight are left out; walls are the cells that they touch."""
    walls = view(spark, d, "fx_wall").where("sx >= 0 AND sy >= 0 AND ex >= 0 AND ey >= 0").select("floor", F.explode(sight.cells("sx", "sy", "ex", "ey")).alias("cell")).select("floor", F.col("cell.x").alias("px"), F.col("cell.y").alias("py"))
    _, e = chains.straightened(view(spark, d, "fx_node"), _sparse(spark, d), walls, cosine=-0.6)
    return e


_INK = "m AS (SELECT floor, px, py FROM fx_ink)"
#: A pixel's number, from which its place can be read again.
_ID = "floor * 1000000 + (py + 1) * 1000 + px + 1"
_AT = "k // 1000000 AS floor, k % 1000 - 1 AS px, k // 1000 % 1000 - 1 AS py"


def _touch(name: str, m: str, sides: bool = False) -> str:
    """Table ``name`` (a, b): pixels of m beside each other, also by corners unless only ``sides`` count."""
    only = "WHERE abs(i) + abs(j) = 1" if sides else ""
    return f"""{name}_q AS MATERIALIZED (SELECT {_ID} AS a, floor, px + i AS px, py + j AS py FROM {m}, unnest(range(-1, 2)) a_(i), unnest(range(-1, 2)) b_(j) {only}),
{name} AS MATERIALIZED (SELECT a, {_ID} AS b FROM {name}_q q SEMI JOIN {m} m ON m.floor = q.floor AND m.px = q.px AND m.py = q.py)"""


def _groups(name: str, m: str, touch: str) -> str:
    """Table ``name`` (k, c): every pixel of m with the smallest number in its group."""
    return f"""{name}(k, c) USING KEY (k) AS (SELECT {_ID}, {_ID} FROM {m} UNION SELECT t.b, min(l.c) FROM {name} l JOIN {touch} t ON t.a = l.k JOIN recurring.{name} r ON r.k = t.b WHERE l.c < r.c GROUP BY 1)"""


_LAB = f"{_touch('nb', 'm')}, {_groups('lab', 'm', 'nb')}"


def _lines() -> str:
    """Line, place and longest gap of every pixel for each direction, as SQL."""
    parts = []
    for k, (flat, step, _, _) in enumerate(closing.slopes()):
        at, other = ("px", "py") if flat else ("py", "px")
        parts.append(f"SELECT floor, px, py, {k} AS angle, {other} - floor({at} * {step!r}::DOUBLE + 0.5)::INT AS line, {at} AS t, {closing.longest_gap(LENGTH, k)} AS most FROM m")
    return " UNION ALL ".join(parts)


def _back() -> str:
    parts = []
    for k, (flat, step, _, _) in enumerate(closing.slopes()):
        other = f"line + floor(t * {step!r}::DOUBLE + 0.5)::INT"
        parts.append(f"SELECT floor, angle, {'t' if flat else other} AS px, {other if flat else 't'} AS py FROM h WHERE angle = {k}")
    return " UNION ALL ".join(parts)


#: Every pixel between two near ones of a line that is no ink: pairs, not neighbours.
_FILLED = f"""l AS ({_lines()}), h AS (SELECT DISTINCT a.floor, a.angle, a.line, unnest(range(a.t + 1, b.t)) AS t FROM l a JOIN l b ON a.floor = b.floor AND a.angle = b.angle AND a.line = b.line AND b.t > a.t + 1 AND b.t - a.t - 1 <= a.most),
f AS (SELECT h.* FROM ({_back()}) h ANTI JOIN m ON m.floor = h.floor AND m.px = h.px AND m.py = h.py)"""

_NEAR = f"""fr AS (SELECT floor, x, y FROM (SELECT DISTINCT floor FROM m), unnest(range({WIDTH})) a(x), unnest(range({HEIGHT})) b(y)), free AS MATERIALIZED (SELECT fr.* FROM fr ANTI JOIN m ON m.floor = fr.floor AND m.px = fr.x AND m.py = fr.y),
n0 AS MATERIALIZED (SELECT floor, px + i AS x, py + j AS y, min(i * i + j * j) AS q FROM m, unnest(range(-6, 7)) a(i), unnest(range(-6, 7)) b(j) GROUP BY 1, 2, 3),
n1 AS MATERIALIZED (SELECT free.*, n0.q FROM free LEFT JOIN n0 USING (floor, x, y)),
d AS MATERIALIZED (SELECT floor, x, y, q, sqrt(q) AS d FROM n1 WHERE q <= 36 UNION ALL SELECT floor, x, y, min(pow(x - px, 2) + pow(y - py, 2)) AS q, sqrt(min(pow(x - px, 2) + pow(y - py, 2))) FROM n1 JOIN m USING (floor) WHERE q IS NULL OR q > 36 GROUP BY 1, 2, 3)"""

QUERIES = {
    "R11_ink_runs": ink_runs, "R11_ink_groups": ink_groups, "R13_bridged_gaps": bridged_gaps, "R17_exterior": exterior_pixels, "V01_outlines": outlines, "R14_refilled": refilled, "J08_gate_sides": gate_sides,
    "V14_sight_lines": sight_lines, "J11_standing_gates": standing_gates, "R15_distances": free_distances, "A09_poles": space_poles, "V03_ink_boxes": ink_boxes, "V12_node_lines": node_lines,
    "G05_chains": graph_chains, "G04_pruned": pruned_graphs, "G06_merged": merged_graphs, "G13_straightened": straight_graphs,
}

ORACLES = {
    "R11_ink_runs": duck("SELECT floor, py::BIGINT AS y, min(px)::BIGINT AS x0, max(px)::BIGINT AS x1 FROM (SELECT floor, px, py, sum(new) OVER (PARTITION BY floor, py ORDER BY px) AS run FROM (SELECT floor, px, py, (px - coalesce(lag(px) OVER (PARTITION BY floor, py ORDER BY px), -9) > 1)::INT AS new FROM fx_ink)) GROUP BY floor, py, run", "fx_ink"),
    "R11_ink_groups": duck(f"""WITH {_INK}, {_LAB}, g AS (SELECT c, {_AT} FROM lab) SELECT floor::INT AS floor, c % 1000 - 1 AS fx, c // 1000 % 1000 - 1 AS fy, count(*) AS area, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy FROM g GROUP BY 1, c""", "fx_ink", recursive=True),
    "R13_bridged_gaps": duck(f"WITH {_INK}, {_FILLED} SELECT floor, angle, count(*) AS n, sum(px)::BIGINT AS sx, sum(py)::BIGINT AS sy FROM f GROUP BY 1, 2", "fx_ink"),
    "R17_exterior": duck(f"""WITH {_INK}, {_FILLED}, w AS (SELECT floor, px, py FROM m UNION SELECT floor, px, py FROM f),
fr AS (SELECT floor, x AS px, y AS py FROM (SELECT DISTINCT floor FROM m), unnest(range({WIDTH})) a(x), unnest(range({HEIGHT})) b(y)), free AS MATERIALIZED (SELECT fr.* FROM fr ANTI JOIN w ON w.floor = fr.floor AND w.px = fr.px AND w.py = fr.py),
{_touch("nf", "free")}, e(k) AS (SELECT {_ID} FROM free WHERE px IN (0, {WIDTH - 1}) OR py IN (0, {HEIGHT - 1}) UNION SELECT nf.b FROM e JOIN nf ON nf.a = e.k)
SELECT floor::INT AS floor, count(*) AS n, sum(px)::BIGINT AS sx, sum(py)::BIGINT AS sy FROM (SELECT {_AT} FROM e) GROUP BY 1""", "fx_ink", recursive=True),
    # Outer rings are groups of ink, holes are groups of free pixels that touch by sides and reach no frame; each unit side of a pixel towards a free one is a step.
    "V01_outlines": duck(f"""WITH {_INK}, {_LAB}, fr AS (SELECT floor, x AS px, y AS py FROM (SELECT DISTINCT floor FROM m), unnest(range(-1, {WIDTH + 1})) a(x), unnest(range(-1, {HEIGHT + 1})) b(y)), free AS MATERIALIZED (SELECT fr.* FROM fr ANTI JOIN m ON m.floor = fr.floor AND m.px = fr.px AND m.py = fr.py),
{_touch("nf", "free", True)}, e(k) AS (SELECT {_ID} FROM free WHERE px IN (-1, {WIDTH}) OR py IN (-1, {HEIGHT}) UNION SELECT nf.b FROM e JOIN nf ON nf.a = e.k),
inner_ AS MATERIALIZED (SELECT floor, px, py FROM free WHERE {_ID} NOT IN (SELECT k FROM e)), {_touch("ni", "inner_", True)}, {_groups("hol", "inner_", "ni")},
s AS (SELECT q.floor, count(*) AS n FROM (SELECT floor, px + i AS x, py + j AS y FROM m, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(i, j)) q ANTI JOIN m ON m.floor = q.floor AND m.px = q.x AND m.py = q.y GROUP BY 1)
SELECT g.floor::INT AS floor, g.n AS outer_rings, coalesce(h.n, 0) AS holes, g.area::DOUBLE AS area, s.n::DOUBLE AS perimeter FROM (SELECT k // 1000000 AS floor, count(DISTINCT c) AS n, count(*) AS area FROM lab GROUP BY 1) g LEFT JOIN (SELECT k // 1000000 AS floor, count(DISTINCT c) AS n FROM hol GROUP BY 1) h ON h.floor = g.floor JOIN s ON s.floor = g.floor""", "fx_ink", recursive=True),
    "R14_refilled": duck("SELECT floor, count(*) AS drawn, count(*) AS filled, 0::BIGINT AS different FROM fx_ink GROUP BY 1", "fx_ink"),
    "J08_gate_sides": duck(f"""WITH m AS (SELECT floor, px, py FROM fx_ink WHERE px >= 8), {_LAB}, w AS (SELECT {_AT}, (c // 1000 % 1000 - 1) * {WIDTH} + c % 1000 - 1 AS c FROM lab UNION ALL SELECT floor, px, py, -1 FROM fx_ink WHERE px < 8),
p AS (SELECT floor, opening, s, k, floor(cx + s * nx * far + 0.5) AS x, floor(cy + s * ny * far + 0.5) AS y FROM (SELECT *, unnest([depth / 2 + 2.0::DOUBLE, depth / 2 + 0.15::DOUBLE * 10, depth / 2 + 0.35::DOUBLE * 10, depth / 2 + 0.6::DOUBLE * 10]) AS far, unnest([0, 1, 2, 3]) AS k FROM fx_gate WHERE floor IN (SELECT floor FROM fx_ink)) g, (VALUES (1), (-1)) v(s)),
q AS (SELECT p.floor, opening, s, k, CASE WHEN p.x < 0 OR p.y < 0 OR p.x >= {WIDTH} OR p.y >= {HEIGHT} THEN -1 ELSE w.c END AS c FROM p LEFT JOIN w ON w.floor = p.floor AND w.px = p.x AND w.py = p.y)
SELECT floor, opening, coalesce(arg_min(c, k) FILTER (s = 1 AND c IS NOT NULL), 0)::BIGINT AS side_a, coalesce(arg_min(c, k) FILTER (s = -1 AND c IS NOT NULL), 0)::BIGINT AS side_b FROM q GROUP BY 1, 2""", "fx_ink", "fx_gate", recursive=True),
    # A closed unit square and a segment meet if their boxes do and the square's corners do not all lie on one side of the line.
    "V14_sight_lines": duck(f"""WITH p AS (SELECT a.floor, a.opening % 2 AS room, a.opening AS a, b.opening AS b, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by_ FROM fx_gate a JOIN fx_gate b ON a.floor = b.floor AND a.opening < b.opening AND a.opening % 2 = b.opening % 2 WHERE pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) <= {FAR * FAR})
SELECT floor, room, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM fx_ink i WHERE i.floor = p.floor AND i.px BETWEEN least(ax, bx) AND greatest(ax, bx) AND i.py BETWEEN least(ay, by_) AND greatest(ay, by_) AND 2 * abs((bx - ax) * (i.py - ay) - (by_ - ay) * (i.px - ax)) <= abs(bx - ax) + abs(by_ - ay))""", "fx_ink", "fx_gate"),
    # One after the other: each step takes the lowest that is left of every floor and strikes what is near it.
    "J11_standing_gates": duck("""WITH g AS MATERIALIZED (SELECT floor, opening, cx, cy, depth::BIGINT * 1000000000 + opening AS rank FROM fx_gate),
s(floor, taken, opening, rank_, open_) AS (SELECT floor, false, NULL::BIGINT, NULL::BIGINT, list({'o': opening, 'x': cx, 'y': cy, 'r': rank} ORDER BY rank) FROM g GROUP BY floor
UNION ALL SELECT floor, true, open_[1].o, open_[1].r, list_filter(open_[2:], lambda q: pow(q.x - open_[1].x, 2) + pow(q.y - open_[1].y, 2) > 900) FROM s WHERE len(open_) > 0)
SELECT floor, opening FROM s WHERE taken""", "fx_gate", recursive=True),
    # Ink spreads over squares of growing side; what a side reaches no nearer is found is left to the whole floor's ink.
    "R15_distances": duck(f"""WITH {_INK}, {{near}} SELECT floor, count(*) AS n, round(sum(d), 3) AS total, round(max(d), 6) AS most FROM d GROUP BY 1""".replace("{near}", _NEAR), "fx_ink"),
    "A09_poles": duck(f"""WITH {_INK}, {{near}} SELECT floor, (x // 100 + 2 * (y // 75))::INT AS quarter, arg_min(x, (-q) * 1000000 + y * 1000 + x)::BIGINT AS px, arg_min(y, (-q) * 1000000 + y * 1000 + x)::BIGINT AS py, round(max(d), 6) AS radius FROM d GROUP BY 1, 2""".replace("{near}", _NEAR), "fx_ink"),
    # Every pair of ends of lines with all others on one side is an edge of the hull.
    "V03_ink_boxes": duck(f"""WITH {_INK}, {_LAB}, big AS (SELECT c FROM lab GROUP BY 1 HAVING count(*) >= 5), g AS (SELECT c, {_AT} FROM lab WHERE c IN (SELECT c FROM big)),
p AS MATERIALIZED (SELECT DISTINCT c, unnest([min(px), max(px)])::DOUBLE AS x, py::DOUBLE AS y FROM g GROUP BY c, py),
e AS (SELECT a.c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.c = b.c AND (a.x <> b.x OR a.y <> b.y)),
s AS (SELECT e.c, ax, ay, bx, by_, max((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) AS side, max((bx - ax) * p.x + (by_ - ay) * p.y) - min((bx - ax) * p.x + (by_ - ay) * p.y) AS u, max((bx - ax) * p.y - (by_ - ay) * p.x) - min((bx - ax) * p.y - (by_ - ay) * p.x) AS v FROM e JOIN p ON p.c = e.c GROUP BY 1, 2, 3, 4, 5)
SELECT (c // 1000000)::INT AS floor, c % 1000 - 1 AS fx, c // 1000 % 1000 - 1 AS fy, round(min(u * v / (pow(bx - ax, 2) + pow(by_ - ay, 2))), 6) AS area FROM s WHERE side <= 0 GROUP BY c""", "fx_ink", recursive=True),
    "V12_node_lines": duck("""WITH p AS MATERIALIZED (SELECT floor, ord // 100 AS line, ord, x, y FROM fx_node),
s(floor, line, lo, hi) AS (SELECT floor, line, min(ord), max(ord) FROM p GROUP BY 1, 2 UNION ALL
  SELECT floor, line, unnest([lo, mid]), unnest([mid, hi]) FROM (SELECT s.floor, s.line, s.lo, s.hi, arg_max(p.ord, (d, -p.ord)) AS mid, max(d) AS far FROM s JOIN p ON p.floor = s.floor AND p.line = s.line AND p.ord > s.lo AND p.ord < s.hi
    JOIN p a ON a.floor = s.floor AND a.line = s.line AND a.ord = s.lo JOIN p b ON b.floor = s.floor AND b.line = s.line AND b.ord = s.hi,
    LATERAL (SELECT CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2)) ELSE abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) END AS d) l GROUP BY 1, 2, 3, 4) WHERE far > 200)
SELECT DISTINCT floor, line, unnest([lo, hi]) AS ord FROM s""", "fx_node", recursive=True),
    # Walks from every node that is no part of a chain, over those that are, to the next one.
    "G05_chains": duck("""WITH n AS (SELECT floor, node, x, y FROM fx_node), e AS MATERIALIZED (SELECT e.floor, from_node AS a, to_node AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS l FROM fx_edge e JOIN n p ON p.floor = e.floor AND p.node = from_node JOIN n q ON q.floor = e.floor AND q.node = to_node WHERE kind = 'corridor' OR from_node % 11 = 0),
t AS MATERIALIZED (SELECT floor, a, b, l FROM e UNION ALL SELECT floor, b, a, l FROM e), i AS MATERIALIZED (SELECT floor, a AS node FROM t GROUP BY 1, 2 HAVING count(*) = 2),
w(floor, start, prev, cur, l, inner_, least_) AS (SELECT t.floor, t.a, t.a, t.b, t.l, 0, 0 FROM t ANTI JOIN i ON i.floor = t.floor AND i.node = t.a UNION ALL
  SELECT w.floor, w.start, w.cur, t.b, w.l + t.l, w.inner_ + 1, CASE WHEN w.inner_ = 0 THEN w.cur ELSE least(w.least_, w.cur) END FROM w JOIN i ON i.floor = w.floor AND i.node = w.cur JOIN t ON t.floor = w.floor AND t.a = w.cur AND t.b <> w.prev)
SELECT floor, least(start, cur) AS a, greatest(start, cur) AS b, round(min(l), 4) AS length, inner_::BIGINT AS inner FROM w ANTI JOIN i ON i.floor = w.floor AND i.node = w.cur GROUP BY floor, least(start, cur), greatest(start, cur), inner_, least_""", "fx_node", "fx_edge", recursive=True),
}
