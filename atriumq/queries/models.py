"""Scalar, proposal, classification, measure and option queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from atriumq.bitmap import runs
from atriumq.checkpoint import kept
from atriumq.fixtures import duck, view
from atriumq.functions import geometry as g
from atriumq.functions import text as t
from atriumq.operators import checks, graphs, inference, measures, network, options, proposals
from atriumq.queries.bitmaps import _LAB
from atriumq.sources import catalog, uploads

_r = lambda c, n=6: F.round(c, n)


def edge_measures(spark, d):
    """Lengths in pixels and metres of all edges, with and without calibration."""
    f, n, e = (view(spark, d, x) for x in ("fx_floor", "fx_node", "fx_edge"))
    f = f.withColumn("ppm", F.when(F.col("floor") % 6 == 0, 0.0).when(F.col("floor") % 6 != 1, F.col("ppm")))
    p = network.placed_edges(e.drop("building"), n).join(f, "floor")
    px = g.distance("ax", "ay", "bx", "by")
    c = g.calibrated(px, F.col("from_node") % 4 - 1)
    return p.select("floor", "from_node", "to_node", _r(px).alias("px"), _r(g.measured_meters(px, "ppm")).alias("measured"), _r(g.edge_meters(px, "ppm")).alias("metres"), _r(c["ppm"]).alias("calibrated"), c["error"].alias("error"), _r(g.cross("ax", "ay", "bx", "by", F.lit(500.0), F.lit(300.0)), 3).alias("turn"))


def point_measures(spark, d):
    n = view(spark, d, "fx_node")
    u, v = F.col("x") / 1009, F.col("y") / 757
    s = g.centred_segment("x", "y", F.lit(0.6), F.lit(0.8), F.lit(10.0))
    return n.select("node", _r(g.clamped(F.col("x") - 100, F.lit(800))).alias("cx"), _r(g.luminance(u, v, F.lit(0.5))).alias("ink"), g.near("x", "y", F.lit(500.0), F.lit(300.0), 200).alias("close"), _r(s["sx"]).alias("sx"), _r(s["ey"]).alias("ey"), g.pixel_point(F.struct("x", "y"), 0.5)["x"].alias("half"), _r(g.to_meters(g.to_pixels("x", F.lit(3.0)), F.lit(4.0))).alias("m"))


def curve_points(spark, d):
    """A cubic curve through each wall, its points and its length."""
    w = view(spark, d, "fx_wall")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    b = g.bezier(p(c("sx"), c("sy")), p(c("sx"), c("ey")), p(c("ex"), c("sy")), p(c("ex"), c("ey")))
    w = w.withColumn("pts", b)
    return w.select("wall", F.size("pts").alias("n"), _r(F.get("pts", F.lit(3))["x"], 4).alias("x3"), _r(F.get("pts", F.lit(6))["y"], 4).alias("y6"), _r(g.path_length(F.col("pts")), 3).alias("length"))


def vertical_costs(spark, d):
    c = view(spark, d, "fx_connector").withColumn("kind", F.when(F.col("src_floor") % 5 == 0, "escalator").otherwise(F.col("kind")))
    return catalog.default_connector(c.withColumn("accessible", F.lit(None).cast("boolean"))).select("src_floor", "dst_floor", "kind", g.vertical_meters("kind").alias("metres"), F.coalesce("accessible", F.lit(False)).alias("accessible"))


def scales(spark, d):
    f = view(spark, d, "fx_floor")
    s = g.resolved_scale(F.when(F.col("floor") % 3 == 0, F.col("ppm")), F.when(F.col("floor") % 3 == 1, F.lit(0.0)).when(F.col("floor") % 4 == 2, F.lit(33.0)), F.col("floor") * 0.9)
    return f.select("floor", _r(s["ppm"]).alias("ppm"), s["source"].alias("source"))


def proposed_nodes(spark, d):
    n = view(spark, d, "fx_node").withColumn("label", F.when(F.col("node") % 3 == 0, F.col("label")).when(F.col("node") % 3 == 1, "  ")).withColumn("kind", F.when(F.col("node") % 17 == 0, "stairwell").otherwise(F.col("kind")))
    return proposals.labelled_nodes(n).select("floor", "node", "kind", "label")


def _doubled(e):
    back = e.where("from_node % 3 = 0").select("floor", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "kind", (F.col("from_node") + 1_000_000).alias("ord"))
    return e.select("floor", "from_node", "to_node", "kind", F.col("from_node").alias("ord")).unionByName(back)


def proposed_edges(spark, d):
    n, e, w = (view(spark, d, x) for x in ("fx_node", "fx_edge", "fx_wall"))
    kept, _ = proposals.surviving_edges(_doubled(e.where("kind = 'corridor'")), n.drop("ord"), w)
    return kept.select("floor", "from_node", "to_node", "kind")


def rejected_edges(spark, d):
    n, e, w = (view(spark, d, x) for x in ("fx_node", "fx_edge", "fx_wall"))
    _, rejected = proposals.surviving_edges(_doubled(e.where("kind = 'corridor'")), n.drop("ord"), w)
    return rejected.groupBy("floor").agg(F.count("*").alias("rejected"))


def proposal_rules(spark, d):
    f, n, e = (view(spark, d, x) for x in ("fx_floor", "fx_node", "fx_edge"))
    return checks.proposal_rules(f, n.where("floor % 3 <> 0 OR node < 50"), e.where("floor % 4 <> 1"))


def ring_segments(spark, d):
    """Walls of polygons: the boxes around every wall, doubled with a shift, as segments without repeats."""
    w = view(spark, d, "fx_wall")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(p("sx", "sy"), p("ex", "sy"), p("ex", "ey"), p("sx", "ey"))
    polys = w.select("floor", F.col("wall").alias("ord"), F.array(box, F.reverse(box)).alias("rings"))
    return proposals.wall_segments(proposals.ring_segments(polys), proposals.MAX_SEGMENTS).groupBy("floor").agg(F.count("*").alias("n"), _r(F.sum(g.distance("sx", "sy", "ex", "ey")), 3).alias("length"))


def nearest_nodes(spark, d):
    n, p = view(spark, d, "fx_node"), view(spark, d, "fx_poi")
    return proposals.nearest_node(p, n, "poi").select("floor", "poi", "node", _r("distance").alias("distance"))


def near_nodes(spark, d):
    n, p = view(spark, d, "fx_node"), view(spark, d, "fx_poi")
    return proposals.nearest_node(p, n, "poi", radius=60.0).select("floor", "poi", "node")


def reattached(spark, d):
    n, p = view(spark, d, "fx_node"), view(spark, d, "fx_poi")
    return proposals.reattached(p, n)


def _proposal(spark, d):
    """Diamonds around the beginnings of walls, the corridors of a floor doubled, and its places."""
    f, w, n, e, p = (view(spark, d, x) for x in ("fx_floor", "fx_wall", "fx_node", "fx_edge", "fx_poi"))
    at = lambda dx, dy: F.struct((F.col("sx") + dx).alias("x"), (F.col("sy") + dy).alias("y"))
    polygons = w.select("floor", F.col("wall").alias("ord"), F.array(F.array(at(-9, 0), at(0, -7), at(9, 0), at(0, 7))).alias("rings"))
    n = n.where("floor % 6 <> 5 OR ord < 2").withColumn("label", F.when(F.col("node") % 3 == 0, F.col("label")))
    return proposals.proposal(f, polygons, n.select("floor", "node", "ord", "x", "y", "kind", "label"), _doubled(e.where("kind = 'corridor'")), p.select("floor", "poi", "x", "y"))


def proposal_edges(spark, d):
    return _proposal(spark, d)["edges"].select("floor", "from_node", "to_node", "kind")


def proposal_diagnostics(spark, d):
    return _proposal(spark, d)["diagnostics"]


def proposal_places(spark, d):
    return _proposal(spark, d)["pois"].select("floor", "poi", F.col("node_id").alias("node"))


def tile_blend(spark, d):
    """The likeliest of three classes of every pixel, of tiles of 16 by 16 that overlap by half."""
    px = view(spark, d, "fx_pixel").groupBy("floor", "px", "py").agg(F.min("gray").alias("gray"))
    tiles = px.withColumn("x0", F.explode(F.array(F.floor(F.col("px") / 8) * 8, F.floor(F.col("px") / 8) * 8 - 8))).withColumn("y0", F.explode(F.array(F.floor(F.col("py") / 8) * 8, F.floor(F.col("py") / 8) * 8 - 8)))
    value = (F.col("gray") * (F.col("class") + 1) + F.col("x0") * 3 + F.col("y0") * 5) % 101 / 100.0
    tiles = tiles.withColumn("class", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumns({"tx": F.col("px") - F.col("x0"), "ty": F.col("py") - F.col("y0"), "value": value})
    out = measures.blended(tiles, 16)
    return out.groupBy("floor", "class").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def classified_spaces(spark, d):
    return inference.classified(view(spark, d, "fx_space"), view(spark, d, "fx_opening")).select("floor", "space", "kind", "connector_kind", "doors", _r("confidence").alias("confidence"))


def passages(spark, d):
    s, o = view(spark, d, "fx_space"), view(spark, d, "fx_opening")
    return inference.passages(o, inference.classified(s, o)).select("floor", "opening", "kind")


def assigned_openings(spark, d):
    o = view(spark, d, "fx_opening").withColumn("side_a", F.when(F.col("opening") % 5 == 0, "exterior").when(F.col("opening") % 7 != 0, F.col("space_a").cast("string")))
    o = o.withColumn("side_b", F.when(F.col("opening") % 11 == 0, "exterior").when(F.col("opening") % 13 != 0, F.coalesce(F.col("space_b"), F.col("space_a")).cast("string")))
    o = o.withColumn("sources", F.when(F.col("opening") % 3 == 0, F.array(F.lit("gap"), F.lit("swing"))).otherwise(F.array(F.lit("gap"))))
    return inference.assigned_openings(o.drop("space_a", "space_b")).select("floor", "opening", "verdict", "space_a", "space_b")


def label_rules(spark, d):
    label = F.col("label")
    return view(spark, d, "fx_space").select("space", t.is_circulation(label).alias("circulation"), t.vertical_kind(label).alias("vertical"), t.is_void(label).alias("void"), _r(t.drawing_scale(label, 2.0)).alias("ppm"), t.squeezed(F.concat(F.lit("  "), label, F.lit(" \t x "))).alias("squeezed"))


def envelope_gaps(spark, d):
    o = view(spark, d, "fx_opening").withColumn("space", F.col("space_a")).withColumn("contact", F.col("opening")).withColumn("perimeter", F.lit(60.0) + F.col("space_a") % 90).withColumn("ppm", F.lit(10.0)).withColumn("touches_border", F.col("opening") % 4 == 0).withColumn("evidence", (F.col("opening") % 3).cast("double"))
    return inference.envelope_gaps(o).select("floor", "contact", "void", "verdict")


def containing_space(spark, d):
    """Which of the slanted diamonds around the beginnings of walls a node lies in, and the labels that each collects in order."""
    n, w = view(spark, d, "fx_node"), view(spark, d, "fx_wall")
    p = lambda dx, dy: F.struct((F.col("sx") + 0.25 + dx).alias("x"), (F.col("sy") + 0.5 + dy).alias("y"))
    rings = w.select("floor", F.col("wall").alias("ord"), F.col("wall").alias("space"), F.array(p(-80, 0), p(0, -60), p(80, 0), p(0, 60)).alias("ring"))
    labels = n.select("floor", F.col("node").alias("label_no"), "x", "y", F.col("label").alias("text"))
    return inference.joined_labels(inference.first_containing(labels, rings), labels)


def origin_options(spark, d):
    f, n, q, p = (view(spark, d, x) for x in ("fx_floor", "fx_node", "fx_qr", "fx_poi"))
    q = q.withColumn("node", F.floor(F.col("node") / 5) * 5 % 1500)
    return options.origins(f, n, q, p.withColumn("name", F.when(F.col("poi") % 2 == 0, "Punto").otherwise(F.col("name"))))


def destination_options(spark, d):
    return options.destinations(view(spark, d, "fx_floor"), view(spark, d, "fx_poi"))


def diagnostics(spark, d):
    f, n, e, o = (view(spark, d, x) for x in ("fx_floor", "fx_node", "fx_edge", "fx_opening"))
    s = inference.classified(view(spark, d, "fx_space"), o)
    return options.diagnostics(f, openings=o, spaces=s, nodes=n, edges=e)


def proposal_summary(spark, d):
    k = F.col("floor")
    n = diagnostics(spark, d).withColumn("errors", k % 3).withColumn("warnings", k % 2).withColumn("ppm", F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 20.0)).withColumn("estimated_ppm", F.when(k % 5 != 0, k * 1.25))
    return options.summary(n)


def stroke_mode(spark, d):
    return measures.stroke_mode(view(spark, d, "fx_pixel")).select("floor", _r("mode").alias("mode"))


def otsu(spark, d):
    return measures.otsu(view(spark, d, "fx_pixel")).withColumn("threshold", F.col("threshold").cast("int"))


def dark_pixels(spark, d):
    return measures.dark_pixels(view(spark, d, "fx_pixel")).groupBy("floor").agg(F.count("*").alias("n"), F.max("gray").alias("most"))


def stroke_threshold(spark, d):
    return measures.wall_stroke_width(view(spark, d, "fx_stroke")).select("floor", _r("threshold").alias("threshold"))


def stroke_roles(spark, d):
    return measures.wall_strokes(view(spark, d, "fx_stroke")).select("floor", "ord", "role", _r("length").alias("length"))


def wall_fills(spark, d):
    return measures.wall_fills(view(spark, d, "fx_stroke"), 240_000.0).select("floor", "ord")


def _grouped(spark, d):
    """Dark pixels with the number of the first pixel of their group and how light they are."""
    px = view(spark, d, "fx_pixel").where("gray < 60").groupBy("floor", "px", "py").agg((F.avg("gray") / 255).alias("probability"))
    found = runs.pixels_of(runs.labelled(runs.runs(px)), "component")
    x, y = runs.first_pixel()
    return px.join(found, ["floor", "px", "py"]).withColumn("component", y * 200 + x)


def pixel_groups(spark, d):
    return measures.large_groups(_grouped(spark, d), 2).select("floor", "component", "area", "x0", "y0", "x1", "y1", _r("cx").alias("cx"), _r("cy").alias("cy"))


def group_overlap(spark, d):
    px = _grouped(spark, d)
    return measures.group_overlap(px, px.where("py % 3 = 0")).select("floor", "component", _r("overlap").alias("overlap"), _r("probability").alias("probability"))


def accepted_groups(spark, d):
    """Groups of dark pixels that count as walls beside those that are drawn."""
    px = kept(_grouped(spark, d), "groups")
    groups = measures.large_groups(px, 1).join(measures.group_overlap(px, px.where("py % 5 = 0 AND px % 3 = 0 AND floor % 4 <> 1")), ["floor", "component"]).withColumn("ppm", 3.0 + F.col("component") % 6)
    return measures.accepted_classical(groups).select("floor", "component", "area")


def shape_features(spark, d):
    s = view(spark, d, "fx_space").withColumns({"radius": F.col("narrowness") * 20, "long_side": F.col("elongation") * 7, "short_side": F.col("space") % 9 / 2})
    return inference.shape_features(s).select("floor", "space", _r("narrowness").alias("narrowness"), _r("elongation").alias("elongation"))


def fitted_images(spark, d):
    """Sizes of images once their longer side is brought to what is analysed."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") * 37 % 9000 + 1).alias("w"), (F.col("p_partkey") * 53 % 6000 + 1).alias("h"))
    return p.select("p_partkey", _r(uploads.fitted_side(F.col("w"), F.col("h")), 9).alias("factor"))


def face_spread(spark, d):
    px = view(spark, d, "fx_pixel").withColumn("across", F.col("thickness"))
    return measures.face_spread(px.withColumn("gap", F.col("px") % 5), "gap").select("floor", "gap", _r("low").alias("low"), _r("middle").alias("middle"), _r("high").alias("high"))


def principal_angles(spark, d):
    p = view(spark, d, "fx_point")
    return p.groupBy("cluster").agg(_r(g.principal_angle("x", "y"), 5).alias("angle"))


def pixel_sets(spark, d):
    """Union, intersection and difference of two masks as pixel sets, counted by floor."""
    px = view(spark, d, "fx_pixel").select("floor", "px", "py", "gray")
    a, b = px.where("gray < 60").select("floor", "px", "py").distinct(), px.where("gray % 2 = 0").select("floor", "px", "py").distinct()
    parts = [m.groupBy("floor").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, m in (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only", a.subtract(b)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def deleted_nodes(spark, d):
    n, p, e, c, q = (view(spark, d, x) for x in ("fx_node", "fx_poi", "fx_edge", "fx_connector", "fx_qr"))
    left = proposals.without_nodes(n.where("node % 7 = 0").select("floor", "node"), p, e, c, q)
    return left["pois"].select("floor", F.lit("poi").alias("what")).unionByName(left["edges"].select("floor", F.lit("edge").alias("what"))).unionByName(left["connectors"].select(F.col("src_floor").alias("floor"), F.lit("connector").alias("what"))).unionByName(left["anchors"].select("floor", F.lit("anchor").alias("what"))).groupBy("floor", "what").agg(F.count("*").alias("n"))


def nearest_candidates(spark, d):
    """Twenty nearest nodes of every place."""
    return proposals.candidates(view(spark, d, "fx_poi"), view(spark, d, "fx_node"), "poi", 20).select("floor", "poi", "place", "node", _r("distance").alias("distance"))


def thinned_paths(spark, d):
    return proposals.thinned(view(spark, d, "fx_node"), ["floor"], 12).select("floor", "node")


def ordered_polygons(spark, d):
    w, p = view(spark, d, "fx_wall"), view(spark, d, "fx_poi")
    part = lambda df, k: df.select("floor", F.col(k).alias("ord"))
    return proposals.in_order(wall=part(w, "wall"), obstacle=part(p.where("poi % 7 = 0"), "poi"), window=part(p.where("poi % 11 = 0"), "poi")).select("floor", "kind", "ord", "n")


def fitting_openings(spark, d):
    o = view(spark, d, "fx_opening").withColumn("depth", F.col("opening") % 14).withColumn("ppm", F.lit(12.0))
    return inference.fitting(o).select("floor", "opening")


def largest_spaces(spark, d):
    return inference.largest(view(spark, d, "fx_space"), "space")


def opening_sides(spark, d):
    s = view(spark, d, "fx_space").withColumn("kind", F.when(F.col("is_void"), "void").otherwise("room"))
    return inference.with_space_kinds(view(spark, d, "fx_opening").drop("kind"), s).select("floor", "opening", "kind_a", "kind_b")


def opening_sources(spark, d):
    o = view(spark, d, "fx_opening")
    seen = o.select("floor", "opening", F.array(F.lit("gap")).alias("sources")).unionByName(o.where("opening % 2 = 0").select("floor", "opening", F.array(F.lit("swing"), F.lit("gap")).alias("sources"))).unionByName(o.where("opening % 3 = 0").select("floor", "opening", F.array(F.lit("ml")).alias("sources")))
    return inference.merged_sources(seen).select("floor", "opening", F.array_join("sources", "+").alias("sources"))


def path_lengths(spark, d):
    return graphs.path_lengths(view(spark, d, "fx_node")).select("floor", _r("length", 4).alias("length"))


def catalog_list(spark, d):
    """Orders as catalog rows, newest first."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return catalog.newest_first(o)


def catalog_upsert(spark, d):
    """Customers replaced by newer rows of the same key."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = c.where("id % 5 = 0").select((F.col("id") + F.when(F.col("id") % 10 == 0, 0).otherwise(1_000_000)).alias("id"), (F.col("v") + 1).alias("v"))
    return catalog.replaced(c, new, "id")


def upload_names(spark, d):
    """Suffix, safety and code rules on names made from parts."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    ends = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".svg", "", ".tar.gz", ".Jpeg")]), (k % 5 + 1).cast("int"))
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a/", "../", "", "b/../", "/", "./")]), (k % 6 + 1).cast("int")), F.lit("plan"), k.cast("string"), ends)
    p = p.withColumn("n", name).withColumn("csv", F.concat(F.lit(" http://a , ,"), "p_brand", F.lit(",b ")))
    return p.select("p_partkey", t.suffix(F.col("n")).alias("suffix"), uploads.inside(F.col("n")).alias("inside"), F.array_join(t.split_list(F.col("csv")), "|").alias("origins"), t.location(F.concat(F.lit("f"), k.cast("string"), F.lit("::n1")))["floor"].alias("floor_token"), t.code_key(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("code"), t.one_decimal(F.col("p_retailprice")).alias("price"))


_DIAG = """d AS (SELECT f.floor, coalesce(o.doors, 0) AS doors, coalesce(o.entrances, 0) AS entrances, coalesce(s.spaces, 0) AS spaces, coalesce(s.circulation, 0) AS circulation, coalesce(n.nodes, 0) AS nodes, coalesce(e.edges, 0) AS edges FROM fx_floor f
 LEFT JOIN (SELECT floor, count(*) FILTER (kind <> 'entrance') AS doors, count(*) FILTER (kind = 'entrance') AS entrances FROM fx_opening GROUP BY 1) o USING (floor) LEFT JOIN (SELECT floor, count(*) AS spaces, count(*) FILTER (kind = 'circulation') AS circulation FROM cls GROUP BY 1) s USING (floor)
 LEFT JOIN (SELECT floor, count(*) AS nodes FROM fx_node GROUP BY 1) n USING (floor) LEFT JOIN (SELECT floor, count(*) AS edges FROM fx_edge GROUP BY 1) e USING (floor))"""
_CIRC = r"(?i)\b(pasillo|pasadizo|corredor|corridor|hall|vest[ií]bulo|lobby|espera|recepci[oó]n|reception|circulaci[oó]n|atrio|foyer)\b"
_VOID = r"(?i)\b(patio|jard[ií]n|garden|ducto|shaft|vac[ií]o|void|terraza)\b"
_VERT = r"CASE WHEN regexp_matches(label, '(?i)\b(ascensor(es)?|elevador|elevator|lift)\b') THEN 'elevator' WHEN regexp_matches(label, '(?i)\b(escaleras?|stairs?|staircase)\b') THEN 'stairs' WHEN regexp_matches(label, '(?i)\b(rampa|ramp)\b') THEN 'ramp' END"
_CLS = f"""sd AS (SELECT floor, opening, kind, unnest([space_a, space_b]) AS space FROM fx_opening), dc AS (SELECT floor, space, count(*) AS doors, max((kind = 'entrance')::INT) AS entrance FROM sd WHERE space IS NOT NULL GROUP BY 1, 2),
s1 AS (SELECT s.*, coalesce(dc.doors, 0) AS doors, coalesce(dc.entrance, 0) AS entrance FROM fx_space s LEFT JOIN dc ON dc.floor=s.floor AND dc.space=s.space), s2 AS (SELECT *, max(doors) OVER (PARTITION BY floor) AS most, {_VERT} AS vert FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(label, '{_CIRC}') THEN 2.0 ELSE 0 END + CASE WHEN doors >= 3 THEN 1.5 ELSE 0 END + CASE WHEN doors = most AND doors >= 2 THEN 0.5 ELSE 0 END + CASE WHEN elongation >= 2.5 AND narrowness <= 0.3 THEN 1.0 ELSE 0 END + CASE WHEN entrance = 1 AND doors >= 2 THEN 1.0 ELSE 0 END AS score FROM s2),
s4 AS (SELECT *, CASE WHEN is_void OR regexp_matches(label, '{_VOID}') THEN 'void' WHEN vert IS NOT NULL THEN 'vertical' WHEN score >= 1.5 THEN 'circulation' ELSE 'room' END AS k FROM s3),
s5 AS (SELECT *, max((k = 'circulation')::INT) OVER (PARTITION BY floor) = 0 AND k = 'room' AND doors > 0 AND row_number() OVER (PARTITION BY floor, k ORDER BY doors DESC, area DESC, ord) = 1 AS up FROM s4),
cls AS (SELECT floor, space, CASE WHEN up THEN 'circulation' ELSE k END AS kind, CASE WHEN k = 'vertical' THEN vert END AS connector_kind, doors, CASE WHEN up THEN 0.4 WHEN k = 'circulation' THEN least(1.0, 0.5 + score / 4) WHEN k = 'room' THEN CASE WHEN doors > 0 THEN 0.7 ELSE 0.4 END WHEN is_void THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence FROM s5)"""
_HIT2 = """((b.x-a.x)*(w.sy-a.y)-(b.y-a.y)*(w.sx-a.x))*((b.x-a.x)*(w.ey-a.y)-(b.y-a.y)*(w.ex-a.x)) < -1e-7 AND ((w.ex-w.sx)*(a.y-w.sy)-(w.ey-w.sy)*(a.x-w.sx))*((w.ex-w.sx)*(b.y-w.sy)-(w.ey-w.sy)*(b.x-w.sx)) < -1e-7"""
_PROP = f"""e1 AS (SELECT floor, from_node, to_node, kind, from_node AS ord FROM fx_edge WHERE kind='corridor' UNION ALL SELECT floor, to_node, from_node, kind, from_node + 1000000 FROM fx_edge WHERE kind='corridor' AND from_node % 3 = 0),
e2 AS (SELECT * FROM e1 WHERE from_node <> to_node QUALIFY row_number() OVER (PARTITION BY floor, least(from_node,to_node), greatest(from_node,to_node) ORDER BY ord) = 1),
hit AS (SELECT DISTINCT e.floor, e.from_node, e.to_node FROM e2 e JOIN fx_node a ON a.floor=e.floor AND a.node=e.from_node JOIN fx_node b ON b.floor=e.floor AND b.node=e.to_node JOIN fx_wall w ON w.floor=e.floor WHERE {_HIT2})"""
_INK = "i AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS ink, CASE WHEN item IN ('l','c') THEN sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) ELSE 2*(abs(x1-x0)+abs(y1-y0)) END AS len FROM fx_stroke)"
_THR = "bw AS (SELECT floor, width, sum(len) AS l FROM i WHERE ink < 0.55 AND width > 0 AND len > 0 GROUP BY 1, 2), rw AS (SELECT *, sum(l) OVER (PARTITION BY floor ORDER BY width) AS run, sum(l) OVER (PARTITION BY floor) AS al FROM bw), th AS (SELECT floor, greatest(2.0::DOUBLE, min(width) * 0.5) AS threshold FROM rw WHERE run >= 0.9 * al GROUP BY 1)"
_HIST = "h AS (SELECT floor, gray, count(*)::DOUBLE AS n FROM fx_pixel GROUP BY 1, 2), h2 AS (SELECT *, sum(n) OVER (PARTITION BY floor ORDER BY gray) AS w, sum(n*gray) OVER (PARTITION BY floor ORDER BY gray) AS s, sum(n) OVER (PARTITION BY floor) AS tw, sum(n*gray) OVER (PARTITION BY floor) AS ts FROM h), h3 AS (SELECT floor, gray, round(CASE WHEN tw > w THEN w*(tw-w)*pow(s/w-(ts-s)/(tw-w), 2) ELSE 0 END / (tw*tw), 9) AS v FROM h2), ot AS (SELECT floor, gray AS threshold FROM h3 QUALIFY row_number() OVER (PARTITION BY floor ORDER BY v DESC, gray) = 1)"

_G20 = """n AS (SELECT floor, node, ord, x, y, kind FROM fx_node WHERE floor % 6 <> 5 OR ord < 2),
sg AS (SELECT floor, wall, r, sx + [-9, 0, 9, 0][r] AS x0, sy + [0, -7, 0, 7][r] AS y0, sx + [0, 9, 0, -9][r] AS x1, sy + [-7, 0, 7, 0][r] AS y1 FROM fx_wall, unnest(range(1, 5)) u(r)),
kg AS (SELECT *, [round_even(x0/2,0), round_even(y0/2,0), round_even(x1/2,0), round_even(y1/2,0)] AS a, [round_even(x1/2,0), round_even(y1/2,0), round_even(x0/2,0), round_even(y0/2,0)] AS b FROM sg),
wg AS (SELECT * FROM kg QUALIFY row_number() OVER (PARTITION BY floor, least(a, b) ORDER BY wall, r) = 1),
e1 AS (SELECT floor, from_node, to_node, from_node AS ord FROM fx_edge WHERE kind='corridor' UNION ALL SELECT floor, to_node, from_node, from_node + 1000000 FROM fx_edge WHERE kind='corridor' AND from_node % 3 = 0),
e2 AS (SELECT e.floor, from_node, to_node, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM e1 e JOIN n a ON a.floor=e.floor AND a.node=e.from_node JOIN n b ON b.floor=e.floor AND b.node=e.to_node WHERE from_node <> to_node QUALIFY row_number() OVER (PARTITION BY e.floor, least(from_node,to_node), greatest(from_node,to_node) ORDER BY e.ord) = 1),
e3 AS (SELECT floor, from_node, to_node, EXISTS (SELECT 1 FROM wg w WHERE w.floor=e2.floor AND ((bx-ax)*(y0-ay)-(b_y-ay)*(x0-ax))*((bx-ax)*(y1-ay)-(b_y-ay)*(x1-ax)) < -1e-7 AND ((x1-x0)*(ay-y0)-(y1-y0)*(ax-x0))*((x1-x0)*(b_y-y0)-(y1-y0)*(bx-x0)) < -1e-7) AS hit FROM e2),
dg AS (SELECT f.floor, coalesce(w.c, 0) AS walls, coalesce(n.c, 0) AS nodes, coalesce(e.c, 0) AS edges, coalesce(e.h, 0) AS edges_rejected_by_walls FROM fx_floor f LEFT JOIN (SELECT floor, count(*) AS c FROM wg GROUP BY 1) w USING (floor) LEFT JOIN (SELECT floor, count(*) AS c FROM n GROUP BY 1) n USING (floor)
  LEFT JOIN (SELECT floor, count(*) FILTER (NOT hit) AS c, count(*) FILTER (hit) AS h FROM e3 GROUP BY 1) e USING (floor)),
rf AS (SELECT *, CASE WHEN nodes < 2 THEN 'too-few-nodes' WHEN edges < 1 THEN 'no-edges' END AS refused FROM dg)"""
_G20_V = ("fx_floor", "fx_wall", "fx_edge", "fx_poi")

#: Dark pixels with the first pixel of their group, in reading order.
_DARK = f"""m AS MATERIALIZED (SELECT floor, px, py, avg(gray) / 255 AS probability FROM fx_pixel WHERE gray < 60 GROUP BY 1, 2, 3), {_LAB},
gr AS (SELECT m.floor, m.px, m.py, m.probability, (c // 1000 % 1000 - 1) * 200 + c % 1000 - 1 AS component FROM lab JOIN m ON m.floor * 1000000 + (m.py + 1) * 1000 + m.px + 1 = lab.k)"""

QUERIES = {
    "P03_edge_measures": edge_measures, "P07_point_measures": point_measures, "P12_curve_points": curve_points, "P19_vertical_costs": vertical_costs, "P14_scales": scales,
    "W01_proposed_nodes": proposed_nodes, "W02_proposed_edges": proposed_edges, "J04_rejected_edges": rejected_edges, "M12_proposal_rules": proposal_rules, "V15_ring_segments": ring_segments,
    "G20_proposal_edges": proposal_edges, "G20_proposal": proposal_diagnostics, "G20_proposal_places": proposal_places, "R06_tile_blend": tile_blend,
    "J13_nearest_nodes": nearest_nodes, "J14_near_nodes": near_nodes, "G20_reattached_places": reattached, "I06_classified_spaces": classified_spaces, "I08_passages": passages, "I04_assigned_openings": assigned_openings,
    "X01_label_rules": label_rules, "I03_envelope_gaps": envelope_gaps, "J07_labels_in_spaces": containing_space, "J21_origin_options": origin_options, "U04_destination_options": destination_options,
    "A01_diagnostics": diagnostics, "X12_proposal_summary": proposal_summary, "A04_stroke_mode": stroke_mode, "A05_otsu": otsu, "R01_dark_pixels": dark_pixels, "A06_stroke_threshold": stroke_threshold, "F02_stroke_roles": stroke_roles,
    "F01_wall_fills": wall_fills, "A03_pixel_groups": pixel_groups, "A12_group_overlap": group_overlap, "A10_face_spread": face_spread, "R08_accepted_groups": accepted_groups, "P18_shape_features": shape_features, "S25_fitted_images": fitted_images, "V04_principal_angles": principal_angles, "U01_pixel_sets": pixel_sets,
    "U08_deleted_nodes": deleted_nodes, "T01_catalog_list": catalog_list, "S06_catalog_upsert": catalog_upsert, "S04_upload_names": upload_names,
    "T03_nearest_candidates": nearest_candidates, "T04_thinned_paths": thinned_paths, "U02_ordered_polygons": ordered_polygons, "F13_fitting_openings": fitting_openings, "A08_largest_spaces": largest_spaces,
    "J09_opening_sides": opening_sides, "T08_opening_sources": opening_sources, "W07_path_lengths": path_lengths,
}

ORACLES = {
    "P03_edge_measures": duck("""WITH f AS (SELECT floor, CASE WHEN floor % 6 = 0 THEN 0.0 WHEN floor % 6 <> 1 THEN ppm END AS ppm FROM fx_floor), p AS (SELECT e.floor, from_node, to_node, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, f.ppm, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS px
FROM fx_edge e JOIN fx_node a ON a.floor=e.floor AND a.node=e.from_node JOIN fx_node b ON b.floor=e.floor AND b.node=e.to_node JOIN f ON f.floor=e.floor)
SELECT floor, from_node, to_node, round(px, 6) AS px, round(px / nullif(ppm, 0), 6) AS measured, round(coalesce(px / nullif(ppm, 0), px), 6) AS metres, CASE WHEN from_node % 4 - 1 > 0 AND px >= 1 THEN round(px / (from_node % 4 - 1), 6) END AS calibrated,
 CASE WHEN from_node % 4 - 1 <= 0 THEN 'distance must be positive' WHEN px < 1 THEN 'points coincide' END AS error, round((bx-ax)*(300-ay)-(b_y-ay)*(500-ax), 3) AS turn FROM p""", "fx_floor", "fx_edge"),
    "P07_point_measures": duck("SELECT node, round(greatest(0.0, least(800.0, x - 100)), 6)::DOUBLE AS cx, round(x/1009*0.2126 + y/757*0.7152 + 0.5::DOUBLE*0.0722, 6) AS ink, abs(x-500) <= 200 AND abs(y-300) <= 200 AS close, round(x - 3, 6) AS sx, round(y + 4, 6) AS ey, round_even(x * 0.5, 0)::INT AS half, round(x * 3 / 4, 6) AS m FROM fx_node", "fx_node"),
    "P12_curve_points": duck("""WITH q AS (SELECT wall, i, (1-t)*(1-t)*(1-t)*sx + 3*(1-t)*(1-t)*t*sx + 3*(1-t)*t*t*ex + t*t*t*ex AS x, (1-t)*(1-t)*(1-t)*sy + 3*(1-t)*(1-t)*t*ey + 3*(1-t)*t*t*sy + t*t*t*ey AS y FROM (SELECT *, i / 12.0::DOUBLE AS t FROM fx_wall, unnest(range(13)) u(i))),
l AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM q WINDOW w AS (PARTITION BY wall ORDER BY i))
SELECT wall, count(*)::INT AS n, round(max(x) FILTER (i = 3), 4) AS x3, round(max(y) FILTER (i = 6), 4) AS y6, round(sum(s), 3) AS length FROM l GROUP BY 1""", "fx_wall"),
    "P19_vertical_costs": duck("WITH c AS (SELECT src_floor, dst_floor, CASE WHEN src_floor % 5 = 0 THEN 'escalator' ELSE kind END AS kind FROM fx_connector) SELECT *, CASE kind WHEN 'elevator' THEN 6.0 WHEN 'stairs' THEN 10.0 WHEN 'ramp' THEN 12.0 ELSE 10.0 END::DOUBLE AS metres, kind <> 'stairs' AS accessible FROM c", "fx_connector"),
    "P14_scales": duck("SELECT floor, round(coalesce(CASE WHEN floor % 3 = 0 THEN ppm END, CASE WHEN floor % 3 <> 1 AND floor % 4 = 2 THEN 33.0 END, least(greatest(floor * 0.9 / 0.2, 8.0), 400.0))::DOUBLE, 6) AS ppm, CASE WHEN floor % 3 = 0 THEN 'calibrated' WHEN floor % 3 <> 1 AND floor % 4 = 2 THEN 'vector' ELSE 'estimated' END AS source FROM fx_floor", "fx_floor"),
    "W01_proposed_nodes": duck("WITH n AS (SELECT floor, node, ord, CASE WHEN node % 17 = 0 THEN 'waypoint' ELSE kind END AS kind, CASE WHEN node % 3 = 0 THEN label WHEN node % 3 = 1 THEN '  ' END AS label FROM fx_node) SELECT floor, node, kind, CASE WHEN trim(coalesce(label, '')) <> '' THEN trim(label) ELSE CASE kind WHEN 'decision' THEN 'G' WHEN 'waypoint' THEN 'N' WHEN 'door' THEN 'P' WHEN 'entrance' THEN 'E' WHEN 'room' THEN 'S' ELSE 'C' END || row_number() OVER (PARTITION BY floor, kind ORDER BY ord) END AS label FROM n", "fx_node"),
    "W02_proposed_edges": duck(f"WITH {_PROP} SELECT floor, from_node, to_node, kind FROM e2 e WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.floor=e.floor AND h.from_node=e.from_node AND h.to_node=e.to_node)", "fx_edge", "fx_wall"),
    "J04_rejected_edges": duck(f"WITH {_PROP} SELECT floor, count(*) AS rejected FROM hit GROUP BY 1", "fx_edge", "fx_wall"),
    "M12_proposal_rules": duck("WITH n AS (SELECT floor, count(*) AS n FROM fx_node WHERE floor % 3 <> 0 OR node < 50 GROUP BY 1), e AS (SELECT floor, count(*) AS e FROM fx_edge WHERE floor % 4 <> 1 GROUP BY 1) SELECT f.floor, CASE WHEN coalesce(n, 0) < 2 THEN 'too-few-nodes' ELSE 'no-edges' END AS rule, f.floor::VARCHAR AS subject FROM fx_floor f LEFT JOIN n USING (floor) LEFT JOIN e USING (floor) WHERE coalesce(n, 0) < 2 OR coalesce(e, 0) < 1", "fx_floor", "fx_edge"),
    "V15_ring_segments": duck("""WITH s AS (SELECT floor, wall, r, i, x0, y0, x1, y1 FROM (SELECT floor, wall, 0 AS r, unnest([{'i':0,'x0':sx,'y0':sy,'x1':ex,'y1':sy},{'i':1,'x0':ex,'y0':sy,'x1':ex,'y1':ey},{'i':2,'x0':ex,'y0':ey,'x1':sx,'y1':ey},{'i':3,'x0':sx,'y0':ey,'x1':sx,'y1':sy}], recursive := true) FROM fx_wall)),
k AS (SELECT *, [round_even(x0/2,0), round_even(y0/2,0), round_even(x1/2,0), round_even(y1/2,0)] AS a, [round_even(x1/2,0), round_even(y1/2,0), round_even(x0/2,0), round_even(y0/2,0)] AS b FROM s WHERE sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) >= 2),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY floor, least(a, b) ORDER BY wall, r, i) = 1), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY floor ORDER BY wall, r, i) <= 4000)
SELECT floor, count(*) AS n, round(sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))), 3) AS length FROM m GROUP BY 1""", "fx_wall"),
    "J13_nearest_nodes": duck("SELECT p.floor, p.poi, n.node, round(sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)), 6) AS distance FROM fx_poi p JOIN fx_node n ON n.floor=p.floor QUALIFY row_number() OVER (PARTITION BY p.floor, p.poi ORDER BY sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)), n.ord) = 1", "fx_poi", "fx_node"),
    "J14_near_nodes": duck("SELECT p.floor, p.poi, n.node FROM fx_poi p JOIN fx_node n ON n.floor=p.floor WHERE sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)) < 60 QUALIFY row_number() OVER (PARTITION BY p.floor, p.poi ORDER BY sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)), n.ord) = 1", "fx_poi", "fx_node"),
    "G20_reattached_places": duck("""WITH d AS (SELECT p.floor, p.poi, n.node, n.kind, n.ord, sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)) AS d FROM fx_poi p JOIN fx_node n ON n.floor=p.floor), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY floor, poi ORDER BY d, ord) = 1),
c AS (SELECT * FROM d WHERE kind IN ('room','connector') QUALIFY row_number() OVER (PARTITION BY floor, poi ORDER BY d, ord) = 1) SELECT a.floor, a.poi, CASE WHEN c.d <= 2.5 * greatest(a.d, 1.0) THEN c.node ELSE a.node END AS node FROM a LEFT JOIN c ON c.floor=a.floor AND c.poi=a.poi""", "fx_poi", "fx_node"),
    "G20_proposal": duck(f"WITH {_G20} SELECT * FROM rf", *_G20_V),
    "G20_proposal_edges": duck(f"WITH {_G20} SELECT floor, from_node, to_node, 'corridor' AS kind FROM e3 WHERE NOT hit AND floor IN (SELECT floor FROM rf WHERE refused IS NULL)", *_G20_V),
    "G20_proposal_places": duck(f"""WITH {_G20}, d AS (SELECT p.floor, p.poi, n.node, n.kind, n.ord, sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)) AS d FROM fx_poi p JOIN n ON n.floor=p.floor WHERE p.floor IN (SELECT floor FROM rf WHERE refused IS NULL)), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY floor, poi ORDER BY d, ord) = 1),
c AS (SELECT * FROM d WHERE kind IN ('room','connector') QUALIFY row_number() OVER (PARTITION BY floor, poi ORDER BY d, ord) = 1) SELECT a.floor, a.poi, CASE WHEN c.d <= 2.5 * greatest(a.d, 1.0) THEN c.node ELSE a.node END AS node FROM a LEFT JOIN c ON c.floor=a.floor AND c.poi=a.poi""", *_G20_V),
    "R06_tile_blend": duck("""WITH g AS (SELECT floor, px, py, min(gray) AS gray FROM fx_pixel GROUP BY 1, 2, 3), t AS (SELECT floor, px, py, gray, px // 8 * 8 - 8 * i AS x0, py // 8 * 8 - 8 * j AS y0 FROM g, unnest(range(2)) a(i), unnest(range(2)) b(j)),
c AS (SELECT floor, k AS class, px, py, (gray * (k + 1) + x0 * 3 + y0 * 5) % 101 / 100.0::DOUBLE AS v, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (px - x0) / 15)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (py - y0) / 15)) + 0.001::DOUBLE AS w FROM t, unnest(range(3)) u(k)),
m AS (SELECT floor, class, px, py, sum(v * w) / sum(w) AS v FROM c GROUP BY 1, 2, 3, 4) SELECT floor, class, count(*) AS n, round(sum(v), 4) AS total FROM m GROUP BY 1, 2""", "fx_pixel"),
    "I06_classified_spaces": duck(f"WITH {_CLS} SELECT floor, space, kind, connector_kind, doors, round(confidence, 6) AS confidence FROM cls", "fx_space", "fx_opening"),
    "I08_passages": duck(f"WITH {_CLS}, k AS (SELECT sd.floor, sd.opening, min(cls.kind) AS a, max(cls.kind) AS b FROM sd JOIN cls ON cls.floor=sd.floor AND cls.space=sd.space GROUP BY 1, 2) SELECT o.floor, o.opening, CASE WHEN o.kind='door' AND k.a='circulation' AND k.b='circulation' THEN 'passage' ELSE o.kind END AS kind FROM fx_opening o LEFT JOIN k ON k.floor=o.floor AND k.opening=o.opening", "fx_space", "fx_opening"),
    "I04_assigned_openings": duck("""WITH o AS (SELECT floor, opening, CASE WHEN opening % 5 = 0 THEN 'exterior' WHEN opening % 7 <> 0 THEN space_a::VARCHAR END AS a, CASE WHEN opening % 11 = 0 THEN 'exterior' WHEN opening % 13 <> 0 THEN coalesce(space_b, space_a)::VARCHAR END AS b, opening % 3 = 0 AS drawn FROM fx_opening),
q AS (SELECT *, coalesce(a = 'exterior', FALSE) OR coalesce(b = 'exterior', FALSE) AS outside, CASE WHEN a = 'exterior' THEN b WHEN b = 'exterior' THEN a END AS inn FROM o)
SELECT floor, opening, CASE WHEN a IS NOT DISTINCT FROM b THEN 'dropped' WHEN outside AND inn IS NULL THEN 'dropped' WHEN outside AND NOT drawn THEN 'glass' WHEN outside THEN 'entrance' WHEN a IS NULL OR b IS NULL THEN 'dropped' ELSE 'door' END AS verdict, CASE WHEN outside THEN inn ELSE a END AS space_a, CASE WHEN NOT outside THEN b END AS space_b FROM q""", "fx_opening"),
    "X01_label_rules": duck(f"SELECT space, regexp_matches(label, '{_CIRC}') AS circulation, {_VERT} AS vertical, regexp_matches(label, '{_VOID}') AS void, round(1000/25.4::DOUBLE*72 / nullif(regexp_extract(label, '(?i)(?:escala|scale)\\s*[:=]?\\s*1\\s*[:/]\\s*(\\d{{2,4}})', 1), '')::DOUBLE * 2, 6) AS ppm, trim(regexp_replace('  ' || label || ' ' || chr(9) || ' x ', '\\s+', ' ', 'g')) AS squeezed FROM fx_space", "fx_space"),
    "I03_envelope_gaps": duck("WITH o AS (SELECT floor, opening AS contact, width, 60.0 + space_a % 90 AS perimeter, opening % 4 = 0 AS tb, opening % 3 AS ev, sum(width) OVER (PARTITION BY floor, space_a) AS s FROM fx_opening) SELECT floor, contact, s > 0.5 * perimeter AS void, CASE WHEN width / 10 < 0.5 THEN 'none' WHEN width / 10 > CASE WHEN tb OR ev > 0 THEN 6.0 ELSE 3.0 END THEN 'glass' WHEN s > 0.5 * perimeter THEN 'none' ELSE 'entrance' END AS verdict FROM o", "fx_opening"),
    "J07_labels_in_spaces": duck("WITH h AS (SELECT n.floor, n.node, n.label, w.wall FROM fx_node n JOIN fx_wall w ON w.floor=n.floor WHERE abs(n.x - sx - 0.25) / 80 + abs(n.y - sy - 0.5) / 60 < 1 QUALIFY row_number() OVER (PARTITION BY n.floor, n.node ORDER BY w.wall) = 1) SELECT floor, wall AS space, string_agg(label, ' ' ORDER BY node) AS label FROM h GROUP BY 1, 2", "fx_node", "fx_wall"),
    "J21_origin_options": duck("""WITH q AS (SELECT floor, floor(node / 5) * 5 % 1500 AS node, label, 0 AS rank, qr AS ord FROM fx_qr), p AS (SELECT floor, node, CASE WHEN poi % 2 = 0 THEN 'Punto' ELSE name END AS label, 1 AS rank, poi AS ord FROM fx_poi), e AS (SELECT floor, node, label, 2 AS rank, ord FROM fx_node WHERE kind='entrance'),
u AS (SELECT * FROM q UNION ALL SELECT * FROM p UNION ALL SELECT * FROM e), o AS (SELECT * FROM u WHERE EXISTS (SELECT 1 FROM fx_node n WHERE n.floor=u.floor AND n.node=u.node) QUALIFY row_number() OVER (PARTITION BY floor, node, label ORDER BY rank, ord) = 1)
SELECT o.floor, o.floor || '::' || o.node::BIGINT AS value, label, f.building || ' · ' || f.floor_label || ' · ' || CASE rank WHEN 0 THEN 'QR' WHEN 1 THEN 'punto' ELSE 'entrada' END AS detail FROM o JOIN fx_floor f ON f.floor=o.floor""", "fx_floor", "fx_node", "fx_qr", "fx_poi"),
    "U04_destination_options": duck("SELECT p.floor, p.floor || '::' || node AS value, name AS label, building || ' · ' || floor_label AS detail FROM fx_poi p JOIN fx_floor f ON f.floor=p.floor", "fx_floor", "fx_poi"),
    "A01_diagnostics": duck(f"WITH {_CLS}, {_DIAG} SELECT * FROM d", "fx_floor", "fx_space", "fx_opening", "fx_edge"),
    "X12_proposal_summary": duck(f"""WITH {_CLS}, {_DIAG} SELECT floor, 'Propuesta creada: ' || nodes || ' nodos y ' || edges || ' conexiones, ' || spaces || ' espacios, ' || doors || ' puertas, ' || entrances || ' entradas. ' ||
CASE WHEN floor % 3 > 0 THEN floor % 3 || ' errores de validación: corrígelos antes de guardar.' WHEN floor % 2 > 0 THEN floor % 2 || ' avisos de validación para revisar.' ELSE 'Validación correcta.' END ||
CASE WHEN floor % 4 <> 1 AND floor % 5 <> 0 THEN ' Escala estimada: ' || printf('%.1f', round(floor * 1.25::DOUBLE + 1e-9, 1)) || ' px/m (calibra para confirmarla).' ELSE '' END || ' Revisa y edita antes de guardar.' AS sentence FROM d""", "fx_floor", "fx_space", "fx_opening", "fx_edge"),
    "A04_stroke_mode": duck("WITH l AS (SELECT floor, min(thickness) AS low FROM fx_pixel WHERE thickness > 0 GROUP BY 1), b AS (SELECT p.floor, low + floor(thickness - low) AS edge, count(*) AS n FROM fx_pixel p JOIN l USING (floor) WHERE thickness > 0 GROUP BY 1, 2) SELECT floor, round(edge + 0.5, 6) AS mode FROM b QUALIFY row_number() OVER (PARTITION BY floor ORDER BY n * edge DESC, edge) = 1", "fx_pixel"),
    "A05_otsu": duck(f"WITH {_HIST} SELECT floor, threshold FROM ot", "fx_pixel"),
    "R01_dark_pixels": duck(f"WITH {_HIST} SELECT p.floor, count(*) AS n, max(gray) AS most FROM fx_pixel p JOIN ot ON ot.floor=p.floor WHERE gray < greatest(least(threshold, 110), 40) GROUP BY 1", "fx_pixel"),
    "A06_stroke_threshold": duck(f"WITH {_INK}, {_THR} SELECT floor, round(threshold, 6) AS threshold FROM th", "fx_stroke"),
    "F02_stroke_roles": duck(f"WITH {_INK}, {_THR} SELECT i.floor, ord, CASE WHEN ink < 0.55 AND width >= 2 AND width >= coalesce(threshold, 2) THEN 'wall' WHEN ink > 0.85 AND width >= 0.5 * coalesce(threshold, 2) THEN 'erase' END AS role, round(len, 6) AS length FROM i LEFT JOIN th ON th.floor=i.floor", "fx_stroke"),
    "F01_wall_fills": duck(f"WITH {_INK} SELECT floor, ord FROM i WHERE ink < 0.55 AND abs(x1-x0)*abs(y1-y0) < 60000 AND n_points >= 3", "fx_stroke"),
    "A03_pixel_groups": duck(f"WITH {_DARK} SELECT floor, component, count(*) AS area, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy FROM gr GROUP BY 1, 2 HAVING count(*) >= 2", "fx_pixel", recursive=True),
    "A12_group_overlap": duck(f"WITH {_DARK} SELECT floor, component, round(avg((py % 3 = 0)::INT), 6) AS overlap, round(avg(probability), 6) AS probability FROM gr GROUP BY 1, 2", "fx_pixel", recursive=True),
    "R08_accepted_groups": duck(f"WITH {_DARK}, g AS (SELECT floor, component, count(*) AS area, avg((py % 5 = 0 AND px % 3 = 0 AND floor % 4 <> 1)::INT) AS o, max(px) - min(px) + 1 AS w, max(py) - min(py) + 1 AS h FROM gr GROUP BY 1, 2) SELECT floor, component, area FROM g QUALIFY o >= 0.2 OR (area <= pow(0.9 * (3 + component % 6), 2) AND greatest(w, h) <= 3 * least(w, h)) OR max(o) OVER (PARTITION BY floor) = 0", "fx_pixel", recursive=True),
    "P18_shape_features": duck("SELECT floor, space, round(narrowness * 20 / greatest(sqrt(area), 1), 6) AS narrowness, round(elongation * 7 / greatest(space % 9 / 2, 1), 6) AS elongation FROM fx_space", "fx_space"),
    "S25_fitted_images": "SELECT p_partkey, round(least(1.0::DOUBLE, 4096 / greatest(p_partkey * 37 % 9000 + 1, p_partkey * 53 % 6000 + 1)::DOUBLE), 9) AS factor FROM part",
    "A10_face_spread": duck("SELECT floor, px % 5 AS gap, round(quantile_cont(thickness, 0.02::DOUBLE), 6) AS low, round(quantile_cont(thickness, 0.5::DOUBLE), 6) AS middle, round(quantile_cont(thickness, 0.98::DOUBLE), 6) AS high FROM fx_pixel GROUP BY 1, 2", "fx_pixel"),
    "V04_principal_angles": duck("SELECT cluster, round(CASE WHEN count(*) >= 3 AND var_pop(x) + var_pop(y) > 0 THEN 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) END, 5) AS angle FROM fx_point GROUP BY 1", "fx_point"),
    "U01_pixel_sets": duck("WITH a AS (SELECT DISTINCT floor, px, py FROM fx_pixel WHERE gray < 60), b AS (SELECT DISTINCT floor, px, py FROM fx_pixel WHERE gray % 2 = 0) SELECT floor, count(*) AS n, 'union' AS what FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1 UNION ALL SELECT floor, count(*), 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1 UNION ALL SELECT floor, count(*), 'only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1", "fx_pixel"),
    "U08_deleted_nodes": duck("""WITH g AS (SELECT floor, node FROM fx_node WHERE node % 7 = 0) SELECT floor, what, count(*) AS n FROM (SELECT floor, 'poi' AS what FROM fx_poi p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.floor=p.floor AND g.node=p.node) UNION ALL SELECT floor, 'anchor' FROM fx_qr p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.floor=p.floor AND g.node=p.node)
UNION ALL SELECT floor, 'edge' FROM fx_edge e WHERE from_node % 7 <> 0 AND to_node % 7 <> 0 UNION ALL SELECT src_floor, 'connector' FROM fx_connector WHERE src_node % 7 <> 0) GROUP BY 1, 2""", "fx_node", "fx_poi", "fx_qr", "fx_edge", "fx_connector"),
    "T01_catalog_list": "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC",
    "S06_catalog_upsert": "WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1000000 END AS id, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 5 = 0) SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, v FROM n",
    "S04_upload_names": """WITH p AS (SELECT *, ['a/','../','','b/../','/','./'][p_partkey % 6 + 1] || 'plan' || p_partkey || ['.PDF','.svg','','.tar.gz','.Jpeg'][p_partkey % 5 + 1] AS n FROM part)
SELECT p_partkey, lower(regexp_extract(n, '(\\.[^./\\\\]+)$', 1)) AS suffix, p_partkey % 6 NOT IN (1, 4) AS inside, 'http://a|' || trim(p_brand) || '|b' AS origins, 'f' || p_partkey AS floor_token, lower(trim(' ' || p_brand || ' ')) AS code, printf('%.1f', p_retailprice) AS price FROM p""",
    "T03_nearest_candidates": duck("SELECT p.floor, poi, row_number() OVER w::INT AS place, n.node, round(sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)), 6) AS distance FROM fx_poi p JOIN fx_node n ON n.floor=p.floor WINDOW w AS (PARTITION BY p.floor, poi ORDER BY sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)), n.ord) QUALIFY row_number() OVER w <= 20", "fx_poi", "fx_node"),
    "T04_thinned_paths": duck("WITH k AS (SELECT floor, node, row_number() OVER (PARTITION BY floor ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY floor) AS n FROM fx_node) SELECT floor, node FROM k WHERE i % greatest(1, n // 12) = 0", "fx_node"),
    "U02_ordered_polygons": duck("WITH u AS (SELECT floor, 'wall' AS kind, wall AS ord, 0 AS r FROM fx_wall UNION ALL SELECT floor, 'obstacle', poi, 1 FROM fx_poi WHERE poi % 7 = 0 UNION ALL SELECT floor, 'window', poi, 2 FROM fx_poi WHERE poi % 11 = 0) SELECT floor, kind, ord, row_number() OVER (PARTITION BY floor ORDER BY r, ord)::INT AS n FROM u", "fx_wall", "fx_poi"),
    "F13_fitting_openings": duck("SELECT floor, opening FROM fx_opening WHERE width BETWEEN 0.55 * 12 AND 3.0 * 12 AND opening % 14 BETWEEN 1 AND 0.9 * 12", "fx_opening"),
    "A08_largest_spaces": duck("SELECT floor, space FROM fx_space QUALIFY row_number() OVER (PARTITION BY floor ORDER BY area DESC, ord) = 1", "fx_space"),
    "J09_opening_sides": duck("WITH s AS (SELECT floor, space, CASE WHEN is_void THEN 'void' ELSE 'room' END AS k FROM fx_space) SELECT o.floor, o.opening, a.k AS kind_a, b.k AS kind_b FROM fx_opening o LEFT JOIN s a ON a.floor=o.floor AND a.space=o.space_a LEFT JOIN s b ON b.floor=o.floor AND b.space=o.space_b", "fx_opening", "fx_space"),
    "T08_opening_sources": duck("SELECT floor, opening, 'gap' || CASE WHEN opening % 3 = 0 THEN '+ml' ELSE '' END || CASE WHEN opening % 2 = 0 THEN '+swing' ELSE '' END AS sources FROM fx_opening", "fx_opening"),
    "W07_path_lengths": duck("SELECT floor, round(sum(d), 4) AS length FROM (SELECT floor, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM fx_node WINDOW w AS (PARTITION BY floor ORDER BY ord)) GROUP BY 1", "fx_node"),
}
