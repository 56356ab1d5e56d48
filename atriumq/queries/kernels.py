"""Bitmap operators on the pixel tables of all floors, with DuckDB twins that do the same pixel by pixel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.bitmap import fields, rings, runs
from atriumq.checkpoint import kept
from atriumq.fixtures import duck, view
from atriumq.operators import measures

#: The frame that the pixels of fx_pixel lie in.
WIDTH, HEIGHT = 200, 150


def _dark(spark, d, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels darker than ``most``, their runs, and the frames of their floors."""
    px = kept(view(spark, d, "fx_pixel").where(F.col("gray") < most).select("floor", "px", "py").distinct(), "pixels")
    return px, kept(runs.runs(px), "runs"), px.select("floor").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def _told(parts: dict[str, tuple[DataFrame, object]]) -> DataFrame:
    """(floor, kernel, value): an aggregate of each table by floor."""
    rows = [df.groupBy("floor").agg(value.cast("double").alias("value")).select("floor", F.lit(name).alias("kernel"), "value") for name, (df, value) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def mask_kernels(spark, d):
    """Growing, closing, lines, groups, outlines and distances of the dark pixels of every floor."""
    px, rows, frames = _dark(spark, d, 60)
    pixels = F.sum(F.col("x1") - F.col("x0") + 1)
    groups = kept(runs.group_boxes(runs.labelled(rows)), "groups")
    edges = rings.closed_edges(kept(rings.rings(px).withColumns({"x": F.col("x") - 0.5, "y": F.col("y") - 0.5}), "rings"))
    free = fields.distances(runs.complement(rows, frames), frames)
    return _told({
        "dilated": (runs.dilated(rows, 2, 2, frames), pixels),
        "closed": (runs.eroded(runs.dilated(rows, 1, 1, frames), 1, 1, frames), pixels),
        "lined": (runs.dilated(rows, 3, 0, frames), pixels),
        "upright": (runs.dilated(rows, 0, 4, frames), pixels),
        "groups": (groups, F.count("*")),
        "largest": (groups, F.max("area")),
        "outlined": (rings.areas(edges), F.sum("area")),
        "filled": (rings.filled(edges, width=WIDTH, height=HEIGHT), pixels),
        "distance": (free, F.round(F.sum("distance"), 3)),
    })


def gray_kernels(spark, d):
    """The threshold that parts a floor's grays, and the pixels that count as ink."""
    px = view(spark, d, "fx_pixel").select("floor", "gray")
    return _told({"otsu": (measures.otsu(px), F.max("threshold")), "ink": (measures.dark_pixels(px), F.count("*"))})


def group_rules(spark, d):
    """Pixels of groups that are compact, that overlap another mask by a fifth, and what a percentile of each group says."""
    _, rows, _ = _dark(spark, d, 90)
    px = runs.pixels_of(runs.labelled(rows), "component")
    g = px.groupBy("floor", "component").agg(
        F.count("*").alias("n"), (F.max("px") - F.min("px") + 1).alias("w"), (F.max("py") - F.min("py") + 1).alias("h"),
        F.count_if((F.col("py") + 2 * F.col("px")) % 3 == 0).alias("o"), F.percentile(F.col("px").cast("double"), 0.5).alias("median"), F.percentile(F.col("py").cast("double"), 0.02).alias("low"),
    )
    g = kept(g, "groups")
    of = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0))
    return _told({
        "compact": (g, of((F.col("n") <= 30) & (F.greatest("w", "h") <= 3 * F.least("w", "h")))),
        "overlapping": (g, of(F.col("o") >= 0.4 * F.col("n"))),
        "widest": (g, F.max(F.greatest("w", "h"))),
        "median": (g, F.round(F.sum("median"), 4)),
        "low": (g, F.round(F.sum("low"), 4)),
    })


def drawn_swings(spark, d):
    """Share of a door's arc drawn beside openings at the nodes of every floor: pixels in a box on either side, over the arc's length."""
    thin = view(spark, d, "fx_pixel").where("gray < 140").select("floor", "px", "py").distinct()
    n = view(spark, d, "fx_node").join(thin.select("floor").distinct(), "floor")
    wide, level = F.col("node") % 9 * 2.0 + 6, (F.col("node") % 2 == 0).cast("double")
    at = n.select("floor", "node", (F.col("x") % WIDTH).alias("x"), (F.col("y") % HEIGHT).alias("y"), wide.alias("w"), level.alias("nx"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    far = F.col("w") / 2 + 1
    at = at.withColumns({"cx": F.col("x") + F.col("side") * F.col("nx") * far, "cy": F.col("y") + F.col("side") * (1 - F.col("nx")) * far})
    clip = lambda c, most: F.floor(F.greatest(F.lit(0.0), F.least(c, F.lit(float(most))))).cast("long")
    half = F.col("w") / 2
    box = at.select("floor", "node", "side", "w", clip(F.col("cx") - half, WIDTH).alias("x0"), clip(F.col("cx") + half, WIDTH).alias("x1"), clip(F.col("cy") - half, HEIGHT).alias("y0"), clip(F.col("cy") + half, HEIGHT).alias("y1"))
    share = F.max(F.col("n") / (1.6 * F.col("w")))
    out = runs.inked(box, thin, ("node", "side", "w")).groupBy("floor", "node").agg(share.alias("share"))
    return out.select("floor", "node", F.when(F.col("share") >= 0.5, F.round("share", 6)).otherwise(0.0).alias("share"))


_LAB = """lab(floor, x, y, c) USING KEY (floor, x, y) AS (SELECT floor, px, py, py * 200 + px FROM m UNION
  SELECT m.floor, m.px, m.py, min(l.c) FROM lab l, unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j) JOIN m ON m.floor = l.floor AND m.px = l.x + i AND m.py = l.y + j JOIN recurring.lab r ON r.floor = m.floor AND r.x = m.px AND r.y = m.py WHERE l.c < r.c GROUP BY 1, 2, 3)"""
_M = "m AS (SELECT DISTINCT floor, px, py FROM fx_pixel WHERE gray < {})"
_GROWN = "{} AS (SELECT DISTINCT floor, px + i AS x, py + j AS y FROM m, unnest(range(-{}, {} + 1)) a(i), unnest(range(-{}, {} + 1)) b(j) WHERE px + i BETWEEN 0 AND 199 AND py + j BETWEEN 0 AND 149)"


def _grown(name: str, x: int, y: int) -> str:
    return _GROWN.format(name, x, x, y, y)


QUERIES = {"R11_mask_kernels": mask_kernels, "R01_gray_kernels": gray_kernels, "R08_group_rules": group_rules, "R19_drawn_swings": drawn_swings}

ORACLES = {
    "R11_mask_kernels": duck(f"""WITH {_M.format(60)}, {_grown("d2", 2, 2)}, {_grown("d1", 1, 1)}, {_grown("dx", 3, 0)}, {_grown("dy", 0, 4)}, {_LAB},
cl AS (SELECT p.floor, p.x, p.y FROM d1 p, unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j) JOIN d1 q ON q.floor = p.floor AND q.x = p.x + i AND q.y = p.y + j GROUP BY 1, 2, 3 HAVING count(*) = (least(p.x + 1, 199) - greatest(p.x - 1, 0) + 1) * (least(p.y + 1, 149) - greatest(p.y - 1, 0) + 1)),
gr AS (SELECT floor, c, count(*) AS n FROM lab GROUP BY 1, 2), fr AS (SELECT f.floor, x, y FROM (SELECT DISTINCT floor FROM m) f, unnest(range(200)) a(x), unnest(range(150)) b(y)),
ds AS (SELECT fr.floor, fr.x, fr.y, min((fr.x - m.px) * (fr.x - m.px) + (fr.y - m.py) * (fr.y - m.py)) AS q FROM fr JOIN m USING (floor) GROUP BY 1, 2, 3)
SELECT floor, 'dilated' AS kernel, count(*)::DOUBLE AS value FROM d2 GROUP BY 1 UNION ALL SELECT floor, 'closed', count(*) FROM cl GROUP BY 1 UNION ALL SELECT floor, 'lined', count(*) FROM dx GROUP BY 1 UNION ALL SELECT floor, 'upright', count(*) FROM dy GROUP BY 1
UNION ALL SELECT floor, 'groups', count(*) FROM gr GROUP BY 1 UNION ALL SELECT floor, 'largest', max(n) FROM gr GROUP BY 1 UNION ALL SELECT floor, 'outlined', count(*) FROM m GROUP BY 1 UNION ALL SELECT floor, 'filled', count(*) FROM m GROUP BY 1
UNION ALL SELECT floor, 'distance', round(sum(sqrt(q)), 3) FROM ds GROUP BY 1""", "fx_pixel", recursive=True),
    "R01_gray_kernels": duck("""WITH h AS (SELECT floor, gray, count(*)::DOUBLE AS n FROM fx_pixel GROUP BY 1, 2), g AS (SELECT floor, v FROM (SELECT DISTINCT floor FROM h), unnest(range(256)) u(v)),
s AS (SELECT g.floor, v, sum(coalesce(n, 0)) OVER w AS a, sum(coalesce(n, 0) * v) OVER w AS b, sum(coalesce(n, 0)) OVER (PARTITION BY g.floor) AS ta, sum(coalesce(n, 0) * v) OVER (PARTITION BY g.floor) AS tb FROM g LEFT JOIN h ON h.floor = g.floor AND h.gray = v WINDOW w AS (PARTITION BY g.floor ORDER BY v)),
o AS (SELECT floor, v FROM s QUALIFY row_number() OVER (PARTITION BY floor ORDER BY round(CASE WHEN a > 0 AND ta > a THEN a * (ta - a) * pow(b / a - (tb - b) / (ta - a), 2) ELSE 0 END / (ta * ta), 9) DESC, v) = 1)
SELECT floor, 'otsu' AS kernel, v::DOUBLE AS value FROM o UNION ALL SELECT o.floor, 'ink', count(*) FILTER (gray < greatest(least(v, 110), 40)) FROM o JOIN fx_pixel p ON p.floor = o.floor GROUP BY 1""", "fx_pixel"),
    "R08_group_rules": duck(f"""WITH {_M.format(90)}, {_LAB}, g AS (SELECT floor, c, count(*) AS n, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) FILTER ((y + 2 * x) % 3 = 0) AS o, quantile_cont(x::DOUBLE, 0.5::DOUBLE) AS md, quantile_cont(y::DOUBLE, 0.02::DOUBLE) AS lo FROM lab GROUP BY 1, 2)
SELECT floor, 'compact' AS kernel, coalesce(sum(n) FILTER (n <= 30 AND greatest(w, h) <= 3 * least(w, h)), 0)::DOUBLE AS value FROM g GROUP BY 1 UNION ALL SELECT floor, 'overlapping', coalesce(sum(n) FILTER (o >= 0.4 * n), 0) FROM g GROUP BY 1
UNION ALL SELECT floor, 'widest', max(greatest(w, h)) FROM g GROUP BY 1 UNION ALL SELECT floor, 'median', round(sum(md), 4) FROM g GROUP BY 1 UNION ALL SELECT floor, 'low', round(sum(lo), 4) FROM g GROUP BY 1""", "fx_pixel", recursive=True),
    "R19_drawn_swings": duck("""WITH t AS (SELECT DISTINCT floor, px, py FROM fx_pixel WHERE gray < 140), o AS (SELECT floor, node, x % 200 AS x, y % 150 AS y, node % 9 * 2 + 6 AS w, (node % 2 = 0)::INT AS nx FROM fx_node WHERE floor IN (SELECT floor FROM t)),
b AS (SELECT floor, node, w, s, w / 2.0::DOUBLE AS h, x + s * nx * (w / 2.0::DOUBLE + 1) AS cx, y + s * (1 - nx) * (w / 2.0::DOUBLE + 1) AS cy FROM o, (VALUES (1), (-1)) v(s)),
q AS (SELECT b.floor, b.node, b.s, any_value(w) AS w, count(t.px) AS n FROM b LEFT JOIN t ON t.floor = b.floor AND t.px >= floor(greatest(0, least(cx - h, 200))) AND t.px < floor(greatest(0, least(cx + h, 200))) AND t.py >= floor(greatest(0, least(cy - h, 150))) AND t.py < floor(greatest(0, least(cy + h, 150))) GROUP BY 1, 2, 3)
SELECT floor, node, CASE WHEN max(n / (1.6::DOUBLE * w)) >= 0.5 THEN round(max(n / (1.6::DOUBLE * w)), 6) ELSE 0.0 END::DOUBLE AS share FROM q GROUP BY 1, 2""", "fx_pixel", "fx_node"),
}
