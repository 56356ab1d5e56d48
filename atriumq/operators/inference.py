"""What spaces and openings are, from their doors, shapes and labels: declarative rules over a floor's rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from atriumq.functions import geometry as g
from atriumq.functions import text as t

from .network import cell_of, in_cells


def shape_features(spaces: DataFrame) -> DataFrame:
    """narrowness and elongation from area, inscribed radius and sides."""
    return spaces.withColumn("narrowness", F.col("radius") / F.greatest(F.sqrt("area"), F.lit(1.0))).withColumn("elongation", F.col("long_side") / F.greatest("short_side", F.lit(1.0)))


#: Labels of a cell that a task holds at once.
MOST_LABELS = 50_000


def _first(left: pa.Table, right: pa.Table) -> pa.Table:
    """The first ring that holds each point, of one cell: rings are tried in their order on the points that none has held yet."""
    x, y = (left.column(c).to_numpy().astype(float) for c in ("x", "y"))
    found, open_ = np.full(len(x), -1, np.int64), np.arange(len(x))
    order = pc.sort_indices(right, sort_keys=[("ord", "ascending"), ("space", "ascending")], null_placement="at_start").to_numpy()
    box = np.stack([right.column(c).to_numpy() for c in ("_x0", "_y0", "_x1", "_y1")], axis=1)
    xs, ys = right.column("_xs").combine_chunks(), right.column("_ys").combine_chunks()
    for k in order.tolist():
        px, py, (x0, y0, x1, y1) = x[open_], y[open_], box[k]
        near = np.flatnonzero((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
        if not len(near):
            continue
        px, py = px[near, None], py[near, None]
        ax, ay = (c[k].values.to_numpy(zero_copy_only=False).astype(float) for c in (xs, ys))
        bx, by = np.roll(ax, -1), np.roll(ay, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            flips = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        held = near[flips.sum(1) % 2 == 1]
        found[open_[held]] = k
        open_ = np.delete(open_, held)
        if not len(open_):
            break
    hit = np.flatnonzero(found >= 0)
    mine, of = left.take(pa.array(hit)), right.take(pa.array(found[hit]))
    return pa.table([mine.column("floor"), mine.column("label_no"), of.column("ord"), of.column("space")], names=["floor", "label_no", "ord", "space"])


def first_containing(labels: DataFrame, polygons: DataFrame) -> DataFrame:
    """(floor, label_no, space): the first space, in their order, whose ring holds the label's point.

    Rings are dealt to the grid cells of their box. A cell tries its rings in order and leaves off once every label has
    one, so pairs of labels and rings are never rows; cells of many labels are dealt in parts of about MOST_LABELS."""
    ends = [F.array_min(F.transform("ring", lambda q: q["x"])), F.array_min(F.transform("ring", lambda q: q["y"])), F.array_max(F.transform("ring", lambda q: q["x"])), F.array_max(F.transform("ring", lambda q: q["y"]))]
    boxed = polygons.where("floor IS NOT NULL").withColumns({k: v.cast("double") for k, v in zip(("_x0", "_y0", "_x1", "_y1"), ends)})
    boxed = boxed.withColumns({"_xs": F.transform("ring", lambda q: q["x"].cast("double")), "_ys": F.transform("ring", lambda q: q["y"].cast("double"))}).select("floor", "ord", "space", "_x0", "_y0", "_x1", "_y1", "_xs", "_ys")
    at = labels.select("floor", "label_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), cell_of(F.col("x")).alias("cx"), cell_of(F.col("y")).alias("cy")).where("floor IS NOT NULL AND cx IS NOT NULL AND cy IS NOT NULL")
    cell = ["floor", "cx", "cy"]
    parts = at.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / MOST_LABELS).cast("int").alias("_parts"))
    left = at.join(parts, cell).withColumn("_part", F.pmod(F.hash("label_no", "x", "y"), F.col("_parts"))).drop("_parts")
    right = in_cells(boxed, ("_x0", "_y0", "_x1", "_y1")).join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    out = [at.schema["floor"], at.schema["label_no"], boxed.schema["ord"], boxed.schema["space"]]
    hit = left.groupBy(*cell, "_part").cogroup(right.groupBy(*cell, "_part")).applyInArrow(_first, StructType([StructField(f.name, f.dataType) for f in out]))
    first = hit.groupBy("floor", "label_no").agg(F.min(F.struct("ord", "space")).alias("s"))
    return first.select("floor", "label_no", "s.space")


def joined_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(floor, space, label): the texts in a space, in the order of the labels."""
    rows = found.join(labels, ["floor", "label_no"]).groupBy("floor", "space").agg(F.sort_array(F.collect_list(F.struct("label_no", "text"))).alias("texts"))
    return rows.select("floor", "space", F.array_join(F.transform("texts", lambda x: x["text"]), " ").alias("label"))


def assigned_openings(openings: DataFrame) -> DataFrame:
    """Openings by what lies on their sides (``exterior``, a space or null) and what drew them.

    Equal sides or an unknown one: dropped. Exterior on one: an entrance if a swing or a model saw a
    door, else glass. Two spaces: a door."""
    a, b = F.col("side_a"), F.col("side_b")
    inner = F.when(a == "exterior", b).when(b == "exterior", a)
    drawn = F.arrays_overlap("sources", F.array(F.lit("swing"), F.lit("ml")))
    outside = F.coalesce(a == "exterior", F.lit(False)) | F.coalesce(b == "exterior", F.lit(False))
    verdict = F.when(a.eqNullSafe(b), "dropped").when(outside & inner.isNull(), "dropped").when(outside & ~drawn, "glass").when(outside, "entrance").when(a.isNull() | b.isNull(), "dropped").otherwise("door")
    return openings.withColumn("verdict", verdict).withColumn("space_a", F.when(outside, inner).otherwise(a)).withColumn("space_b", F.when(~outside, b))


def door_counts(spaces: DataFrame, openings: DataFrame) -> DataFrame:
    """Spaces with how many openings they have and whether one is an entrance."""
    sides = openings.select("floor", "opening", "kind", F.explode(F.array("space_a", "space_b")).alias("space")).where("space IS NOT NULL")
    n = sides.groupBy("floor", "space").agg(F.count("*").alias("doors"), F.max((F.col("kind") == "entrance").cast("int")).alias("entrance"))
    return spaces.join(n, ["floor", "space"], "left").fillna(0, ["doors", "entrance"])


def classified(spaces: DataFrame, openings: DataFrame) -> DataFrame:
    """Spaces with kind, connector_kind and confidence.

    Void and vertical spaces are told by their labels; the rest score as circulation by label, doors
    and shape. A floor without circulation gets its best-connected room as one."""
    floor = Window.partitionBy("floor")
    s = door_counts(spaces, openings).withColumn("most", F.max("doors").over(floor))
    label = F.coalesce("label", F.lit(""))
    vertical = t.vertical_kind(label)
    score = (
        F.when(t.is_circulation(label), 2.0).otherwise(0.0)
        + F.when(F.col("doors") >= 3, 1.5).otherwise(0.0)
        + F.when((F.col("doors") == F.col("most")) & (F.col("doors") >= 2), 0.5).otherwise(0.0)
        + F.when((F.col("elongation") >= 2.5) & (F.col("narrowness") <= 0.3), 1.0).otherwise(0.0)
        + F.when((F.col("entrance") == 1) & (F.col("doors") >= 2), 1.0).otherwise(0.0)
    )
    s = s.withColumn("score", score)
    kind = F.when(F.col("is_void") | t.is_void(label), "void").when(vertical.isNotNull(), "vertical").when(F.col("score") >= 1.5, "circulation").otherwise("room")
    s = s.withColumn("kind", kind).withColumn("connector_kind", F.when(F.col("kind") == "vertical", vertical))
    confidence = F.when(F.col("kind") == "circulation", F.least(F.lit(1.0), 0.5 + F.col("score") / 4)).when(F.col("kind") == "room", F.when(F.col("doors") > 0, 0.7).otherwise(0.4)).when(F.col("is_void"), 0.3).otherwise(0.5)
    s = s.withColumn("confidence", confidence)
    none = F.max((F.col("kind") == "circulation").cast("int")).over(floor) == 0
    best = F.row_number().over(Window.partitionBy("floor", "kind").orderBy(F.desc("doors"), F.desc("area"), "ord")) == 1
    promoted = none & (F.col("kind") == "room") & (F.col("doors") > 0) & best
    s = s.withColumn("promoted", promoted)
    return s.withColumn("kind", F.when(F.col("promoted"), "circulation").otherwise(F.col("kind"))).withColumn("confidence", F.when(F.col("promoted"), 0.4).otherwise(F.col("confidence"))).drop("most", "promoted")


def passages(openings: DataFrame, spaces: DataFrame) -> DataFrame:
    """Openings, doors between circulation alone turned into passages."""
    k = spaces.select("floor", "space", F.col("kind").alias("k"))
    sides = openings.select("floor", "opening", F.explode(F.array("space_a", "space_b")).alias("space")).join(k, ["floor", "space"])
    kinds = sides.groupBy("floor", "opening").agg(F.collect_set("k").alias("kinds"))
    out = openings.join(kinds, ["floor", "opening"], "left")
    only = F.coalesce(F.col("kinds") == F.array(F.lit("circulation")), F.lit(False))
    return out.withColumn("kind", F.when((F.col("kind") == "door") & only, "passage").otherwise(F.col("kind"))).drop("kinds")


def fitting(openings: DataFrame, least: float = 0.55, most: float = 3.0, deepest: float = 0.9) -> DataFrame:
    """Openings as wide as doors are and no deeper than walls, in metres of their floor's scale (width, depth, ppm)."""
    return openings.where((F.col("width") >= least * F.col("ppm")) & (F.col("width") <= most * F.col("ppm")) & (F.col("depth") >= 1) & (F.col("depth") <= deepest * F.col("ppm")))


def largest(df: DataFrame, item: str, size: str = "area") -> DataFrame:
    """(floor, item): the largest of each floor, the first of equals."""
    return df.groupBy("floor").agg(F.min_by(item, F.struct(-F.col(size), F.col("ord"))).alias(item))


def with_space_kinds(openings: DataFrame, spaces: DataFrame) -> DataFrame:
    """Openings with the kinds of the spaces on both sides, null where there is none."""
    k = spaces.select("floor", "space", "kind")
    out = openings.join(k.select("floor", F.col("space").alias("space_a"), F.col("kind").alias("kind_a")), ["floor", "space_a"], "left")
    return out.join(k.select("floor", F.col("space").alias("space_b"), F.col("kind").alias("kind_b")), ["floor", "space_b"], "left")


def merged_sources(df: DataFrame) -> DataFrame:
    """(floor, opening, sources): what drew an opening, from several sightings, sorted."""
    return df.groupBy("floor", "opening").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def entrance_limit(touches_border, evidence) -> F.col:
    """Metres up to which a gap in the envelope counts as an entrance: wider where a door is drawn or the plan is cut."""
    return F.when(touches_border | (evidence > 0), 6.0).otherwise(3.0)


def envelope_gaps(contacts: DataFrame) -> DataFrame:
    """Contacts of spaces with the outside as entrance, glass or nothing, and spaces that are mostly open as void.

    contacts: (floor, space, contact, width, perimeter, ppm, touches_border, evidence)."""
    space = Window.partitionBy("floor", "space")
    void = F.sum("width").over(space) > 0.5 * F.col("perimeter")
    m = F.col("width") / F.col("ppm")
    kind = F.when(m < 0.5, "none").when(m > entrance_limit(F.col("touches_border"), F.col("evidence")), "glass").when(void, "none").otherwise("entrance")
    return contacts.withColumn("void", void).withColumn("verdict", kind)
