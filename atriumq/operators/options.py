"""What a visitor can choose from, and how an analysis is summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .proposals import first_of

# What kind of place an origin is, in order of preference.
_ORIGINS = ("QR", "punto", "entrada")


def origins(floors: DataFrame, nodes: DataFrame, anchors: DataFrame, pois: DataFrame) -> DataFrame:
    """(floor, value, label, detail): places to start from at existing nodes; of equal labels at a node the
    first by anchor, place, entrance."""
    parts = [
        anchors.select("floor", "node", "label", F.lit(0).alias("rank"), F.col("qr").cast("long").alias("ord")),
        pois.select("floor", "node", F.col("name").alias("label"), F.lit(1).alias("rank"), F.col("poi").cast("long").alias("ord")),
        nodes.where("kind = 'entrance'").select("floor", "node", "label", F.lit(2).alias("rank"), F.col("ord").cast("long").alias("ord")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(nodes.select("floor", "node"), ["floor", "node"], "left_semi")
    once = first_of(every.withColumn("_at", F.struct("rank", "ord")), ["floor", "node", "label"], "_at").drop("_at")
    names = F.array(*[F.lit(x) for x in _ORIGINS])
    out = once.join(floors.select("floor", "building", "floor_label"), "floor")
    return out.select("floor", token("floor", "node").alias("value"), "label", F.concat_ws(" · ", F.col("building").cast("string"), "floor_label", F.get(names, F.col("rank"))).alias("detail"))


def destinations(floors: DataFrame, pois: DataFrame) -> DataFrame:
    """(floor, value, label, detail): all places, as often as they occur."""
    out = pois.join(floors.select("floor", "building", "floor_label"), "floor")
    return out.select("floor", token("floor", "node").alias("value"), F.col("name").alias("label"), F.concat_ws(" · ", F.col("building").cast("string"), "floor_label").alias("detail"))


def token(floor: str, node: str) -> Column:
    return F.concat(F.col(floor).cast("string"), F.lit("::"), F.col(node).cast("string"))


def diagnostics(floors: DataFrame, **tables: DataFrame) -> DataFrame:
    """(floor, ...) counts of walls, openings, spaces, nodes, edges and labels by kind.

    tables: any of walls(kind), openings(kind), spaces(kind), nodes, edges, labels."""
    counts = {
        "walls": {"walls": F.col("kind") == "wall", "obstacles": F.col("kind") == "obstacle", "windows": F.col("kind") == "window"},
        "openings": {"doors": F.col("kind") != "entrance", "entrances": F.col("kind") == "entrance"},
        "spaces": {"spaces": F.lit(True), "circulation": F.col("kind") == "circulation"},
        "nodes": {"nodes": F.lit(True)},
        "edges": {"edges": F.lit(True)},
        "labels": {"labels": F.lit(True)},
    }
    out = floors.select("floor")
    for name, df in tables.items():
        n = df.groupBy("floor").agg(*[F.count_if(test).alias(c) for c, test in counts[name].items()])
        out = out.join(n, "floor", "left").fillna(0, list(counts[name]))
    return out


def summary(n: DataFrame) -> DataFrame:
    """(floor, sentence) from nodes, edges, spaces, doors, entrances, errors, warnings, ppm and estimated_ppm."""
    s = lambda c: F.col(c).cast("string")
    parts = F.concat(s("nodes"), F.lit(" nodos y "), s("edges"), F.lit(" conexiones, "), s("spaces"), F.lit(" espacios, "), s("doors"), F.lit(" puertas, "), s("entrances"), F.lit(" entradas"))
    state = (
        F.when(F.col("errors") > 0, F.concat(s("errors"), F.lit(" errores de validación: corrígelos antes de guardar.")))
        .when(F.col("warnings") > 0, F.concat(s("warnings"), F.lit(" avisos de validación para revisar.")))
        .otherwise("Validación correcta.")
    )
    known = F.coalesce(F.col("ppm") != 0, F.lit(False))
    scale = F.when(~known & F.coalesce(F.col("estimated_ppm") != 0, F.lit(False)), F.concat(F.lit(" Escala estimada: "), F.format_string("%.1f", "estimated_ppm"), F.lit(" px/m (calibra para confirmarla)."))).otherwise("")
    return n.select("floor", F.concat(F.lit("Propuesta creada: "), parts, F.lit(". "), state, scale, F.lit(" Revisa y edita antes de guardar.")).alias("sentence"))
