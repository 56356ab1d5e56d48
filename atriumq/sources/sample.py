"""The sample clinic that a new installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One calibrated floor, its nodes, walls, places, edges and anchors.
PPM = 20.3
NODES = [
    ("entrada", 145.0, 520.0, "Entrada", "entrance"),
    ("recepcion", 345.0, 520.0, "Recepción", "decision"),
    ("espera", 590.0, 520.0, "Sala de espera", "decision"),
    ("cruce_oeste", 785.0, 520.0, "Cruce central", "decision"),
    ("pasillo_norte", 785.0, 300.0, "Pasillo norte", "decision"),
    ("consultorio_101", 650.0, 300.0, "Acceso C101", "waypoint"),
    ("ascensor", 550.0, 300.0, "Ascensor", "decision"),
    ("escaleras", 435.0, 300.0, "Escaleras", "decision"),
    ("pasillo_norte_este", 1190.0, 300.0, "Pasillo norte este", "decision"),
    ("consultorio_103", 1085.0, 300.0, "Acceso C103", "waypoint"),
    ("banos", 1320.0, 300.0, "Baños", "waypoint"),
    ("pasillo_este", 1190.0, 520.0, "Pasillo este", "decision"),
    ("consultorio_104", 1260.0, 520.0, "Acceso C104", "waypoint"),
    ("pasillo_sur", 785.0, 680.0, "Pasillo sur", "decision"),
    ("laboratorio", 545.0, 680.0, "Laboratorio", "waypoint"),
    ("rayos_x", 750.0, 680.0, "Rayos X", "waypoint"),
    ("farmacia", 1015.0, 680.0, "Farmacia", "waypoint"),
    ("salida", 1300.0, 680.0, "Salida emergencia", "waypoint"),
]
WALLS = [
    (330.0, 30.0, 1220.0, 30.0), (1220.0, 30.0, 1220.0, 345.0), (120.0, 325.0, 120.0, 680.0), (120.0, 680.0, 1450.0, 680.0),
    (810.0, 345.0, 1130.0, 345.0), (1130.0, 345.0, 1130.0, 635.0), (1130.0, 635.0, 810.0, 635.0), (810.0, 635.0, 810.0, 345.0),
]
POIS = [
    ("Recepción", "servicio", 355.0, 535.0, "recepcion"),
    ("Consultorio 101", "consultorio", 730.0, 175.0, "consultorio_101"),
    ("Consultorio 103", "consultorio", 1115.0, 175.0, "consultorio_103"),
    ("Baños de pacientes", "servicio", 1370.0, 180.0, "banos"),
    ("Consultorio 104", "consultorio", 1370.0, 430.0, "consultorio_104"),
    ("Laboratorio", "servicio", 525.0, 770.0, "laboratorio"),
    ("Rayos X", "servicio", 750.0, 770.0, "rayos_x"),
    ("Farmacia", "servicio", 1015.0, 770.0, "farmacia"),
    ("Salida de emergencia", "salida", 1300.0, 770.0, "salida"),
]
EDGES = [
    ("entrada", "recepcion"), ("recepcion", "espera"), ("espera", "cruce_oeste"), ("cruce_oeste", "pasillo_norte"), ("pasillo_norte", "consultorio_101"), ("consultorio_101", "ascensor"),
    ("ascensor", "escaleras"), ("pasillo_norte", "pasillo_norte_este"), ("pasillo_norte_este", "consultorio_103"), ("pasillo_norte_este", "banos"), ("pasillo_norte_este", "pasillo_este"),
    ("cruce_oeste", "pasillo_este"), ("pasillo_este", "consultorio_104"), ("cruce_oeste", "pasillo_sur"), ("pasillo_sur", "laboratorio"), ("pasillo_sur", "rayos_x"), ("pasillo_sur", "farmacia"),
    ("farmacia", "salida"),
]
ANCHORS = [("sample/entrada", "QR Entrada principal", "entrada"), ("sample/ascensor", "QR Ascensor", "ascensor")]


def sample(spark: SparkSession) -> dict[str, DataFrame]:
    """The sample floor as the engine's tables; building 0, floor 1."""
    at = "building int, floor int, "
    return {
        "floors": spark.createDataFrame([(0, 1, "Piso 1", PPM)], at + "floor_label string, ppm double"),
        "nodes": spark.createDataFrame([(0, 1, n, k, x, y, label, kind) for k, (n, x, y, label, kind) in enumerate(NODES)], at + "node string, ord int, x double, y double, label string, kind string"),
        "walls": spark.createDataFrame([(0, 1, k + 1, *w) for k, w in enumerate(WALLS)], at + "wall int, sx double, sy double, ex double, ey double"),
        "pois": spark.createDataFrame([(0, 1, k + 1, *p) for k, p in enumerate(POIS)], at + "poi int, name string, category string, x double, y double, node string"),
        "edges": spark.createDataFrame([(0, 1, k + 1, a, b, "corridor", True) for k, (a, b) in enumerate(EDGES)], at + "ord int, from_node string, to_node string, kind string, accessible boolean"),
        "anchors": spark.createDataFrame([(0, 1, k + 1, *a) for k, a in enumerate(ANCHORS)], at + "qr int, code string, label string, node string"),
        "connectors": spark.createDataFrame([], "src_floor int, src_node string, dst_floor int, dst_node string, kind string, label string, accessible boolean, bidirectional boolean"),
    }
