"""Map tables derived from the driver's tables, as one SQL text per table.

The same text runs in Spark (with DataFrames for the names in braces) and, as common table
expressions, in DuckDB, so that every query and its twin start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LABEL = """CASE p_partkey % 12 WHEN 0 THEN 'Pasillo norte' WHEN 1 THEN 'Ascensor 2' WHEN 2 THEN 'ESCALERAS' WHEN 3 THEN 'Rampa sur' WHEN 4 THEN 'Patio'
  WHEN 5 THEN 'Consultorio 101' WHEN 6 THEN 'Hall central' WHEN 7 THEN 'Shaft A' WHEN 8 THEN 'Lobby' WHEN 9 THEN 'Laboratorio' WHEN 10 THEN 'Escala 1:100' ELSE '' END"""

VIEWS: dict[str, str] = {
    "fx_floor": "SELECT n_regionkey AS building, n_nationkey AS floor, n_name AS floor_label, CAST(10 + n_nationkey % 5 AS DOUBLE) AS ppm FROM {nation}",
    "fx_node": """SELECT n_regionkey AS building, c_nationkey AS floor, c_custkey AS node, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord, c_name AS label,
  CASE c_custkey % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'waypoint' WHEN 2 THEN 'door' WHEN 3 THEN 'entrance' WHEN 4 THEN 'room' ELSE 'connector' END AS kind,
  CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 757 AS DOUBLE) AS y FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_wall": """SELECT s_nationkey AS floor, s_suppkey AS wall, CAST((s_suppkey * 613) % 1009 AS DOUBLE) AS sx, CAST((s_suppkey * 389) % 757 AS DOUBLE) AS sy,
  CAST((s_suppkey * 613) % 1009 + (s_suppkey * 37) % 25 - 12 AS DOUBLE) AS ex, CAST((s_suppkey * 389) % 757 + (s_suppkey * 53) % 25 - 12 AS DOUBLE) AS ey FROM {supplier}""",
    "fx_edge": """SELECT a.building, a.floor, a.node AS from_node, b.node AS to_node, a.node % 5 <> 0 AS accessible, CASE WHEN b.ord = a.ord + 1 THEN 'corridor' ELSE 'doorway' END AS kind
  FROM {fx_node} a JOIN {fx_node} b ON a.floor = b.floor AND (b.ord = a.ord + 1 OR b.ord = a.ord + 7)""",
    "fx_connector": """SELECT f.floor AS src_floor, f.n0 AS src_node, g.floor AS dst_floor, g.n0 AS dst_node, CASE f.floor % 3 WHEN 0 THEN 'elevator' WHEN 1 THEN 'stairs' ELSE 'ramp' END AS kind,
  f.floor % 3 <> 1 AS accessible, f.floor % 4 <> 0 AS bidirectional
  FROM (SELECT building, floor, MIN(node) AS n0, LEAD(floor) OVER (PARTITION BY building ORDER BY floor) AS nf FROM {fx_node} GROUP BY building, floor) f
  JOIN (SELECT floor, MIN(node) AS n0 FROM {fx_node} GROUP BY floor) g ON f.nf = g.floor""",
    "fx_poi": f"""SELECT CAST(p_partkey % 25 AS INT) AS floor, p_partkey AS poi, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 43 = 0 THEN '' ELSE p_type END AS category,
  CAST((p_partkey * 331) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 577) % 757 AS DOUBLE) AS y, CAST(p_partkey * 3 % (SELECT COUNT(*) + 100 FROM {{customer}}) AS BIGINT) AS node, {_LABEL} AS note FROM {{part}}""",
    "fx_qr": """SELECT CAST(p_partkey % 25 AS INT) AS floor, p_partkey AS qr, CASE WHEN p_partkey % 3 = 0 THEN ' Code-' ELSE 'CODE-' END || CAST(p_partkey % (SELECT CAST(FLOOR(COUNT(*) * 2 / 5) AS BIGINT) FROM {part}) AS STRING) AS code,
  CASE WHEN p_partkey % 53 = 0 THEN '  ' ELSE p_name END AS label, CAST(p_partkey * 5 % (SELECT COUNT(*) + 100 FROM {customer}) AS BIGINT) AS node FROM {part}""",
    "fx_space": f"""SELECT CAST(p_partkey % 25 AS INT) AS floor, p_partkey AS space, ROW_NUMBER() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS ord, {_LABEL} AS label,
  CAST(50 + (p_partkey * 37) % 400 AS DOUBLE) AS area, CAST((p_partkey * 17) % 50 AS DOUBLE) / 100 AS narrowness, 1 + CAST((p_partkey * 29) % 40 AS DOUBLE) / 10 AS elongation, p_partkey % 31 = 0 AS is_void
  FROM {{part}}""",
    "fx_opening": """SELECT CAST(p_partkey % 25 AS INT) AS floor, p_partkey AS opening, p_partkey AS space_a,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 25 + 25 * ((p_partkey * 11) % (SELECT CAST(FLOOR(COUNT(*) / 25) AS BIGINT) FROM {part})) AS BIGINT) END AS space_b, CASE WHEN p_partkey % 9 = 0 THEN 'entrance' ELSE 'door' END AS kind,
  CAST((p_partkey * 13) % 10 AS DOUBLE) / 10 AS confidence, CAST(5 + (p_partkey * 19) % 60 AS DOUBLE) AS width FROM {part}""",
    "fx_pixel": """SELECT CAST(l_orderkey % 25 AS INT) AS floor, CAST((l_orderkey * 7 + l_linenumber * 31) % 200 AS INT) AS px, CAST((l_partkey * 3 + l_linenumber) % 150 AS INT) AS py,
  CAST(CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey * 7) % 90 ELSE 140 + (l_partkey * 11) % 116 END AS INT) AS gray, CAST((l_partkey * 13) % 300 AS DOUBLE) / 10 AS thickness FROM {lineitem}""",
    "fx_ink": """SELECT DISTINCT s.floor, s.x0 + (1 - s.up) * k.n_nationkey AS px, s.y0 + s.up * k.n_nationkey AS py FROM (SELECT CAST(FLOOR(l_orderkey / 250) AS INT) AS floor, CAST((l_partkey * 7 + l_linenumber * 31 + l_orderkey) % 190 AS INT) AS x0,
  CAST((l_suppkey * 13 + l_orderkey * 11 + l_linenumber * 3) % 140 AS INT) AS y0, CAST(l_partkey % 2 AS INT) AS up, CAST(l_partkey * 5 % 9 AS INT) AS more FROM {lineitem}) s JOIN {nation} k ON k.n_nationkey <= s.more""",
    "fx_gate": """SELECT CAST(FLOOR(c_custkey / 25) AS INT) AS floor, c_custkey AS opening, CAST((c_custkey * 7919) % 200 AS DOUBLE) AS cx, CAST((c_custkey * 104729) % 150 AS DOUBLE) AS cy,
  CASE c_custkey % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.0E0 ELSE 0.6E0 END AS nx, CASE c_custkey % 3 WHEN 0 THEN 0.0E0 WHEN 1 THEN 1.0E0 ELSE 0.8E0 END AS ny, CAST(1 + c_custkey % 7 AS DOUBLE) AS depth FROM {customer}""",
    "fx_stroke": """SELECT CAST(l_orderkey % 25 AS INT) AS floor, l_orderkey * 8 + l_linenumber AS ord, CASE l_linenumber % 4 WHEN 0 THEN 'l' WHEN 1 THEN 're' WHEN 2 THEN 'qu' ELSE 'c' END AS item,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST((l_partkey * 31) % 256 AS DOUBLE) / 255 END AS r, CAST((l_partkey * 57) % 256 AS DOUBLE) / 255 AS g, CAST((l_suppkey * 91) % 256 AS DOUBLE) / 255 AS b,
  CAST((l_suppkey * 7) % 60 AS DOUBLE) / 10 AS width, CAST((l_partkey * 19) % 600 AS DOUBLE) AS x0, CAST((l_suppkey * 23) % 400 AS DOUBLE) AS y0,
  CAST((l_partkey * 29) % 600 AS DOUBLE) AS x1, CAST((l_partkey * 37) % 400 AS DOUBLE) AS y1, CAST(3 + l_linenumber % 5 AS INT) AS n_points FROM {lineitem}""",
    "fx_point": """SELECT CAST(label AS INT) AS cluster, vec_id AS point, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM {embeddings}""",
}
#: Where Spark needs another text for the same rows. Its arrays are indexed from 0 in brackets, DuckDB's from 1. A join on one
#: place or another would try all pairs of nodes of a floor, so a node is sent to both places and meets who stands there. Its
#: nulls come first in an order unless told otherwise, DuckDB's last.
_SPARK_TEXT = {
    "fx_node": VIEWS["fx_node"].replace("ORDER BY c_custkey", "ORDER BY c_custkey NULLS LAST"),
    "fx_point": VIEWS["fx_point"].replace("[1]", "[0]").replace("[2]", "[1]"),
    "fx_edge": """SELECT a.building, a.floor, a.node AS from_node, b.node AS to_node, a.node % 5 <> 0 AS accessible, CASE WHEN b.ord = a.ord + 1 THEN 'corridor' ELSE 'doorway' END AS kind
  FROM (SELECT building, floor, node, ord, EXPLODE(ARRAY(ord + 1, ord + 7)) AS place FROM {fx_node}) a JOIN {fx_node} b ON a.floor = b.floor AND b.ord = a.place""",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str, repeats: bool = False) -> DataFrame:
    """A derived table, or a driver table as it is. With ``repeats`` rows of a derived table of distinct rows may come several times."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _SPARK_TEXT.get(name, VIEWS[name])
    if repeats:
        text = text.replace("SELECT DISTINCT", "SELECT", 1)
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _names(text)})


def duck(query: str, *names: str, recursive: bool = False) -> str:
    """``query`` behind the derived tables it needs, for DuckDB."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _names(VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]).replace('AS STRING', 'AS VARCHAR')})" for n in wanted]
    query = query.strip()
    if re.match(r"(?i)with\b", query):
        query = re.sub(r"(?i)^with\s+(recursive\s+)?", "", query)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {query}"
    return f"WITH {', '.join(parts)} {query}"
