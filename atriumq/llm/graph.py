"""Connected components by alternating stars, all in DataFrames.

Every round hangs larger neighbours of a node on its smallest one, then smaller ones too; a group
of any shape shrinks to a star around its smallest member in about log rounds. Rows are edges only,
so a hot node costs a join that Spark can split, never a collected group. Each round is a table in
the shared folder, so a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def _hang(edges: DataFrame, larger: bool, used: list[DataFrame]) -> DataFrame:
    """Edges (a > b): large star hangs a node's larger neighbours on its smallest, small star the smaller ones and itself."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        rows = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))  # neighbours larger than the node
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        rows = edges.select("a", F.col("b").alias("v"))
    # Written, so that the join reads two tables and Spark may split the rows of a hot node.
    least = written(least, "least")
    used.append(least)
    out = rows.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` reaches. Nodes without links
    and null ends are not in it; loops and repeated links do no harm."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    edges = written(edges, "edges")
    state = None
    while True:  # to the fixed point: every round but the last hangs a node on a smaller one
        used = [edges]
        edges = written(_hang(_hang(edges, True, used), False, used), "edges")
        for df in used:
            drop_table(df)
        # A star forest is a fixed point; the two sums over all edges tell it from the round before.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
