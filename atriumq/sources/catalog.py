"""Catalog tables on Parquet: one row per floor and table, replaced as a whole, listed newest first.

A table is a folder of snapshots; writing makes a new one and readers take the last complete one, so
a lost executor or a failed write leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atriumq.schemas import KEYS, READ_DEFAULTS, TABLES


class Catalog:
    """Tables under ``root``, a path that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _snapshots(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((p.getName() for p in done), key=lambda n: (int(n.split("-")[0]), n))

    def table(self, name: str) -> DataFrame:
        """Rows of a table; columns that older files lack are null."""
        last = self._snapshots(name)[-1:]
        if not last:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{last[0]}")

    def _put(self, name: str, rows: DataFrame) -> None:
        n = len(self._snapshots(name))
        number = int(self._snapshots(name)[-1].split("-")[0]) + 1 if n else 0
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], TABLES[name]).schema]
        rows.select(*columns).write.parquet(f"{self.root}/{name}/{number:09d}-{uuid.uuid4().hex}")

    def get(self, name: str, key: str) -> DataFrame:
        return self.table(name).where(F.col(KEYS[name]) == key)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of the same key; of several new rows of one key the newest stays."""
        key = KEYS[name]
        if "updated_at" in rows.columns or "updated_at" not in TABLES[name]:
            new = rows
        else:
            new = rows.withColumn("updated_at", F.current_timestamp())
        self._put(name, replaced(self.table(name), new, key))

    def list_floorplans(self) -> DataFrame:
        return newest_first(self.table("floorplans"))

    def delete(self, name: str, keys: DataFrame) -> None:
        key = KEYS[name]
        self._put(name, self.table(name).join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti"))

    def delete_floorplans(self, ids: DataFrame) -> None:
        """Floors, and with them all that is kept about them."""
        for name in TABLES:
            self.delete(name, ids)


def replaced(old: DataFrame, new: DataFrame, key: str, newest: str = "updated_at") -> DataFrame:
    """``old`` with the rows of ``new`` instead of its own of the same keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_new")] + ([F.desc_nulls_last(newest)] if newest in both.columns else [])
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "_new")


def newest_first(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(at))


def created(rows: DataFrame) -> DataFrame:
    """New floor rows: trimmed names, an id and the time where none is given."""
    trim = {c: F.trim(c) for c in ("name", "building_name", "floor_label") if c in rows.columns}
    out = rows.withColumns(trim)
    for c, value in (("id", F.expr("uuid()")), ("created_at", F.current_timestamp())):
        out = out.withColumn(c, F.coalesce(F.col(c), value) if c in out.columns else value)
    return out


def nodes_of(models: DataFrame) -> DataFrame:
    """(floorplan_id, ord, id, x, y, label, kind) of all nodes, with defaults for what is missing."""
    rows = models.select("floorplan_id", F.posexplode("nodes").alias("ord", "n"))
    return rows.select("floorplan_id", "ord", "n.id", "n.position.x", "n.position.y", F.coalesce("n.label", F.lit(READ_DEFAULTS["node_label"])).alias("label"), F.coalesce("n.kind", F.lit(READ_DEFAULTS["node_kind"])).alias("kind"))


def edges_of(configs: DataFrame) -> DataFrame:
    rows = configs.select("floorplan_id", F.posexplode("edges").alias("ord", "e"))
    return rows.select("floorplan_id", "ord", "e.id", "e.from_node_id", "e.to_node_id", F.coalesce("e.kind", F.lit(READ_DEFAULTS["edge_kind"])).alias("kind"), F.coalesce("e.accessible", F.lit(READ_DEFAULTS["accessible"])).alias("accessible"))


def connectors_of(configs: DataFrame) -> DataFrame:
    rows = configs.select("floorplan_id", F.posexplode("vertical_connectors").alias("ord", "c"))
    yes: Column = F.lit(True)
    return rows.select("floorplan_id", "ord", "c.id", "c.kind", "c.label", "c.source_node_id", "c.target_floorplan_id", "c.target_node_id", F.coalesce("c.accessible", yes).alias("accessible"), F.coalesce("c.bidirectional", yes).alias("bidirectional"))


def default_connector(connectors: DataFrame) -> DataFrame:
    """Connectors drawn without saying so are accessible unless they are stairs."""
    return connectors.withColumn("accessible", F.coalesce("accessible", F.col("kind") != "stairs"))


def preview_url(floorplan_id: Column, media_type: Column) -> Column:
    """Where a preview is served, for the files that have one."""
    return F.when(media_type == "application/pdf", F.concat(F.lit("/api/v1/floorplans/"), floorplan_id, F.lit("/preview")))
