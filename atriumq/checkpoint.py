"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written and not dropped.
_WRITTEN: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read from the folder in ``spark.checkpoint.dir``; our own only where none is set and all runs on this machine."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="atriumq-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by kept() whose rows are no longer read."""
    some = df.inputFiles()[:1]
    for path in [p for p in _WRITTEN if some and some[0].removeprefix("file://").startswith(p.removeprefix("file://"))]:
        _remove(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this process has written here; call it once results have been read."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.remove(path)
