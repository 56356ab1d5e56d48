"""Plans as they arrive. Analysis is stateless by floor, so it runs on a stream as it does on a table:
``analyze`` of atriumq.plans.structural takes a streaming DataFrame too. Nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atriumq.plans.structural import Options, analyze


def arriving_plans(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Scenes of the drawings that are put under ``path``, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").load(path)
    return analyze(files.select(F.col("path").alias("floorplan_id"), "content"), options)
