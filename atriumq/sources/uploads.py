"""Uploaded files: what they are, whether they may be stored, and where.

Files come from Spark's ``binaryFile`` source or any table with ``name`` and ``content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atriumq.functions import text as t

# Size limits in bytes, of an upload and of what is analysed.
MAX_UPLOAD, MAX_ANALYSED = 20 * 1024 * 1024, 32 * 1024 * 1024
MAX_SIDE = 4096


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, content) of files under a path that Spark reads."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def checked(uploads: DataFrame, max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """Uploads with ``error``: the first reason why one may not be stored, null if it may.

    uploads: (filename, name, building, floor_label, content)."""
    size = F.coalesce(F.length("content"), F.lit(0))
    error = (
        F.when(~t.suffix(F.col("filename")).isin(*t.SUFFIXES), "unsupported file type")
        .when(size == 0, "empty file")
        .when(size > max_bytes, "file too large")
        .when(t.blank(F.col("name")) | t.blank(F.col("building")) | t.blank(F.col("floor_label")), "blank name")
    )
    return uploads.withColumn("error", error)


def registered(uploads: DataFrame) -> DataFrame:
    """Floor rows of the uploads that may be stored, with the name that each is stored under."""
    good = checked(uploads).where("error IS NULL")
    key = F.sha2(F.concat_ws("/", "building", "floor_label", "filename", F.sha2("content", 256)), 256).substr(1, 32)
    return good.select(
        key.alias("id"), F.trim("name").alias("name"), F.trim("building").alias("building_name"), F.trim("floor_label").alias("floor_label"), F.col("filename").alias("original_filename"),
        F.concat(key, t.suffix(F.col("filename"))).alias("stored_filename"), t.media_type(F.col("content")).alias("media_type"), F.current_timestamp().alias("created_at"),
    )


def analysable(content: Column) -> Column:
    """HTTP-like status of content to analyse: 400 empty, 413 too large, 200 else."""
    size = F.coalesce(F.length(content), F.lit(0))
    return F.when(size == 0, 400).when(size > MAX_ANALYSED, 413).otherwise(200)


def inside(name: Column) -> Column:
    """Whether a stored name stays inside the upload folder: not absolute, and never climbing out of it."""
    parts = F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda s, p: F.struct((s["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), (s["ok"] & (s["d"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")),
    )
    return ~name.startswith("/") & depth["ok"] & (depth["d"] > 0)


def stored_bytes(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """Catalog rows with the bytes they name; rows whose file is missing or outside the folder have none."""
    safe = F.when(inside(F.col("stored_filename")), F.col("stored_filename"))
    return catalog.withColumn("_at", safe).join(found.select(F.col("name").alias("_at"), "content"), "_at", "left").drop("_at")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, rgb) of PNG, JPEG and GIF files, decoded in the JVM, channels in the order red, green, blue."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))


def fitted_side(width: Column, height: Column) -> Column:
    """Factor that brings the longer side to MAX_SIDE pixels at most."""
    return F.least(F.lit(1.0), F.lit(float(MAX_SIDE)) / F.greatest(width, height))
