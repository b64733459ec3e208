"""Containers that arrive in a folder, as a stream of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.container import parse


def tile_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """One row a tile of every container file that appears in ``folder``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return parse(files.select(name.alias("asset"), "content"))


def arrivals(tiles: DataFrame) -> DataFrame:
    """Running count of tiles and bytes by group and level; for the update or complete output mode."""
    return tiles.groupBy("group", "level").agg(
        F.count(F.lit(1)).alias("tiles"), F.count("blob").alias("present"), F.sum(F.col("end_off") - F.col("start_off")).alias("bytes"))
