"""Deterministic assets, groups, tiles and rasters made from the driver's tables.

No step numbers rows globally: keys of the tables give asset, ordinal and
pixel. ``orders`` has one row for each key from 0, which is laid out as
rasters of 32 by 16 pixels, one asset for every 512 keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W, H, PER_ASSET = 32, 16, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubemaps and planar images with sizes from documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    side = 1 + F.col("n_chars")
    cube = F.col("doc_id") % 3 == 0
    return docs.select(
        F.col("doc_id").alias("asset_id"), F.when(cube, 6).otherwise(1).alias("face_count"), (1 + F.col("doc_id") % 6).cast("int").alias("levels"),
        F.element_at(F.array(F.lit(64), F.lit(128), F.lit(256)), (1 + F.col("doc_id") % 3).cast("int")).alias("tile_size"), side.alias("root_w"),
        F.when(cube, side).otherwise(1 + F.col("n_chars") % 3000).alias("root_h"), F.lit(2).alias("group_count"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups an asset: all levels tiled, and half of them, which is untiled for some."""
    a = assets(spark, sf_dir)
    half = F.greatest(F.lit(1), F.floor(F.col("levels") / 2).cast("int"))
    odd = F.col("asset_id") % 4 == 1
    first = a.select("asset_id", F.lit(0).alias("group"), F.lit(0).alias("semantic"), F.lit(1).alias("codec"), F.lit(0).alias("flags"),
                     F.col("levels").alias("level_count"), F.lit(0).alias("level_skip"))
    second = a.select("asset_id", F.lit(1), (1 + F.col("asset_id") % 3).cast("int"), F.lit(0), F.when(odd, 3).otherwise(0), half, F.col("levels") - half)
    return first.union(second)


ASSETS_SQL = """assets AS (
  SELECT doc_id AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 1 END AS face_count, CAST(1 + doc_id % 6 AS INT) AS levels,
    [64, 128, 256][1 + doc_id % 3] AS tile_size, 1 + n_chars AS root_w,
    CASE WHEN doc_id % 3 = 0 THEN 1 + n_chars ELSE 1 + n_chars % 3000 END AS root_h FROM documents),
 groups AS (
  SELECT asset_id, 0 AS grp, 0 AS semantic, 1 AS codec, 0 AS flags, levels AS level_count, 0 AS level_skip FROM assets
  UNION ALL SELECT asset_id, 1, CAST(1 + asset_id % 3 AS INT), 0, CASE WHEN asset_id % 4 = 1 THEN 3 ELSE 0 END,
    greatest(1, levels // 2), levels - greatest(1, levels // 2) FROM assets),
 levels AS (
  SELECT *, CASE WHEN flags & 1 = 1 THEN 1 ELSE (w + tile_size - 1) // tile_size END AS cols,
    CASE WHEN flags & 1 = 1 THEN 1 ELSE (h + tile_size - 1) // tile_size END AS rows_ FROM (
   SELECT *, (root_w + (1 << (levels - 1 - level)) - 1) >> (levels - 1 - level) AS w,
     (root_h + (1 << (levels - 1 - level)) - 1) >> (levels - 1 - level) AS h FROM (
    SELECT a.*, grp, semantic, codec, flags, level_count, level_skip,
      unnest(generate_series(levels - level_skip - level_count, levels - level_skip - 1)) AS level
    FROM assets a JOIN groups g USING (asset_id)))),
 runs AS (SELECT *, face_count * cols * rows_ AS tiles,
   coalesce(sum(face_count * cols * rows_) OVER (PARTITION BY asset_id ORDER BY grp, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM levels)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of one group, PER_ASSET an asset; every fifth is absent. n_bytes is the text's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.when(F.col("doc_id") % 5 == 4, 0).otherwise(F.octet_length("text"))
    return docs.select(
        F.floor(F.col("doc_id") / PER_ASSET).cast("bigint").alias("asset_id"), F.lit(0).alias("group"),
        F.floor(F.col("doc_id") % PER_ASSET / 100).cast("int").alias("level"), (F.col("doc_id") % PER_ASSET).alias("ordinal"),
        size.cast("bigint").alias("n_bytes"))


def front(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = blobs(spark, sf_dir).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("asset_id", (24 + 48 + 8 * (F.col("n") + 1)).alias("front_matter_len"))


INDEX_SQL = """blobs AS (
  SELECT doc_id // 1000 AS asset_id, 0 AS grp, CAST(doc_id % 1000 // 100 AS INT) AS level, doc_id % 1000 AS ordinal,
    CASE WHEN doc_id % 5 = 4 THEN 0 ELSE octet_length(encode(text)) END AS n_bytes FROM documents),
 idx AS (SELECT *, CAST(24 + 48 + 8 * (count(*) OVER (PARTITION BY asset_id) + 1)
    + sum(n_bytes) OVER (PARTITION BY asset_id ORDER BY ordinal) AS BIGINT) AS end_off FROM blobs),
 ranges AS (SELECT *, end_off - n_bytes AS start_off FROM idx)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count rasters; 0 is nodata. Only whole assets."""
    key = F.col("o_orderkey")
    value = F.when(key % 7 == 0, 0).otherwise(1 + F.floor("o_totalprice") % 60_000).cast("int")
    at = key % (W * H)
    pixels = table(spark, sf_dir, "orders").select(
        F.floor(key / (W * H)).cast("bigint").alias("asset_id"), F.lit(0).alias("face"), F.floor(at / W).cast("int").alias("y"),
        (at % W).cast("int").alias("x"), value.alias("v"))
    whole = pixels.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == W * H).select("asset_id")
    return pixels.join(whole, "asset_id")


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select(
        "asset_id", "face", "y", "x", (F.col("v") % 256).alias("r"), (F.col("v") % 199).alias("g"), (F.col("v") % 101).alias("b"))


RASTER_SQL = """px AS MATERIALIZED (
  SELECT o_orderkey // 512 AS asset_id, 0 AS face, CAST(o_orderkey % 512 // 32 AS INT) AS y, CAST(o_orderkey % 32 AS INT) AS x,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 + CAST(floor(o_totalprice) AS BIGINT) % 60000 END AS INT) AS v
  FROM orders WHERE o_orderkey // 512 IN (SELECT o_orderkey // 512 FROM orders GROUP BY 1 HAVING count(*) = 512))"""


def sizes(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return raster(spark, sf_dir).select("asset_id").distinct().withColumns({"w": F.lit(W), "h": F.lit(H), "n": F.lit(n)})
