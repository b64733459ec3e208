"""Whole jobs from files to files: converting images, repacking archives, inspecting containers.

``python -m tesserae.plans.commands repack|convert|depth SOURCE TARGET`` or ``... inspect SOURCE``
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..operators import archive, compose, convert, tiles
from ..sources import container, images, webp


def repack(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Containers in ``target`` from the Deep Zoom archives of a folder; gives the report, with faults of those left out.

    Archives are numbered by their path's hash, which names the files.
    """
    container.register(spark)
    files = spark.read.format("binaryFile").load(source).select(F.xxhash64("path").alias("asset_id"), "path", "content")
    infos, found = archive.read_archives(files)
    plan = archive.plans(infos, found)
    made = archive.assemble(plan, found)
    report = archive.report(plan, made)
    good = report.where("fault IS NULL")
    zero = F.lit(0)
    groups = good.select(
        "asset_id", zero.alias("group"), zero.alias("semantic"), F.col("codec"), zero.alias("sample"), zero.alias("flags"), F.col("levels").alias("level_count"),
        zero.alias("level_skip"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("offset"), zero.alias("nodata"), zero.alias("min"), zero.alias("max"),
        R.unit_bytes(F.lit("")).alias("unit"))
    container.pack(made.select("asset_id", "ordinal", "blob"), good, groups).write.format("tiles").mode("append").save(target)
    return report.join(files.select("asset_id", "path"), "asset_id")


def convert_images(spark: SparkSession, source: str, target: str, options: convert.ImageOptions = convert.ImageOptions(), panoramas: bool = True) -> list[tuple[int, int]]:
    """Containers in ``target`` of the JPEG and PNG files of ``source``: cubemaps of panoramas, or one face; the sizes there were.

    Images of one size are one plan, so that its levels are known.
    """
    container.register(spark)
    found = images.read(spark, source)
    sizes = sorted((r["w"], r["h"]) for r in found.select("w", "h").distinct().collect())  # one row a size
    for w, h in sizes:
        same = images.pixels(found.where((F.col("w") == w) & (F.col("h") == h)))
        assets, groups, own = (convert.panorama if panoramas else convert.planar)(same, w, h, options)
        container.pack(own, assets, groups).write.format("tiles").mode("append").save(target)
    return sizes


def depth_counts(spark: SparkSession, source: str) -> DataFrame:
    """asset_id, face, y, x, v of lossless WebP files that pack millimetres in red (high byte) and green."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for asset, content in zip(*(c.to_pylist() for c in batch.columns)):
                w, h, rgb = webp.decode_lossless(content)
                image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(np.int32)
                step = max(1, images.HELD // w)
                for top in range(0, h, step):
                    part = image[top : top + step].reshape(-1, 3)
                    y, x = np.divmod(np.arange(len(part)), w)
                    columns = [np.full(len(part), asset), np.zeros(len(part), np.int32), (y + top).astype(np.int32), x.astype(np.int32), part[:, 0] << 8 | part[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asset_id", "face", "y", "x", "v"])

    files = spark.read.format("binaryFile").load(source).select(F.xxhash64("path").alias("asset_id"), "content")
    return files.mapInArrow(run, "asset_id bigint, face int, y int, x int, v int")


def convert_depth(spark: SparkSession, source: str, target: str, farthest: float = 30.0, face: int | None = None) -> list[tuple[int, int]]:
    """Containers in ``target`` of depth panoramas (``depth_counts``), six faces each; ``farthest`` in metres."""
    container.register(spark)
    counts = depth_counts(spark, source)
    sides = counts.groupBy("asset_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    sizes = sorted((r["w"], r["h"]) for r in sides.select("w", "h").distinct().collect())  # one row a size
    options = convert.CountOptions(max=min(65_535, round(farthest * 1000)))
    for w, h in sizes:
        same = counts.join(sides.where((F.col("w") == w) & (F.col("h") == h)).select("asset_id"), "asset_id")
        assets, groups, own = convert.depth_faces(same, w, h, face or w // 4, options)
        container.pack(own, assets, groups).write.format("tiles").mode("append").save(target)
    return sizes


def described(spark: SparkSession, source: str) -> DataFrame:
    """Groups of the containers of a folder: asset_id, group, semantic, codec; tasks read the front matter of files only."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with container._open(path) as f:
                    front = container.FrontMatter.read(f)
                rows += [(container._asset(path), i, g.semantic, g.codec) for i, g in enumerate(front.layout.groups)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["asset_id", "group", "semantic", "codec"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path")
    return files.mapInArrow(run, "asset_id string, `group` int, semantic int, codec int")


def inspect(spark: SparkSession, source: str) -> DataFrame:
    """By container and group: tiles present, all tiles, and tiles whose first bytes are not of the group's codec."""
    own = container.scan(spark, source, blob_bytes=12).withColumnRenamed("asset", "asset_id")
    return tiles.inspect(own, described(spark, source))


def image_with_band(colour: DataFrame, counts: DataFrame, w: int, h: int, tile_size: int = 512):
    """Assets, groups and tiles of images with a near-infrared band of the same size merged in."""
    assets, groups, own = convert.planar(colour, w, h, convert.ImageOptions(tile_size=tile_size))
    options = replace(convert.CountOptions(), semantic=1, scale=1.0, nodata=65_535, max=65_535, unit="", tile_size=tile_size)
    s_assets, s_groups, s_own = convert.counts(counts, w, h, options, "gray8")
    pairs = assets.join(
        s_assets.select("asset_id", *(F.col(c).alias(f"s_{c}") for c in ("face_count", "levels", "tile_size", "root_w", "root_h", "group_count"))), "asset_id"
    ).withColumn("s_untiled", F.lit(False))
    keys = ["asset_id", "group", "level", "face", "row", "col", "blob"]
    all_groups, all_tiles = compose.merge(pairs, groups, s_groups, own.select(keys), s_own.select(keys))
    from ..operators import layout

    merged = assets.withColumn("group_count", F.lit(2))
    placed = layout.with_ordinal(all_tiles, layout.level_table(merged, all_groups))
    return merged, all_groups, placed


def main(args: list[str]) -> int:
    jobs = {"repack": repack, "convert": convert_images, "depth": convert_depth, "inspect": inspect}
    if not args or args[0] not in jobs or len(args) != (2 if args[0] == "inspect" else 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    done = jobs[args[0]](spark, *args[1:])
    done.show(1000, truncate=False) if isinstance(done, DataFrame) else print(*done)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
