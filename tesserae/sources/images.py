"""JPEG and PNG files as pixel relations, decoded in the JVM by Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels that leave as one batch.
HELD = 1 << 18


def read(spark: SparkSession, path: str) -> DataFrame:
    """asset_id (a hash of the path), path, w, h, bands and data of the images of a file, folder or pattern.

    Fails on files that are no images. ``data`` is as the source has it: lines
    of blue, green, red (and alpha), or of gray.
    """
    found = spark.read.format("image").load(path).select("image.*")
    fits = F.assert_true(F.col("height") > 0, F.concat(F.lit("neither JPEG nor PNG: "), F.col("origin"))).isNull()
    return found.where(fits).select(
        F.xxhash64("origin").alias("asset_id"), F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"),
        F.col("nChannels").alias("bands"), "data")


def pixels(images: DataFrame) -> DataFrame:
    """asset_id, face, y, x, r, g, b of images; gray ones have it three times, alpha is dropped."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["asset_id", "face", "y", "x", "r", "g", "b"]
        for batch in batches:
            for asset, w, h, bands, data in zip(*(c.to_pylist() for c in batch.columns)):
                image = np.frombuffer(data, np.uint8).reshape(h, w, bands)
                step = max(1, HELD // w)
                for top in range(0, h, step):
                    part = image[top : top + step]
                    n = part.shape[0] * w
                    rgb = [part[:, :, 0 if bands == 1 else 2 - c].reshape(-1).astype(np.int32) for c in range(3)]
                    y, x = np.divmod(np.arange(n, dtype=np.int64), w)
                    columns = [np.full(n, asset), np.zeros(n, np.int32), (y + top).astype(np.int32), x.astype(np.int32), *rgb]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = images.select("asset_id", "w", "h", "bands", "data")
    return rows.mapInArrow(run, "asset_id bigint, face int, y int, x int, r int, g int, b int")
