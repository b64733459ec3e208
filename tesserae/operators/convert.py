"""Rasters to containers: pyramids, cropping, payloads and packing as one plan.

Each function gives (assets, groups, tiles); ``sources.container.pack`` makes
files of them. Pixels are row-major: three bytes a colour pixel, and a count as
packed bytes, one byte or two (low byte first); the codec makes payloads of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..functions import pixel as P
from ..functions import registry as R
from ..sources import codecs
from . import layout, raster


@dataclass(frozen=True)
class ImageOptions:
    tile_size: int = 512
    face_size: int | None = None
    codec: int = R.WEBP


@dataclass(frozen=True)
class CountOptions:
    """Radiometry and payload of counts; defaults are those of depth in millimetres."""

    semantic: int = 3
    scale: float = 0.001
    offset: float = 0.0
    nodata: int = 0
    min: int = 0
    max: int = 65_000
    unit: str = "m"
    tile_size: int = 512
    #: None: WebP (lossless, or near-lossless gray) for split16 and gray8, deflated bytes for depth.
    codec: int | None = None
    near_lossless: int = 100

    def coded(self, default: int) -> int:
        return default if self.codec is None else self.codec

    def columns(self) -> dict:
        return {"scale": F.lit(self.scale), "offset": F.lit(self.offset), "nodata": F.lit(self.nodata), "min": F.lit(self.min),
                "max": F.lit(self.max), "unit": R.unit_bytes(F.lit(self.unit))}




def _described(sizes: DataFrame, face_count: int, tile_size, levels, semantic: int, codec: int, sample: int, flags: int, radiometry: dict):
    assets = sizes.select(
        "asset_id", F.lit(face_count).alias("face_count"), levels.cast("int").alias("levels"), tile_size.cast("int").alias("tile_size"),
        F.col("w").alias("root_w"), F.col("h").alias("root_h"), F.lit(1).alias("group_count"))
    groups = assets.select(
        "asset_id", F.lit(0).alias("group"), F.lit(semantic).alias("semantic"), F.lit(codec).alias("codec"), F.lit(sample).alias("sample"),
        F.lit(flags).alias("flags"), F.col("levels").alias("level_count"), F.lit(0).alias("level_skip"),
        *(c.alias(k) for k, c in radiometry.items()))
    return assets, groups


def _plain() -> dict:
    zero = F.lit(0)
    return {"scale": F.lit(0.0), "offset": F.lit(0.0), "nodata": zero, "min": zero, "max": zero, "unit": R.unit_bytes(F.lit(""))}


def _payloads(pixels: DataFrame, assets: DataFrame, groups: DataFrame, tile_size: int | None, value, codec: int, near: int = 100) -> DataFrame:
    """Tiles with blobs: ``value`` is a pixel's bytes as hex digits."""
    placed = raster.crop(pixels, tile_size) if tile_size else pixels.withColumns({
        "row": F.lit(0).cast("bigint"), "col": F.lit(0).cast("bigint"), "ty": F.col("y"), "tx": F.col("x")})
    # lines of a tile first, so that no row holds more than a line of pixels or a tile's bytes
    at = ["asset_id", "level", "face", "row", "col"]
    lines = placed.groupBy(*at, "ty").agg(F.array_sort(F.collect_list(F.struct("tx", value.alias("p")))).alias("ps"))
    lines = lines.select(*at, "ty", F.size("ps").alias("w"), F.unhex(F.array_join("ps.p", "")).alias("line"))
    joined = lines.groupBy(*at).agg(F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("ty", "line"))).alias("lines"))
    raw = joined.select("asset_id", F.lit(0).alias("group"), "level", "face", "row", "col", "w", F.col("lines.line").alias("raw"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sides = zip(batch.column("w").to_pylist(), batch.column("raw").to_pylist())
            packed = pa.array([codecs.encode(codec, b"".join(lines), w, len(lines), near) for w, lines in sides], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], packed], names=[*batch.schema.names[:-2], "blob"])

    blobs = raw.mapInArrow(run, "asset_id bigint, `group` int, level int, face int, row bigint, col bigint, blob binary")
    every = layout.enumerate_tiles(layout.level_table(assets, groups))
    return every.join(blobs, ["asset_id", "group", "level", "face", "row", "col"], "left")


def _hex(column, digits: int):
    return F.lpad(F.hex(column.cast("bigint")), digits, "0")


def _rgb():
    return F.concat(_hex(F.col("r"), 2), _hex(F.col("g"), 2), _hex(F.col("b"), 2))


def _levels(w: int, h: int, tile_size: int) -> int:
    n = 1
    while max(w, h) > tile_size:
        w, h, n = -(-w // 2), -(-h // 2), n + 1
    return n


def _sizes(pixels: DataFrame, w: int, h: int) -> DataFrame:
    return pixels.select(F.col("asset_id").cast("bigint").alias("asset_id")).distinct().withColumns(
        {"w": F.lit(w).cast("bigint"), "h": F.lit(h).cast("bigint")})


def planar(pixels: DataFrame, w: int, h: int, options: ImageOptions = ImageOptions(), durable=None):
    """Colour images of w by h pixels, one face each."""
    n = _levels(w, h, options.tile_size)
    assets, groups = _described(_sizes(pixels, w, h), 1, F.lit(options.tile_size), F.lit(n), 0, options.codec, 0, 0, _plain())
    every = raster.colour_pyramid(pixels, w, h, n, durable)
    return assets, groups, _payloads(every, assets, groups, options.tile_size, _rgb(), options.codec)


def panorama(pixels: DataFrame, w: int, h: int, options: ImageOptions = ImageOptions(), durable=None):
    """Colour panoramas, twice as wide as high, as six faces."""
    if w != 2 * h:
        raise ValueError(f"a panorama is twice as wide as high, not {w} by {h}")
    face = options.face_size or max(1, w // 4)
    sizes = _sizes(pixels, w, h)
    faces = raster.remap_bilinear(pixels, sizes.select("asset_id", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(face).alias("n")))
    n = _levels(face, face, options.tile_size)
    assets, groups = _described(_sizes(pixels, face, face), 6, F.lit(options.tile_size), F.lit(n), 0, options.codec, 0, 0, _plain())
    every = raster.colour_pyramid(faces, face, face, n, durable)
    return assets, groups, _payloads(every, assets, groups, options.tile_size, _rgb(), options.codec)


def counts(pixels: DataFrame, w: int, h: int, options: CountOptions, form: str = "split16", durable=None):
    """Count rasters with a mean pyramid; ``form``: split16 (three bytes a pixel) or gray8 (one byte, modulo 256)."""
    n = _levels(w, h, options.tile_size)
    sample, codec, value = {
        "split16": (2, R.SPLIT16, F.concat(*(_hex(c, 2) for c in P.split16_pack(F.col("v"))))), "gray8": (1, R.WEBP, _hex(P.gray8(F.col("v")), 2)),
    }[form]
    codec, near = options.coded(codec), options.near_lossless if form == "gray8" else 100
    assets, groups = _described(_sizes(pixels, w, h), 1, F.lit(options.tile_size), F.lit(n), options.semantic, codec, sample, 0, options.columns())
    every = raster.pyramid(pixels, n, options.nodata, durable)
    return assets, groups, _payloads(every, assets, groups, options.tile_size, value, codec, near)


def _low_first():
    return F.concat(_hex(P.gray8(F.col("v")), 2), _hex(F.shiftright("v", 8), 2))


def depth_whole(pixels: DataFrame, w: int, h: int, options: CountOptions = CountOptions()):
    """Depth panoramas as one untiled level."""
    side = max(w, h)
    if side > 65_535:
        raise ValueError("a side exceeds 65535 pixels")
    assets, groups = _described(
        _sizes(pixels, w, h), 1, F.lit(side), F.lit(1), options.semantic, options.coded(R.DEFLATED), 2, R.flags(True, True), options.columns())
    every = pixels.withColumn("level", F.lit(0))
    return assets, groups, _payloads(every, assets, groups, None, _low_first(), options.coded(R.DEFLATED))


def depth_faces(pixels: DataFrame, w: int, h: int, face: int, options: CountOptions = CountOptions()):
    """Depth panoramas as six untiled faces by nearest sampling."""
    if w != 2 * h:
        raise ValueError(f"a panorama is twice as wide as high, not {w} by {h}")
    if face > 65_535:
        raise ValueError("a face exceeds 65535 pixels")
    sizes = _sizes(pixels, face, face)
    got = raster.remap_nearest(pixels, sizes.select("asset_id", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(face).alias("n")))
    assets, groups = _described(sizes, 6, F.lit(face), F.lit(1), options.semantic, options.coded(R.DEFLATED), 2, R.flags(True, True), options.columns())
    return assets, groups, _payloads(got.withColumn("level", F.lit(0)), assets, groups, None, _low_first(), options.coded(R.DEFLATED))


def depth_tiled(pixels: DataFrame, w: int, h: int, options: CountOptions = CountOptions(), durable=None):
    """Depth rasters with a nearest pyramid, tiled."""
    n = _levels(w, h, options.tile_size)
    assets, groups = _described(
        _sizes(pixels, w, h), 1, F.lit(options.tile_size), F.lit(n), options.semantic, options.coded(R.DEFLATED), 2, R.flags(False, True), options.columns())
    every = raster.pyramid(pixels, n, None, durable)
    return assets, groups, _payloads(every, assets, groups, options.tile_size, _low_first(), options.coded(R.DEFLATED))
