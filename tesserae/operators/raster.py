"""Raster operators on pixel relations.

Count rasters have asset_id, face, y, x, v; colour rasters r, g, b instead of
v. Halving and cropping are groupings of pixels; nearest sampling looks pixels
up by their flat index, one equi-join. Bilinear sampling and Lanczos run in
numpy over groups of image rows or columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..functions.layout import _div
from .layout import dealt

PIXEL = ["asset_id", "face", "y", "x"]


#: Halvings whose pixels are dealt out once: blocks of so many times two pixels a side.
HALVINGS = 8
_BLOCK = ["asset_id", "face", "block_y", "block_x"]


def _blocks(raster: DataFrame, halvings: int) -> DataFrame:
    """A count raster dealt out over tasks by blocks, which so many halvings make one pixel each.

    Not by faces: where they are a constant, groupings would be shuffled again. Halving then needs no further shuffle, and no task counts pixels of more than its blocks, however large its part of the input.
    """
    side = F.lit(1 << halvings).cast("bigint")
    at = {f"block_{c}": _div(F.col(c).cast("bigint"), side) for c in "yx"}
    return raster.select(*PIXEL, "v").withColumns(at).repartition(dealt(raster.sparkSession), *(c for c in _BLOCK if c != "face"))


def _mean(blocks: DataFrame, nodata: int) -> DataFrame:
    value = F.nullif("v", F.lit(nodata))
    return blocks.groupBy(*_BLOCK, P.half(F.col("y")).alias("y"), P.half(F.col("x")).alias("x")).agg(
        F.coalesce(_div(F.sum(value), F.count(value)).cast("int"), F.lit(nodata)).alias("v"))


def halve_mean(raster: DataFrame, nodata: int = 0) -> DataFrame:
    """Means of 2 by 2 counts that are not nodata, cut to integers; nodata where all are."""
    return _mean(_blocks(raster, 1), nodata).select(*PIXEL, "v")


def halve_nearest(raster: DataFrame) -> DataFrame:
    """The top left of each 2 by 2 pixels."""
    kept = raster.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    return kept.withColumns({"y": P.half(F.col("y")), "x": P.half(F.col("x"))})


def pyramid(raster: DataFrame, levels: int, nodata: int | None = 0, durable=None) -> DataFrame:
    """All levels of a count raster, with column ``level`` (coarsest 0); nodata None: nearest.

    Each level is halved from the next finer one. ``durable`` may write a level
    out and read it back, which keeps the plan of deep pyramids short.
    """
    level, out = raster, raster.withColumn("level", F.lit(levels - 1))
    left = 0
    for n in range(levels - 2, -1, -1):
        if nodata is None:
            level = halve_nearest(level)
        else:
            if not left:
                left = 1 if durable else min(HALVINGS, n + 1)
                level = _blocks(level, left)
            level, left = _mean(level, nodata), left - 1
        level = durable(level) if durable else level
        out = out.unionByName(level.drop("block_y", "block_x").withColumn("level", F.lit(n)))
    return out


def crop(raster: DataFrame, tile_size: int) -> DataFrame:
    """Pixels with the tile they are in (row, col) and their place in it (ty, tx)."""
    size = F.lit(tile_size).cast("bigint")
    return raster.withColumns({
        "row": _div(F.col("y").cast("bigint"), size), "col": _div(F.col("x").cast("bigint"), size),
        "ty": (F.col("y") % tile_size).cast("int"), "tx": (F.col("x") % tile_size).cast("int"),
    })


def face_pixels(sizes: DataFrame) -> DataFrame:
    """Source coordinates of all pixels of the six faces: ``sizes`` has asset_id, w, h (of the panorama), n (of a face)."""
    row = sizes.withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    grid = row.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sx, sy = P.source_coordinates(
        F.col("face"), P.texel(F.col("x"), F.col("n")), P.texel(F.col("y"), F.col("n")), F.col("w"), F.col("h"))
    return grid.withColumns({"sx": sx, "sy": sy})


def _wrap(x, w):
    return (x % w + w) % w


def _clamp(y, h):
    return F.greatest(F.lit(0), F.least(y, h - 1))


def remap_nearest(raster: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cube faces of a count panorama by nearest sampling: asset_id, face, y, x, v."""
    at = face_pixels(sizes).select(
        *PIXEL, (_clamp(F.round("sy").cast("int"), F.col("h")) * F.col("w") + _wrap(F.round("sx").cast("int"), F.col("w"))).alias("idx"))
    source = raster.join(sizes.select("asset_id", "w"), "asset_id").select("asset_id", (F.col("y") * F.col("w") + F.col("x")).alias("idx"), "v")
    return at.join(source, ["asset_id", "idx"]).select(*PIXEL, "v")


#: Rows of a panorama that are sampled as one group.
BAND = 64
#: Pixels of the arrays that are sampled or resampled at once, or one group's.
AT_ONCE = 2_000_000


def _whole(frames, keys: list[str]):
    """Frames of sorted rows, cut anew so that none ends within rows of one key; with each the place of its rows among its keys."""
    import numpy as np
    import pandas as pd

    def placed(parts):
        frame = pd.concat(parts, ignore_index=True)
        ids = frame[keys].to_numpy()
        return frame, np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])

    held = []
    for frame in frames:
        if frame.empty:
            continue
        ids = frame[keys].to_numpy()
        others = np.flatnonzero((ids != ids[-1]).any(axis=1))
        cut = others[-1] + 1 if len(others) else 0
        if held and (cut or (held[-1][keys].iloc[-1].to_numpy() != ids[0]).any()):
            yield placed([*held, frame[:cut]])
            held = []
        elif cut:
            yield placed([frame[:cut]])
        held.append(frame[cut:])
    if held:
        yield placed(held)


def remap_bilinear(raster: DataFrame, sizes: DataFrame, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Cube faces of a panorama by bilinear sampling in 32-bit floats; longitude wraps, latitude stops at the poles.

    A group is BAND rows of a panorama, with the row after them, and the face
    pixels whose upper taps lie in these rows: each face pixel and nearly each
    source pixel is shuffled once, and no group holds more than its rows.
    """
    x0, y0 = F.floor("sx").cast("int"), F.floor("sy").cast("int")
    upper = _clamp(y0, F.col("h"))
    at = face_pixels(sizes).select(
        F.col("asset_id").cast("bigint").alias("asset_id"), F.floor(upper / BAND).cast("int").alias("band"), F.col("face").cast("int").alias("face"),
        F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), upper.cast("int").alias("upper"), _clamp(y0 + 1, F.col("h")).cast("int").alias("lower"),
        _wrap(x0, F.col("w")).cast("int").alias("left"), _wrap(x0 + 1, F.col("w")).cast("int").alias("right"), F.col("w").cast("int").alias("w"),
        (F.col("sx") - F.floor("sx").cast("float")).alias("fx"), (F.col("sy") - F.floor("sy").cast("float")).alias("fy"))
    own = F.floor(F.col("y") / BAND).cast("int")
    both = F.when((F.col("y") % BAND == 0) & (F.col("y") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    own_pixels = raster.select(
        F.col("asset_id").cast("bigint").alias("asset_id"), F.explode(both).alias("band"), F.lit(-1).alias("face"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        *(F.lit(0).alias(c) for c in ("upper", "lower", "left", "right", "w")), *(F.lit(0.0).cast("float").alias(c) for c in ("fx", "fy")), *(F.col(c).cast("int").alias(c) for c in bands))
    wanted = at.select(*(c for c in own_pixels.columns if c not in bands), *(F.lit(0).alias(c) for c in bands))
    schema = "asset_id bigint, face int, y int, x int, " + ", ".join(f"{c} int" for c in bands)
    keys, most = ["asset_id", "band"], AT_ONCE

    def sampled(frame, group):
        import numpy as np
        import pandas as pd

        first = frame["band"].to_numpy() * BAND
        pixel = frame["face"].to_numpy() < 0
        image = np.zeros((int(group[-1]) + 1, BAND + 1, int(frame["w"].max()), len(bands)), np.float32)
        held = np.zeros(len(image), bool)  # groups with pixels
        held[group[pixel]] = True
        own, y = frame[pixel], frame["y"].to_numpy()
        fits = own["x"].to_numpy() < image.shape[2]
        image[group[pixel][fits], (y - first)[pixel][fits], own["x"].to_numpy()[fits]] = own[list(bands)].to_numpy(np.float32)[fits]
        asked = ~pixel & held[group]
        wanted, g, first = frame[asked], group[asked], first[asked]
        up, down, left, right = (wanted[c].to_numpy() for c in ("upper", "lower", "left", "right"))
        fx, fy = (wanted[c].to_numpy(np.float32)[:, None] for c in ("fx", "fy"))
        one = np.float32(1)
        top = image[g, up - first, left] * (one - fx) + image[g, up - first, right] * fx
        below = image[g, down - first, left] * (one - fx) + image[g, down - first, right] * fx
        mixed = (top * (one - fy) + below * fy).astype(np.float64)
        mixed = np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.int32)
        return pd.DataFrame({c: wanted[c].to_numpy() for c in ("asset_id", "face", "y", "x")} | {c: mixed[:, i] for i, c in enumerate(bands)})

    def sample(frames):
        import numpy as np

        for frame, group in _whole(frames, keys):
            step = max(1, most // ((BAND + 1) * max(1, int(frame["w"].max()))))
            for n in range(0, int(group[-1]) + 1, step):
                low, high = np.searchsorted(group, [n, n + step])
                yield sampled(frame[low:high], group[low:high] - n)

    both_sides = own_pixels.union(wanted).repartition(dealt(raster.sparkSession), *keys).sortWithinPartitions(*keys)
    return both_sides.mapInPandas(sample, schema).select(*PIXEL, *bands)


def lanczos_weights(size: int, to: int):
    """Rows of weights (to, size) of a three-lobed Lanczos resampling."""
    import numpy as np

    weights = np.zeros((to, size))
    places, parts = lanczos_taps(size, to)
    np.add.at(weights, (np.arange(to)[:, None], places), parts)
    return weights


def lanczos_taps(size: int, to: int):
    """For each of ``to`` pixels, the places (to, taps) that it is made of, and their weights; places outside weigh nothing."""
    import numpy as np

    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    places = np.floor(centre - 3 * scale).astype(np.int64)[:, None] + np.arange(int(6 * scale) + 3)
    t = (places - centre[:, None]) / scale
    inside = (places >= 0) & (places < size) & (np.abs(t) < 3)
    weights = np.where(inside, np.sinc(t) * np.sinc(t / 3), 0.0)
    return np.clip(places, 0, size - 1), weights / weights.sum(axis=1, keepdims=True)


def resize(raster: DataFrame, w: int, h: int, to_w: int, to_h: int, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """A colour raster of w by h pixels resampled by Lanczos; the same size is returned as it is.

    First rows, then columns: each is resampled whole, many of them at once.
    """
    if (w, h) == (to_w, to_h):
        return raster
    most = AT_ONCE

    def along(frame: DataFrame, axis: str, other: str, size: int, to: int, last: bool) -> DataFrame:
        kind = "int" if last else "double"
        schema = f"asset_id bigint, face int, {other} int, {axis} int, " + ", ".join(f"{c} {kind}" for c in bands)
        keys = ["asset_id", "face", other]

        def run(frames):
            import numpy as np
            import pandas as pd

            places, weights = lanczos_taps(size, to)
            step = max(1, most // max(size, to))
            for pixels, line in _whole(frames, keys):
                for n in range(0, int(line[-1]) + 1, step):
                    low, high = np.searchsorted(line, [n, n + step])
                    part, at = pixels[low:high], line[low:high] - n
                    lines = int(at[-1]) + 1
                    values = np.zeros((lines, size, len(bands)))
                    values[at, part[axis].to_numpy()] = part[list(bands)].to_numpy(dtype=float)
                    got = np.zeros((lines, to, len(bands)))
                    for k in range(places.shape[1]):
                        got += values[:, places[:, k]] * weights[:, k, None]
                    if last:
                        got = np.clip(np.floor(got + 0.5), 0, 255).astype(np.int32)
                    first = np.searchsorted(at, np.arange(lines))
                    head = {c: np.repeat(part[c].to_numpy()[first], to) for c in keys} | {axis: np.tile(np.arange(to, dtype=np.int32), lines)}
                    yield pd.DataFrame(head | {c: got[:, :, i].reshape(-1) for i, c in enumerate(bands)})

        return frame.repartition(dealt(raster.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)

    pixels = raster.select(F.col("asset_id").cast("bigint").alias("asset_id"), F.col("face").cast("int").alias("face"), "y", "x", *bands)
    wide = along(pixels, "x", "y", w, to_w, False)
    return along(wide, "y", "x", h, to_h, True).select(*PIXEL, *bands)


def colour_pyramid(raster: DataFrame, w: int, h: int, levels: int, durable=None) -> DataFrame:
    """All levels of a colour raster, each resampled from the next finer one; column ``level``, coarsest 0."""
    level, out = raster, raster.withColumn("level", F.lit(levels - 1))
    for n in range(levels - 2, -1, -1):
        to_w, to_h = (max(1, math.ceil(s / 2)) for s in (w, h))
        level = resize(level, w, h, to_w, to_h)
        level = durable(level) if durable else level
        out, w, h = out.unionByName(level.withColumn("level", F.lit(n))), to_w, to_h
    return out
