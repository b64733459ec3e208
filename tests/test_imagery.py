import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import layout as L
from tesserae.operators import archive, compose, convert, raster
from tesserae.sources import codecs, container


def pixels(spark, w, h, value, names=("v",)):
    """A raster of one asset from a function of x and y, made where it is used."""
    frame = spark.range(w * h).select(F.lit(0).cast("bigint").alias("asset_id"), F.lit(0).alias("face"), (F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    return frame.select("*", *(F.expr(e).cast("int").alias(n) for n, e in zip(names, value)))


def files(parts):
    out = {}
    for r in container.pack(parts[2], parts[0], parts[1]).collect():
        out[r.asset] = out.get(r.asset, b"") + bytes(r.content)
    return out


def decoded(data, g=0):
    """Decoded payloads of a container by place."""
    front = container.FrontMatter.whole(data)
    out = {}
    for i in range(front.layout.total):
        span = front.ordinal_range(i)
        assert span, "every tile is there"
        place = front.layout.place(i)
        out[place] = codecs.decode(front.layout.groups[place[0]].codec, data[slice(*span)])
    return front, out


def test_split16_and_gray_roundtrip(spark):
    ramp = pixels(spark, 70, 50, ["1 + (10 * x + 3 * y) * 97 % 60000"])
    options = convert.CountOptions(tile_size=32)
    front, got = decoded(files(convert.counts(ramp, 70, 50, options))["0"])
    assert front.layout.header.levels == 3 and front.layout.groups[0].unit_label == "m"
    for (_, level, _, row, col), data in got.items():
        w, h = front.layout.level_dims(level)
        tw, th = min(32, w - 32 * col), min(32, h - 32 * row)
        tile = np.frombuffer(data, np.uint8).reshape(th, tw, 3).astype(int)
        if level == 2:
            y, x = np.mgrid[32 * row : 32 * row + th, 32 * col : 32 * col + tw]
            assert (tile[..., 0] * 256 + tile[..., 1] == 1 + (10 * x + 3 * y) * 97 % 60000).all() and not tile[..., 2].any()
    _, gray = decoded(files(convert.counts(ramp, 70, 50, options, "gray8"))["0"])
    y, x = np.mgrid[0:32, 0:32]
    tile = np.frombuffer(gray[0, 2, 0, 0, 0], np.uint8).reshape(32, 32, 3)  # WebP has three channels
    assert (tile == ((1 + (10 * x + 3 * y) * 97 % 60000) % 256)[:, :, None]).all()


def test_depth_forms(spark):
    ramp = pixels(spark, 64, 32, ["CASE WHEN x % 7 = 0 THEN 0 ELSE 1 + (10 * x + 3 * y) % 60000 END"])
    front, whole = decoded(files(convert.depth_whole(ramp, 64, 32))["0"])
    values = np.frombuffer(whole[0, 0, 0, 0, 0], "<u2").reshape(32, 64)
    y, x = np.mgrid[0:32, 0:64]
    assert (values == np.where(x % 7 == 0, 0, 1 + (10 * x + 3 * y) % 60000)).all() and front.layout.groups[0].flags == 3
    front, faces = decoded(files(convert.depth_faces(ramp, 64, 32, 16))["0"])
    assert len(faces) == 6 and all(len(b) == 512 for b in faces.values()) and front.layout.header.face_count == 6
    front, tiled = decoded(files(convert.depth_tiled(ramp, 64, 32, convert.CountOptions(tile_size=16)))["0"])
    assert front.layout.groups[0].flags == 2 and np.frombuffer(tiled[0, 0, 0, 0, 0], "<u2").reshape(8, 16)[1, 2] == values[4, 8]
    with pytest.raises(ValueError):
        convert.depth_faces(ramp, 64, 30, 16)


def test_panorama_keeps_directions(spark):
    """Colours painted by direction come out on the faces that look that way."""
    w, h = 64, 32
    lon, lat = f"(x + 0.5) / {w} * 2 * pi()", f"(y + 0.5) / {h} * pi()"
    paint = [f"round((sin({lat}) * cos({lon}) + 1) / 2 * 255)", f"round((sin({lat}) * sin({lon}) + 1) / 2 * 255)", f"round((cos({lat}) + 1) / 2 * 255)"]
    front, got = decoded(files(convert.panorama(pixels(spark, w, h, paint, "rgb"), w, h, convert.ImageOptions(tile_size=8)))["0"])
    assert front.layout.header.levels == 2 and len(got) == 6 * (1 + 4)
    centres = {0: (0, 128, 128), 1: (255, 128, 128), 2: (128, 255, 128), 3: (128, 0, 128), 4: (128, 128, 0), 5: (128, 128, 255)}
    for face, colour in centres.items():
        tile = np.frombuffer(got[0, 0, face, 0, 0], np.uint8).reshape(8, 8, 3).astype(int)
        assert np.abs(tile[3:5, 3:5].mean(axis=(0, 1)) - colour).max() < 14
        assert tile[0, :, 2].mean() > tile[-1, :, 2].mean() or face in (4, 5)


def test_planar_tiles_have_their_sizes(spark):
    front, got = decoded(files(convert.planar(pixels(spark, 40, 30, ["x % 256", "y % 256", "100"], "rgb"), 40, 30, convert.ImageOptions(tile_size=16)))["0"])
    for (_, level, _, row, col), data in got.items():
        w, h = front.layout.level_dims(level)
        assert len(data) == 3 * min(16, w - 16 * col) * min(16, h - 16 * row)


def test_lanczos_keeps_flat_and_smooth_images(spark):
    got = raster.resize(pixels(spark, 32, 16, ["200", "4 * x", "10 * y"], "rgb"), 32, 16, 16, 8).collect()
    assert len(got) == 128 and {r.r for r in got} == {200}
    assert all(abs(r.g - 4 * (2 * r.x + 0.5)) <= 2 for r in got if 3 <= r.x < 13) and all(abs(r.b - 10 * (2 * r.y + 0.5)) <= 2 for r in got if 3 <= r.y < 5)
    assert np.allclose(raster.lanczos_weights(9, 4).sum(axis=1), 1)


def test_halving_by_plain_loop(spark):
    w, h = 13, 7
    frame = pixels(spark, w, h, ["CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 100 * y + x END"])
    src = {(r.y, r.x): r.v for r in frame.collect()}
    got = {(r.y, r.x): r.v for r in raster.halve_mean(frame).collect()}
    for y in range(math.ceil(h / 2)):
        for x in range(math.ceil(w / 2)):
            four = [src[min(2 * y + j, h - 1), min(2 * x + i, w - 1)] for j in (0, 1) for i in (0, 1)]
            four = [v for v in four if v]
            assert got.pop((y, x)) == (sum(four) // len(four) if four else 0)
    assert not got


def test_levels_for_refuses_tile_size_zero(spark):
    with pytest.raises(Exception, match="tile size"):
        spark.range(1).select(L.levels_for(F.lit(5), F.lit(5), F.lit(0) * F.col("id").cast("int"))).collect()


def pair(**changes):
    base = {"asset_id": 1, "face_count": 6, "levels": 3, "tile_size": 128, "root_w": 256, "root_h": 256, "group_count": 1, "s_face_count": 6, "s_levels": 1,
            "s_tile_size": 130, "s_root_w": 128, "s_root_h": 128, "s_group_count": 1, "s_untiled": True}
    return base | changes


def test_packing_refuses_wrong_tiles(spark):
    assets, groups, tiles = convert.depth_whole(pixels(spark, 4, 2, ["x"]), 4, 2)
    for wrong, said in ((tiles.withColumn("ordinal", F.col("ordinal") + 1), "outside"), (tiles.union(tiles), "twice")):
        with pytest.raises(Exception, match=said):
            container.pack(wrong, assets, groups).collect()


def test_merge_anchor_and_refusals(spark):
    rows = [pair(), pair(s_root_w=100, s_root_h=100), pair(s_face_count=1), pair(s_untiled=False), pair(s_untiled=False, s_tile_size=128), pair(s_levels=3),
            pair(group_count=255), pair(root_w=1, root_h=1, s_root_w=1, s_root_h=1)]
    frame = spark.createDataFrame([{**r, "asset_id": i} for i, r in enumerate(rows)])
    got = [(r.fault, r["shift"]) for r in compose.anchors(frame).orderBy("asset_id").collect()]
    assert got == [(None, 1), ("no level of the sibling's size", None), ("face count", 1), ("tile size", 1), (None, 1), ("no level of the sibling's size", None),
                   ("group count", 1), (None, 0)]


def test_edits_that_leave_nothing(spark):
    assets = spark.createDataFrame([(1, 2, 8, 8)], "asset_id long, levels int, root_w long, root_h long")
    groups = spark.createDataFrame([(1, 0, 3, 1, 0)], "asset_id long, group int, semantic int, level_count int, level_skip int")
    tiles = spark.createDataFrame([(1, 0, 1, b"x")], "asset_id long, group int, level int, blob binary")
    for make in (lambda: compose.remove_semantic(groups, tiles, 3)[0], lambda: compose.strip_finest(assets, groups, tiles, 1)[1], lambda: compose.strip_finest(assets, groups, tiles, 2)[0]):
        with pytest.raises(Exception, match="no group would be left|cannot strip"):
            make().collect()
    assert compose.strip_finest(assets, groups, tiles, 0)[2] is tiles
    assert compose.remove_semantic(groups, tiles, 1)[1].count() == 1


def zipped(face, tile, letters="fblrdu", folder="", skip=(), codec=b"RIFF\0\0\0\0WEBP", overlap=0):
    levels = math.ceil(math.sqrt(face / tile)) + 1 if face > tile else 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for f in letters:
            z.writestr(f"{folder}{f}.dzi", f'<Image TileSize="{tile}" Overlap="{overlap}"><Size Width="{face}" Height="{face}"/></Image>')
            for level in range(levels + 1):
                side = -(-face // 2 ** (levels - level))
                for c in range(-(-side // tile)):
                    for r in range(-(-side // tile)):
                        if (f, level, c, r) not in skip:
                            z.writestr(f"{folder}{f}_files/{level}/{c}_{r}.webp", codec + f"{f}-{level}-{c}-{r}".encode())
        z.writestr("notes.txt", "x")
        z.writestr("f_files/one/0_0.webp", "x")
    return out.getvalue()


def test_archives(spark):
    given = {0: zipped(1024, 512), 1: zipped(600, 256, "p", "wrap/"), 2: zipped(600, 256, "p", skip={("p", 3, 1, 1)}), 3: zipped(600, 256, "pq"),
             4: zipped(600, 256, "p", overlap=1), 5: zipped(600, 256, "p", codec=b"GIF8"), 6: zipped(512, 512, "p")}
    frame = spark.createDataFrame(list(given.items()), "asset_id long, content binary")
    infos, tiles = archive.read_archives(frame)
    plan = archive.plans(infos, tiles)
    made = archive.assemble(plan, tiles)
    got = {r.asset_id: r for r in archive.report(plan, made).collect()}
    assert (got[0].kind, got[0].levels, got[0].tiles_copied, got[0].tiles_absent, got[0].codec, got[0].fault) == ("cube", 2, 30, 0, 1, None)
    assert (got[1].kind, got[1].face_count, got[1].tiles_absent, got[1].fault) == ("planar", 1, 0, None)
    assert got[2].tiles_absent == 1 and "1 tiles absent" in got[2].notes[0]
    assert [got[i].fault for i in (3, 4, 5)] == ["neither six faces nor one pyramid", "overlap", "a tile is neither jpeg nor webp"]
    assert got[6].levels == 1 and got[6].dropped_coarse_levels == 1
    blob = made.where("asset_id = 0 AND level = 1 AND face = 5 AND row = 1 AND col = 0").first().blob
    assert bytes(blob).endswith(b"u-3-0-1")
    with pytest.raises(ValueError):
        archive.descriptor(b'<Image TileSize="4"/>')
    assert archive.descriptor(b'<a:Image xmlns:a="q" TileSize="65537"><a:Size Width="1" Height="2"/></a:Image>') == {"overlap": 0, "tile_size": 1, "width": 1, "height": 2}


def png(image, kind, rules):
    h, w, bands = image.shape
    raw, above = b"", np.zeros((w, bands), int)
    for y in range(h):
        line, rule = image[y].astype(int), rules[y % len(rules)]
        left = np.vstack([np.zeros((1, bands), int), line[:-1]])
        corner = np.vstack([np.zeros((1, bands), int), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0, left, above, (left + above) // 2, paeth)[rule]
        raw += bytes([rule]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(0)
    for kind, bands in ((0, 1), (2, 3), (6, 4)):
        image = rng.integers(0, 256, (7, 5, bands), dtype=np.uint8)
        w, h, got = codecs.decode_rgb(png(image, kind, (0, 1, 2, 3, 4)))
        want = np.repeat(image, 3, axis=2) if bands == 1 else image[:, :, :3]
        assert (w, h) == (5, 7) and got == want.tobytes()
    for bad in (b"GIF89a", b"\xff\xd8\xff\xe0"):
        with pytest.raises((ValueError, LookupError)):
            codecs.decode_rgb(bad)
