import numpy as np
import pytest

from tesserae.operators import convert
from tesserae.plans import commands
from tesserae.sources import codecs, container, images, webp

from .test_imagery import decoded, files, pixels, png, zipped


def test_repack_and_inspect(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dzp").write_bytes(zipped(1024, 512))
    (tmp_path / "in" / "b.szi").write_bytes(zipped(600, 256, "p", overlap=1))
    got = {r.path[-5:]: r for r in commands.repack(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert (got["a.dzp"].fault, got["b.szi"].fault) == (None, "overlap")
    (made,) = (tmp_path / "out").iterdir()
    front = container.FrontMatter.whole(made.read_bytes())
    assert front.layout.total == 30 and front.layout.header.face_count == 6
    (row,) = commands.inspect(spark, str(tmp_path / "out")).collect()
    assert (row.present, row.total, row.problems) == (30, 30, 0)
    assert commands.main(["nothing"]) == 2


def test_image_with_band(spark):
    colour = pixels(spark, 20, 12, ["x", "y", "100"], "rgb")
    band = pixels(spark, 20, 12, ["1 + x + y"])
    front, got = decoded(files(commands.image_with_band(colour, band, 20, 12, 8))["0"])
    assert [g.semantic for g in front.layout.groups] == [0, 1]
    gray = got[1, 2, 0, 0, 0]  # WebP, alike in three channels
    assert len(got) == 2 * (6 + 2 + 1) and gray[:9:3] == gray[1:9:3] == gray[2:9:3] == bytes([1, 2, 3])


def jpeg(spark, image):
    """JPEG bytes of an image, made by the JVM."""
    jvm, (h, w, _) = spark.sparkContext._jvm, image.shape
    held = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            held.setRGB(x, y, int(image[y, x, 0]) << 16 | int(image[y, x, 1]) << 8 | int(image[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(held, "jpg", out)
    return bytes(out.toByteArray())


def test_jpeg_and_png_pixels(spark, tmp_path):
    y, x = np.mgrid[0:16, 0:32]
    smooth = np.stack([x * 4 + 40, y * 6 + 60, 200 - x * 2], axis=2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg(spark, smooth))
    (tmp_path / "b.png").write_bytes(png(smooth, 2, (0, 1, 2, 3, 4)))
    (tmp_path / "c.png").write_bytes(png(smooth[:, :, :1], 0, (0, 4)))
    found = images.read(spark, str(tmp_path))
    names = {r.asset_id: r.path[-5:] for r in found.collect()}
    got = {n: np.zeros((16, 32, 3), int) for n in names.values()}
    for r in images.pixels(found).collect():
        got[names[r.asset_id]][r.y, r.x] = r.r, r.g, r.b
    assert (got["b.png"] == smooth).all() and (got["c.png"] == smooth[:, :, :1]).all()
    assert np.abs(got["a.jpg"] - smooth).mean() < 6
    w, h, rgb = codecs.decode_rgb((tmp_path / "b.png").read_bytes())
    assert (w, h, rgb) == (32, 16, smooth.tobytes())


def test_convert_files_to_containers(spark, tmp_path):
    y, x = np.mgrid[0:16, 0:32]
    smooth = np.stack([x * 4 + 40, y * 6 + 60, 200 - x * 2], axis=2).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(jpeg(spark, smooth))
    (tmp_path / "in" / "b.png").write_bytes(png(np.repeat(np.repeat(smooth, 2, 0), 2, 1), 2, (1, 2)))
    assert commands.convert_images(spark, str(tmp_path / "in"), str(tmp_path / "out"), convert.ImageOptions(tile_size=4)) == [(32, 16), (64, 32)]
    made = [decoded(f.read_bytes()) for f in (tmp_path / "out").iterdir()]
    assert sorted(front.layout.header.root_w for front, _ in made) == [8, 16]
    assert {g.codec for front, _ in made for g in front.layout.groups} == {1}
    assert all(len(blob) == 48 for _, got in made for blob in got.values())
    (tmp_path / "in" / "c.jpg").write_bytes(b"no image")
    with pytest.raises(Exception, match="neither JPEG nor PNG"):
        images.read(spark, str(tmp_path / "in")).collect()


def test_depth_files_to_containers(spark, tmp_path):
    y, x = np.mgrid[0:16, 0:32]
    depth = 300 * y + 7 * x + 1
    rgb = np.stack([depth >> 8, depth & 255, 0 * depth], axis=2).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.webp").write_bytes(webp.encode_lossless(32, 16, rgb.tobytes()))
    assert commands.convert_depth(spark, str(tmp_path / "in"), str(tmp_path / "out"), 4.5) == [(32, 16)]
    (made,) = (tmp_path / "out").iterdir()
    front, got = decoded(made.read_bytes())
    assert (front.layout.header.face_count, front.layout.groups[0].max, front.layout.groups[0].flags) == (6, 4500, 3)
    values = {int(v) for blob in got.values() for v in np.frombuffer(blob, "<u2")}
    assert len(got) == 6 and values <= set(depth.reshape(-1).tolist())
