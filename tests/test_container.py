import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions import registry as R
from tesserae.operators import layout, tiles
from tesserae.sources import container as C

GOLDEN_GROUPS = [
    C.Group(0, 1, 0, 0, 2, 0),
    C.Group(3, 3, 2, 1, 1, 1, 0.001, 0.0, 0, 0, 65_000, b"m"),
]


def golden(skip=1, blob=lambda i: bytes((37 * k + i) & 255 for k in range(i % 11 + 1)), absent=lambda i: i % 5 == 4):
    groups = [GOLDEN_GROUPS[0], C.replace(GOLDEN_GROUPS[1], level_skip=skip)]
    b = C.Builder(C.Header(6, 2, 64, 128, 128), groups)
    for i in range(b.layout.total):
        b.push(None if absent(i) else blob(i))
    return b


def test_golden_bytes():
    b = golden()
    data = b.finish()
    assert b.layout.total == 36 and len(data) == 579
    assert hashlib.sha256(data).hexdigest() == "eacbde57426b6fa55a5c5730b2f99319dbff84db1ecc2a9e12769275c9ad9818"
    front = C.FrontMatter.whole(data)
    assert front.offsets[:6] == [416, 417, 419, 422, 426, 426] and front.file_len == 579
    assert front.layout.groups[1].unit_label == "m" and front.layout.groups == [C.replace(g, unit=g.unit.ljust(8, b"\0")) for g in b.groups]


# faces, levels, tile size, root, groups as (level count, skip, untiled)
LAYOUTS = [
    (6, 4, 512, (4096, 4096), [(4, 0, 0)]), (6, 4, 512, (4096, 4096), [(4, 0, 0), (1, 0, 1)]), (6, 4, 512, (3600, 3600), [(4, 0, 0), (1, 2, 1)]),
    (6, 4, 512, (4096, 4096), [(4, 0, 0), (2, 1, 0), (1, 3, 0), (2, 2, 1)]), (1, 5, 512, (5000, 3000), [(5, 0, 0), (2, 2, 0)]),
    (1, 5, 512, (5000, 3000), [(5, 0, 0)]), (1, 5, 512, (5000, 3000), [(5, 0, 0), (3, 0, 0)]), (6, 4, 512, (3000, 3000), [(4, 0, 0)]),
    (1, 1, 512, (300, 200), [(1, 0, 0)]), (6, 1, 512, (400, 400), [(1, 0, 0)]),
]


def brute_places(faces, levels, tile, root, groups):
    for g, (count, skip, untiled) in enumerate(groups):
        for level in range(levels - skip - count, levels - skip):
            w, h = (-(-side // 2 ** (levels - 1 - level)) for side in root)
            cols, rows = (1, 1) if untiled else (-(-w // tile), -(-h // tile))
            for face in range(faces):
                for row in range(rows):
                    for col in range(cols):
                        size = (w, h) if untiled else (max(1, min(tile, w - col * tile)), max(1, min(tile, h - row * tile)))
                        yield (g, level, face, row, col), size


def test_layouts_by_enumeration(spark):
    assets = spark.createDataFrame([(i, f, n, t, *r) for i, (f, n, t, r, _) in enumerate(LAYOUTS)], "asset_id long, face_count int, levels int, tile_size int, root_w long, root_h long")
    groups = spark.createDataFrame([(i, k, g[2], g[0], g[1]) for i, x in enumerate(LAYOUTS) for k, g in enumerate(x[4])],
                                   "asset_id long, group int, flags int, level_count int, level_skip int")
    levels = layout.level_table(assets, groups)
    got: dict = {}
    for r in layout.enumerate_tiles(levels).orderBy("asset_id", "ordinal").collect():
        got.setdefault(r.asset_id, []).append(((r.group, r.level, r.face, r.row, r.col), (r.tile_w, r.tile_h), r.ordinal))
    lengths = {r.asset_id: r.front_matter_len for r in layout.totals(levels, groups).collect()}
    for i, (f, n, t, root, gs) in enumerate(LAYOUTS):
        want = list(brute_places(f, n, t, root, gs))
        assert [x[:2] for x in got[i]] == want and [x[2] for x in got[i]] == list(range(len(want)))
        own = C.Layout(C.Header(f, n, t, *root, len(gs)), [C.Group(flags=u, level_count=c, level_skip=s) for c, s, u in gs])
        assert own.total == len(want) and own.front_len == lengths[i]
        assert all(own.place(k) == p and own.ordinal(*p) == k for k, (p, _) in enumerate(want))
        assert own.place(own.total) is None and own.ordinal(len(gs), 0, 0, 0, 0) is None and own.ordinal(0, n - 1, f, 0, 0) is None
    assert [own.level_dims(0)] == [(400, 400)]


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_write_and_read_again(rng):
    tile = rng.choice((16, 32, 64))
    faces = rng.choice((1, 6))
    w = rng.randint(1, 6 * tile)
    h = w if faces == 6 else rng.randint(1, 6 * tile)
    levels = rng.randint(1, 4)
    groups = []
    for _ in range(rng.randint(1, 3)):
        count = rng.randint(1, levels)
        groups.append(C.Group(rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.randrange(256), count, rng.randint(0, levels - count)))
    b = C.Builder(C.Header(faces, levels, tile, w, h), groups)
    blobs = {i: rng.randbytes(rng.randint(1, 19)) for i in range(b.layout.total) if rng.random() > 0.2}
    for i, x in blobs.items():
        b.set_tile(b.layout.place(i), b"old")
        b.set_ordinal(i, x)
    data = b.finish()
    front = C.FrontMatter.read(io.BytesIO(data + b"more"))
    assert [g.flags for g in front.layout.groups] == [g.flags for g in groups]
    for i in range(b.layout.total):
        span = front.tile_range(*b.layout.place(i))
        assert (data[slice(*span)] if span else None) == blobs.get(i)
    for base, g, level, cols, rows in b.layout.runs:
        assert front.level_range(g, level) == (front.offsets[base], front.offsets[base + faces * cols * rows])


def kind(data, parse=C.FrontMatter.whole):
    with pytest.raises(C.FormatError) as e:
        parse(data)
    return e.value.kind


def test_malformed():
    data = golden(0, lambda i: bytes([i]) * (i % 7 + 1), lambda i: False).finish()
    front = C.FrontMatter.whole(data)
    put = lambda at, b: data[:at] + b + data[at + len(b) :]
    assert kind(put(0, b"X")) == "magic" and kind(put(4, b"\x63")) == "version"
    assert {kind(put(5, bytes([n]))) for n in (0, 2, 3, 5, 7, 255)} == {"face_count"}
    assert kind(data[:-1]) == "truncated"
    index = front.layout.front_len - 8 * (front.layout.total + 1)
    assert kind(put(index + 8, bytes(8))) == "index" and kind(put(index, (999_999).to_bytes(8, "little"))) == "index"
    needed = []
    for n in range(front.layout.front_len):
        with pytest.raises(C.FormatError) as e:
            C.FrontMatter.parse(data[:n])
        assert e.value.kind == "truncated" and e.value.needed > n
        needed.append(e.value.needed)
    assert needed == sorted(needed) and C.FrontMatter.parse(data[: front.layout.front_len]).offsets == front.offsets
    huge = C._HEADER.pack(C.MAGIC, 1, 1, 255, 1, 1, 2**32 - 1, 2**32 - 1) + C.Group(level_count=255).to_bytes(255)
    assert kind(huge, C.FrontMatter.parse) == "too many tiles"
    assert kind(put(24 + 48 + 5, b"\x02")) == "level window"
    for bad in (C.Header(6, 1, 1, 2, 3), C.Header(1, 0, 1, 1, 1), C.Header(1, 1, 0, 1, 1), C.Header(1, 1, 1, 0, 1)):
        with pytest.raises(C.FormatError):
            C.Builder(bad, [C.Group()])
    b = golden()
    for bad in (-1, 36):
        with pytest.raises(C.FormatError):
            b.set_ordinal(bad, b"")
    with pytest.raises(C.FormatError):
        b.push(b"one too many")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 578), st.integers(0, 255), st.binary(max_size=200))
def test_no_bytes_crash(at, value, noise):
    data = bytearray(golden().finish())
    data[at] = value
    for x in (bytes(data), noise):
        try:
            C.FrontMatter.whole(x)
        except C.FormatError:
            pass


def test_source_reads_with_filters(spark, tmp_path):
    C.register(spark)
    data = golden().finish()
    (tmp_path / "one.tpc").write_bytes(data)
    (tmp_path / "two.tpc").write_bytes(data)
    frame = spark.read.format("tiles").load(str(tmp_path))
    rows = frame.collect()
    assert len(rows) == 72 and sum(r.blob is None for r in rows) == 14
    for r in rows:
        assert (bytes(r.blob) if r.blob else b"") == data[r.start_off : r.end_off]
    some = frame.where("`group` = 0 AND level = 1 AND face IN (2, 3) AND row = 0").collect()
    assert sorted((r.asset, r.face, r.col) for r in some) == sorted((a, f, c) for a in ("one", "two") for f in (2, 3) for c in (0, 1))
    bare = spark.read.format("tiles").option("includeBlob", "false").option("runBytes", "10").load(str(tmp_path))
    assert bare.where("blob IS NULL").count() == 72
    assert not tiles.bad_index(bare.selectExpr("asset AS asset_id", "ordinal", "start_off", "end_off"),
                               spark.createDataFrame([("one", 416), ("two", 416)], "asset_id string, front_matter_len long")).count()


def test_scan_plans_in_tasks(spark, tmp_path):
    C.register(spark)
    data = golden().finish()
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.tpc").write_bytes(data)
    (tmp_path / "deep" / "two.tpc").write_bytes(data)
    want = sorted(map(str, spark.read.format("tiles").load(f"file:{tmp_path}").collect()))
    assert sorted(map(str, C.scan(spark, str(tmp_path), run_bytes=10).collect())) == want and len(want) == 72
    heads = spark.read.format("tiles").option("blobBytes", "1").load(f"file://{tmp_path}")
    assert {len(r.blob) for r in heads.collect() if r.blob} == {1} == {len(r.blob) for r in C.scan(spark, str(tmp_path), 1).collect() if r.blob}


def test_failed_writes_leave_nothing(spark, tmp_path):
    C.register(spark)
    rows = spark.createDataFrame([(f"a{i}", 0, b"x") for i in range(4)], "asset string, part long, content binary")
    bad = rows.withColumn("content", F.when(F.col("asset") == "a3", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("tiles").mode("append").save(f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    rows.write.format("tiles").mode("append").save(f"file://{tmp_path}/out")
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == [f"a{i}.tpc" for i in range(4)]


def test_index_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 5)
    header, group = C.Header(1, 2, 8, 60, 30), C.Group(codec=200, level_count=2)
    built = C.Builder(header, [group])
    for i in range(built.layout.total):
        built.set_ordinal(i, b"" if i % 3 == 1 else bytes([i]) * (i + 1))
    assets = spark.createDataFrame([(7, 1, 2, 8, 60, 30)], "asset_id long, face_count int, levels int, tile_size int, root_w long, root_h long")
    names = ["semantic", "codec", "sample", "flags", "level_count", "level_skip", "scale", "offset", "nodata", "min", "max", "unit"]
    groups = spark.createDataFrame([(7, 0, *(getattr(group, n) for n in names))], "asset_id long, group int, semantic int, codec int, sample int, flags int,"
                                   " level_count int, level_skip int, scale double, offset double, nodata int, min int, max int, unit binary")
    blobs = spark.createDataFrame([(7, i, b) for i, b in built.blobs.items()], "asset_id long, ordinal long, blob binary")
    rows = C.pack(blobs, assets, groups).collect()
    assert b"".join(bytes(r.content) for r in rows) == built.finish() and {r.asset for r in rows} == {"7"}


def test_stream_of_files(spark, tmp_path):
    from tesserae.streaming import ingest

    (tmp_path / "a.tpc").write_bytes(golden().finish())
    q = ingest.arrivals(ingest.tile_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    q.processAllAvailable()
    (tmp_path / "b.tpc").write_bytes(golden().finish())
    q.processAllAvailable()
    got = {(r.group, r.level): (r.tiles, r.present, r.bytes) for r in spark.table("arrived").collect()}
    q.stop()
    assert sum(t for t, _, _ in got.values()) == 72 and sum(p for _, p, _ in got.values()) == 58 and sum(b for *_, b in got.values()) == 326


def test_registries(spark):
    frame = spark.createDataFrame([(0, b"m\0\0\0\0\0\0\0"), (3, b"kelvins!"), (240, b"\xff\xfe\0\0\0\0\0\0")], "code int, unit binary")
    got = frame.select(R.name(frame.code, R.SEMANTICS).alias("n"), R.unit_label(frame.unit).alias("u"), R.code(R.name(frame.code, R.SEMANTICS), R.SEMANTICS).alias("c")).collect()
    assert [tuple(r) for r in got] == [("rgb", "m", 0), ("depth", "kelvins!", 3), ("other", None, None)]
    assert bytes(spark.range(1).select(R.unit_bytes(R.F.lit("centimetres"))).first()[0]) == b"centimet"
    random.seed(1)
