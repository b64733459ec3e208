"""Plans whose rows or memory would grow faster than their tables."""

import pandas as pd
import pytest

from tesserae.operators import layout, raster
from tesserae.plans import catalog


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_remove_semantic", "q_strip_finest", "q_band", "q_merge"])
def test_levels_are_edited_before_tiles_are_enumerated(spark, sf_dir, name):
    found = plan(catalog.QUERIES[name](spark, sf_dir))
    assert found.index("Generate explode") < found.index("Join")


def test_tiles_are_dealt_out_over_tasks_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(layout, "PIECE", 100)
    levels = spark.createDataFrame([(0, 0, 0, 6, 64, False, 2048, 2560, 32, 40, 7680, 5), (1, 0, 0, 1, 64, False, 8000, 64, 125, 1, 125, 0)],
                                   "asset_id long, `group` int, level int, face_count int, tile_size int, untiled boolean, w long, h long, cols long, rows long, tiles long, base long")
    found = layout.enumerate_tiles(levels)
    dealt = [n for n in found.rdd.glom().map(len).collect() if n]
    assert sum(dealt) == 7680 + 125 and len(dealt) >= 8 and max(dealt) < 7680 / 3
    rows = found.where("asset_id = 0").orderBy("ordinal").collect()
    assert [(r.ordinal, r.face, r.row, r.col) for r in rows] == [(5 + i, i // 1280, i % 1280 // 32, i % 32) for i in range(7680)]


@pytest.mark.parametrize("name", ["q_pyramid_mean", "q_halve_mean", "q_convert_gray8"])
def test_pixels_are_halved_in_the_tasks_they_are_dealt_out_to(spark, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in found.splitlines() if "Exchange" in line and "_groupingexpression" in line]


def test_pyramids_of_any_depth_are_the_same_however_pixels_are_dealt_out(spark, monkeypatch):
    counts = spark.range(2 * 70 * 37).selectExpr("id div 2590 as asset_id", "0 as face", "cast(id % 2590 div 70 as int) as y", "cast(id % 70 as int) as x", "cast(id * 31 % 97 as int) as v")
    found = []
    for halvings in (1, 3, 8):
        monkeypatch.setattr(raster, "HALVINGS", halvings)
        found.append(sorted(map(tuple, raster.pyramid(counts, 8).collect())))
    found.append(sorted(map(tuple, raster.pyramid(counts, 8, durable=lambda x: x.localCheckpoint()).collect())))
    assert all(f == found[0] for f in found) and len(found[0]) > 2590 * 2


def test_rows_of_a_key_are_never_parted():
    rows = pd.DataFrame({"a": [0] * 7 + [1] * 1 + [2] * 5 + [3], "b": [0] * 3 + [1] * 4 + [1] + [0] * 5 + [0], "n": range(14)})
    for size in range(1, 15):
        parts = list(raster._whole((rows[i:i + size] for i in range(0, 14, size)), ["a", "b"]))
        assert [n for frame, _ in parts for n in frame["n"]] == list(range(14))
        seen = [tuple(k) for frame, _ in parts for k in frame[["a", "b"]].drop_duplicates().to_numpy()]
        assert seen == [(0, 0), (0, 1), (1, 1), (2, 0), (3, 0)]
        assert all(list(group) == list(frame.groupby(["a", "b"]).ngroup()) for frame, group in parts)


@pytest.mark.parametrize("most", [1, 700, 2_000_000])
def test_images_are_sampled_alike_however_many_at_once(spark, monkeypatch, most):
    colour = spark.range(5 * 512).selectExpr("id div 512 as asset_id", "0 as face", "cast(id % 512 div 32 as int) as y", "cast(id % 32 as int) as x", *(f"cast(id * {k} % 256 as int) as {c}" for k, c in ((7, "r"), (11, "g"), (13, "b"))))
    sizes = spark.range(5).selectExpr("id as asset_id", "32 as w", "16 as h", "9 as n")
    run = lambda: (raster.remap_bilinear(colour, sizes), raster.resize(colour, 32, 16, 13, 7))
    made = run()
    assert not any("InPandas" in line and "Groups" in line for f in made for line in plan(f).splitlines())
    want = [sorted(map(tuple, f.collect())) for f in made]
    monkeypatch.setattr(raster, "AT_ONCE", most)
    monkeypatch.setattr(raster, "BAND", 64 if most > 1 else 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = [sorted(map(tuple, f.collect())) for f in run()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and [len(f) for f in got] == [5 * 6 * 81, 5 * 91]
