"""Registered queries that leave no row of their tables out."""

from pyspark.sql import functions as F

from tesserae.operators import tiles
from tesserae.plans import catalog
from tesserae.plans import data as D


def test_no_tile_blob_or_turn_is_left_out(spark, sf_dir):
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    docs = D.table(spark, sf_dir, "documents")
    blobs = D.blobs(spark, sf_dir)
    assert run("q_tile_dims").count() == run("q_enumerate").agg(F.sum("n")).first()[0]
    assert run("q_tile_range").count() == blobs.where("n_bytes > 0").count()
    assert run("q_spans").agg(F.sum("n_tiles")).first()[0] == blobs.where("n_bytes > 0").count()
    assert run("q_place").count() == docs.select(F.floor(F.col("doc_id") / 10)).distinct().count()
    assert {r.seq for r in run("q_push_order").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_places_without_blobs_and_blobs_without_places(spark):
    wanted = spark.createDataFrame([(0, i) for i in range(4)], "asset_id long, ordinal long")
    blobs = spark.createDataFrame([(0, 0, b"a", 1), (0, 0, b"b", 2), (0, 2, b"", 3), (0, 9, b"x", 4), (1, 1, b"y", 5)], "asset_id long, ordinal long, blob binary, seq long")
    placed = tiles.place(wanted, blobs, ["asset_id", "ordinal"])
    assert {r.ordinal: r.blob and bytes(r.blob) for r in placed.collect()} == {0: b"b", 1: None, 2: None, 3: None}
    outside = tiles.out_of_range(wanted, blobs, ["asset_id", "ordinal"])
    assert {(r.asset_id, r.ordinal) for r in outside.collect()} == {(0, 9), (1, 1)}
