"""Blobs on a layout: placing them, their byte offsets, and lookups.

A tile without bytes is absent, which is content: it keeps its place in the
index with an empty range. Absent blobs are NULL; empty ones count the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["asset_id", "group", "level", "face", "row", "col"]


def place(tiles: DataFrame, blobs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``tiles`` with ``blob``; of several blobs for one tile (column ``seq``) the last wins."""
    key = key or KEY
    last = blobs.groupBy(*key).agg(F.max_by(F.struct("blob"), "seq").alias("last"))
    placed = tiles.join(last, key, "left")
    return placed.withColumn("blob", F.when(F.octet_length("last.blob") > 0, F.col("last.blob"))).drop("last")


def out_of_range(tiles: DataFrame, blobs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Blobs for tiles that the layout does not have."""
    return blobs.join(tiles, key or KEY, "left_anti")


def pushed(blobs: DataFrame) -> DataFrame:
    """Blobs with the ordinal of their turn (``seq``) within the asset."""
    turn = Window.partitionBy("asset_id").orderBy("seq")
    return blobs.withColumn("ordinal", F.row_number().over(turn).cast("bigint") - 1)


def offset_index(tiles: DataFrame, front: DataFrame) -> DataFrame:
    """``tiles`` (asset_id, ordinal, n_bytes) with start_off and end_off; ``front``: asset_id, front_matter_len."""
    upto = Window.partitionBy("asset_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tiles.join(front.select("asset_id", "front_matter_len").hint("shuffle_hash"), "asset_id")
    end = F.col("front_matter_len") + F.sum(F.coalesce("n_bytes", F.lit(0))).over(upto)
    return found.withColumn("end_off", end.cast("bigint")).withColumn(
        "start_off", (F.col("end_off") - F.coalesce("n_bytes", F.lit(0))).cast("bigint")
    ).drop("front_matter_len")


def tile_ranges(index: DataFrame) -> DataFrame:
    """Byte ranges of present tiles; absent and unknown ones have no row."""
    return index.where("end_off > start_off")


def level_ranges(index: DataFrame) -> DataFrame:
    """Bytes of each level of each group, one run, absent tiles included."""
    return index.groupBy("asset_id", "group", "level").agg(
        F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.count(F.lit(1)).alias("n_tiles"))


def with_presence(index: DataFrame) -> DataFrame:
    return index.withColumn("present", F.col("end_off") > F.col("start_off"))


def offsets(index: DataFrame) -> DataFrame:
    """The index as it is stored: all starts in order, and the end of the last."""
    return index.groupBy("asset_id").agg(
        F.concat(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "start_off"))), lambda x: x["start_off"]),
                 F.array(F.max("end_off"))).alias("offsets"))


def spans(ranges: DataFrame, gap: int = 0) -> DataFrame:
    """Ranges merged where at most ``gap`` bytes lie between them: asset_id, span_start, span_end, n_tiles."""
    order = Window.partitionBy("asset_id").orderBy("start_off", "end_off")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start_off") <= F.max("end_off").over(before) + gap, 0).otherwise(1)
    run = ranges.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("asset_id", "run").agg(
        F.min("start_off").alias("span_start"), F.max("end_off").alias("span_end"), F.count(F.lit(1)).alias("n_tiles")
    ).drop("run")


def band(tiles: DataFrame, groups: DataFrame, semantic: int) -> DataFrame:
    """Tiles (or levels of a layout) of the groups of a semantic, as the descriptors say; assets without such a group have none."""
    return tiles.join(groups.where(F.col("semantic") == semantic).select("asset_id", "group"), ["asset_id", "group"], "left_semi")


def complete(index: DataFrame, fetched: DataFrame) -> DataFrame:
    """By asset, whether every tile is absent or in ``fetched`` (asset_id, ordinal)."""
    got = fetched.select("asset_id", "ordinal").distinct().withColumn("got", F.lit(True))
    done = F.coalesce("got", F.lit(False)) | (F.col("end_off") == F.col("start_off"))
    return index.join(got, ["asset_id", "ordinal"], "left").groupBy("asset_id").agg(F.bool_and(done).alias("complete"))


def bad_index(index: DataFrame, front: DataFrame) -> DataFrame:
    """Assets whose stored offsets (asset_id, ordinal, start_off, end_off) do not start at the front matter's end or fall."""
    order = Window.partitionBy("asset_id").orderBy("ordinal")
    step = index.withColumn("before", F.lag("end_off").over(order)).join(front.select("asset_id", "front_matter_len"), "asset_id")
    wrong = F.when(F.col("before").isNull(), F.col("start_off") != F.col("front_matter_len")).otherwise(F.col("start_off") != F.col("before"))
    return step.where(wrong | (F.col("end_off") < F.col("start_off"))).select("asset_id").distinct()


def inspect(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """By group: tiles present, all tiles, and present ones whose bytes are not of the group's codec (jpeg, webp only)."""
    from ..functions.registry import sniff_codec

    both = tiles.join(groups.select("asset_id", "group", "codec").hint("shuffle_hash"), ["asset_id", "group"])
    present = F.octet_length("blob") > 0
    wrong = present & F.col("codec").isin(0, 1) & ~F.coalesce(sniff_codec(F.col("blob")) == F.col("codec"), F.lit(False))
    return both.groupBy("asset_id", "group").agg(
        F.count_if(present).alias("present"), F.count(F.lit(1)).alias("total"), F.count_if(wrong).alias("problems"))
