"""Editing sets of containers as relations; blobs are carried over as they are.

Each edit takes and gives assets, groups and tiles (asset_id, group, level,
face, row, col, blob). In place of tiles, the levels of a layout do as well
(``layout.level_table``): edited levels keep their ``base``, so that the tiles
enumerated from them hold the ordinals that their blobs have in the source, and
only a few rows an asset are joined. A rule that an asset breaks is raised where the plan
meets it, or given as a column by the ``*_faults`` functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import layout as L
from ..functions import registry as R
from .layout import beside


def anchors(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the level of the primary that the sibling's finest level lies on, and what forbids merging.

    Columns: asset_id; face_count, levels, tile_size, root_w, root_h and
    group_count of the primary; the same with ``s_`` of the sibling, and
    s_untiled (all its groups are). The finest level that fits is taken.
    """
    at = F.filter(
        F.sequence(F.col("s_levels") - 1, F.greatest(F.col("levels"), F.col("s_levels")) - 1),
        lambda level: (level < F.col("levels")) & (L.level_dim(F.col("root_w"), F.col("levels"), level) == F.col("s_root_w"))
        & (L.level_dim(F.col("root_h"), F.col("levels"), level) == F.col("s_root_h")),
    )
    found = pairs.withColumn("anchor", F.array_max(at))
    fault = (
        F.when(F.col("face_count") != F.col("s_face_count"), "face count")
        .when((F.col("tile_size") != F.col("s_tile_size")) & ~F.col("s_untiled"), "tile size")
        .when(F.col("group_count") + F.col("s_group_count") > 255, "group count")
        .when(F.col("anchor").isNull(), "no level of the sibling's size")
    )
    return found.withColumns({"fault": fault, "shift": F.col("levels") - 1 - F.col("anchor")})


def merge(pairs: DataFrame, groups: DataFrame, sibling_groups: DataFrame, tiles: DataFrame, sibling_tiles: DataFrame):
    """Groups and tiles of each primary with its sibling's appended, both keyed by the primary's asset_id."""
    found = anchors(pairs)
    found = found.where(F.assert_true(F.col("fault").isNull(), F.concat(F.lit("cannot merge: "), F.col("fault"))).isNull())
    moves = found.select("asset_id", F.col("group_count").alias("n"), "shift", (F.col("anchor") + 1 - F.col("s_levels")).alias("up"))
    moved_groups = sibling_groups.join(moves, "asset_id").withColumns({
        "group": (F.col("group") + F.col("n")).cast("int"), "level_skip": (F.col("level_skip") + F.col("shift")).cast("int")})
    moved_tiles = sibling_tiles.join(beside(moves), "asset_id").withColumns({
        "group": (F.col("group") + F.col("n")).cast("int"), "level": (F.col("level") + F.col("up")).cast("int")})
    return (groups.unionByName(moved_groups.drop("n", "shift", "up")), tiles.unionByName(moved_tiles.drop("n", "shift", "up")))


def _renumbered(groups: DataFrame) -> DataFrame:
    """Kept groups with ``old`` numbers and new ones without holes."""
    order = Window.partitionBy("asset_id").orderBy("old")
    return groups.withColumn("group", (F.row_number().over(order) - 1).cast("int"))


def _followed(tiles: DataFrame, kept: DataFrame, below: str | None = None) -> DataFrame:
    """Tiles of the kept groups under their new numbers; ``below``: the column of ``kept`` that levels must be under."""
    names = kept.select("asset_id", F.col("old").alias("group"), F.col("group").alias("new"), *([F.col(below).alias("below")] if below else []))
    found = tiles.join(beside(names), ["asset_id", "group"])
    return (found.where("level < below") if below else found).withColumn("group", F.col("new")).drop("new", "below")


def _some_left(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``kept``, failing where an asset lost all of its groups."""
    found = groups.select("asset_id").distinct().join(kept, "asset_id", "left")
    found = found.where(F.assert_true(F.col("group").isNotNull(), F.lit("no group would be left")).isNull())
    return found.select(*kept.columns)


def remove_semantic(groups: DataFrame, tiles: DataFrame, semantic: int):
    """Groups and tiles without the groups of a semantic; other groups close ranks."""
    kept = _renumbered(groups.where(F.col("semantic") != semantic).withColumn("old", F.col("group")))
    kept = _some_left(kept, groups)
    return kept.drop("old"), _followed(tiles, kept)


def strip_finest(assets: DataFrame, groups: DataFrame, tiles: DataFrame, n):
    """Assets, groups and tiles without the ``n`` finest levels: a number, or a column of ``assets``."""
    if isinstance(n, int) and n == 0:
        return assets, groups, tiles
    n = F.lit(n) if isinstance(n, int) else n
    ok = assets.where(F.assert_true(F.col("levels") > n, F.lit("cannot strip all levels")).isNull()).withColumn("cut", n)
    cut = ok.withColumns({
        "root_w": L.dim_at(F.col("root_w"), F.col("cut")), "root_h": L.dim_at(F.col("root_h"), F.col("cut")), "levels": (F.col("levels") - F.col("cut")).cast("int")})
    both = groups.join(cut.select("asset_id", "cut", F.col("levels").alias("new_levels")), "asset_id").withColumn("old", F.col("group"))
    low, high = L.level_range(F.col("new_levels") + F.col("cut"), F.col("level_count"), F.col("level_skip"))
    both = both.withColumns({"low": low, "high": F.least(high, F.col("new_levels"))}).where("low < new_levels")
    kept = both.withColumns({
        "level_count": (F.col("high") - F.col("low")).cast("int"), "level_skip": (F.col("new_levels") - F.col("high")).cast("int")})
    kept = _some_left(_renumbered(kept.drop("low", "high", "cut")), groups)
    return cut.drop("cut"), kept.drop("old", "new_levels"), _followed(tiles, kept, "new_levels")
