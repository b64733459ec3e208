"""Tile layouts as relations: levels of groups, tiles, ordinals and runs.

``assets`` has asset_id, face_count, levels, tile_size, root_w, root_h;
``groups`` has asset_id, group, flags, level_count, level_skip. Windows are
always over one asset, whose tiles are capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import layout as L
from ..functions import registry as R

#: Most tiles that a layout may imply.
MAX_TILES = 67_108_864
#: Tiles that are enumerated from one row, about.
PIECE = 262_144
#: Columns of level_table().
LEVEL = ["asset_id", "group", "level", "face_count", "tile_size", "untiled", "w", "h", "cols", "rows", "tiles", "base"]


def beside(few: DataFrame, most: int = 200_000) -> DataFrame:
    """``few`` as the side of a join with tiles: broadcast if it has ``most`` rows at most, which is counted now, else shuffled and hashed.

    Plans cannot tell how many tiles come of a level, and would take the tiles for the smaller side.
    """
    return F.broadcast(few) if few.limit(most + 1).count() <= most else few.hint("shuffle_hash")


def level_table(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each level of each group, with its grid, tile count and first ordinal."""
    both = groups.select("asset_id", "group", "flags", "level_count", "level_skip").join(
        assets.select("asset_id", "face_count", "levels", "tile_size", "root_w", "root_h"), "asset_id"
    )
    low, high = L.level_range(F.col("levels"), F.col("level_count"), F.col("level_skip"))
    fits = (F.col("level_count") >= 1) & (low >= 0) & (F.col("level_skip") >= 0) & (F.col("tile_size") >= 1)
    levels = both.where(F.assert_true(fits, F.lit("level window outside the asset's levels")).isNull()).withColumn(
        "level", F.explode(F.sequence(low, high - 1))
    )
    untiled = R.untiled(F.col("flags"))
    levels = levels.withColumns({
        "untiled": untiled,
        "w": L.level_dim(F.col("root_w"), F.col("levels"), F.col("level")),
        "h": L.level_dim(F.col("root_h"), F.col("levels"), F.col("level")),
    })
    levels = levels.withColumns({
        "cols": L.grid(F.col("w"), F.col("tile_size"), untiled), "rows": L.grid(F.col("h"), F.col("tile_size"), untiled),
    }).withColumn("tiles", F.col("face_count").cast("bigint") * F.col("cols") * F.col("rows"))
    before = Window.partitionBy("asset_id").orderBy("group", "level").rowsBetween(Window.unboundedPreceding, -1)
    return levels.withColumn("base", F.coalesce(F.sum("tiles").over(before), F.lit(0))).select(*LEVEL)


def totals(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """asset_id, total_tiles, front_matter_len; fails beyond MAX_TILES."""
    count = groups.groupBy("asset_id").agg(F.count(F.lit(1)).alias("group_count"))
    found = levels.groupBy("asset_id").agg(F.sum("tiles").alias("total_tiles")).join(count, "asset_id")
    found = found.where(F.assert_true(F.col("total_tiles") <= MAX_TILES, F.lit("too many tiles")).isNull())
    return found.withColumn("front_matter_len", L.front_matter_len(F.col("group_count"), F.col("total_tiles")))


def dealt(spark) -> int:
    """Tasks that few bytes with much work are dealt out to; a number, as others are joined by their bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _spread(levels: DataFrame) -> DataFrame:
    """Levels cut to runs of lines of tiles, ``first`` to ``last``, of PIECE tiles or one line, dealt out over tasks.

    Few bytes hold very many tiles, so by their bytes all levels would be put into one task.
    """
    lines, step = F.col("face_count") * F.col("rows"), F.greatest(F.lit(1).cast("bigint"), L._div(F.lit(PIECE).cast("bigint"), F.col("cols")))
    pieces = levels.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), lines - 1, F.col("step"))))
    return pieces.withColumn("last", F.least(F.col("first") + F.col("step"), lines) - 1).drop("step").repartition(dealt(levels.sparkSession), "asset_id", "group", "level", "first")


def enumerate_tiles(levels: DataFrame) -> DataFrame:
    """Every tile in canonical order: group, level, face, row, column; fails beyond MAX_TILES.

    Lines of tiles first, then the tiles of each, so that no row holds all of a
    level. Further columns of ``levels`` are carried over.
    """
    more = [c for c in levels.columns if c not in LEVEL]
    fits = F.assert_true(F.col("base") + F.col("tiles") <= MAX_TILES, F.lit("too many tiles")).isNull()
    line = _spread(levels.where(fits)).withColumn("line", F.explode(F.sequence("first", "last")))
    each = line.withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)))
    return each.select(
        "asset_id", "group", "level", L._div(F.col("line"), F.col("rows")).cast("int").alias("face"), (F.col("line") % F.col("rows")).alias("row"),
        "col", (F.col("base") + F.col("line") * F.col("cols") + F.col("col")).alias("ordinal"),
        "w", "h", "tile_size", "untiled", *more,
    ).withColumns({
        "tile_w": L.tile_dim(F.col("w"), F.col("tile_size"), F.col("col"), F.col("untiled")),
        "tile_h": L.tile_dim(F.col("h"), F.col("tile_size"), F.col("row"), F.col("untiled")),
    }).drop("w", "h", "tile_size", "untiled")


def with_ordinal(places: DataFrame, levels: DataFrame) -> DataFrame:
    """``places`` (asset_id, group, level, face, row, col) with their ordinal, NULL outside the layout."""
    known = levels.select("asset_id", "group", "level", "face_count", "cols", "rows", "base")
    found = places.join(known, ["asset_id", "group", "level"], "left")
    valid = F.col("face").between(0, F.col("face_count") - 1) & F.col("row").between(0, F.col("rows") - 1) & F.col("col").between(0, F.col("cols") - 1)
    ordinal = F.col("base") + F.col("face") * F.col("cols") * F.col("rows") + F.col("row") * F.col("cols") + F.col("col")
    return found.withColumn("ordinal", F.when(valid, ordinal)).drop("face_count", "cols", "rows", "base")


def with_place(ordinals: DataFrame, levels: DataFrame) -> DataFrame:
    """``ordinals`` (asset_id, ordinal) with group, level, face, row, col; NULL outside the layout."""
    own, known = ordinals.alias("o"), levels.alias("l")
    match = (F.col("o.asset_id") == F.col("l.asset_id")) & (F.col("o.ordinal") >= F.col("l.base")) & (
        F.col("o.ordinal") < F.col("l.base") + F.col("l.tiles"))
    area, i = F.col("l.cols") * F.col("l.rows"), F.col("o.ordinal") - F.col("l.base")
    return own.join(known, match, "left").select(
        "o.*", "l.group", "l.level", L._div(i, area).cast("int").alias("face"), L._div(i % area, F.col("l.cols")).alias("row"),
        (i % area % F.col("l.cols")).alias("col"),
    )


def group_runs(levels: DataFrame) -> DataFrame:
    """First ordinal of each group, and the one after its last."""
    return levels.groupBy("asset_id", "group").agg(
        F.min("base").alias("run_start"), F.max(F.col("base") + F.col("tiles")).alias("run_end"))


def level_runs(levels: DataFrame) -> DataFrame:
    return levels.select("asset_id", "group", "level", F.col("base").alias("run_start"), (F.col("base") + F.col("tiles")).alias("run_end"))


def inconsistent(assets: DataFrame) -> DataFrame:
    """assets with the first rule that their header breaks (NULL: none)."""
    broken = (
        F.when(~F.col("face_count").isin(1, 6), "face_count").when(F.col("levels") < 1, "levels").when(F.col("group_count") < 1, "group_count")
        .when(F.col("tile_size") < 1, "tile_size").when((F.col("root_w") < 1) | (F.col("root_h") < 1), "root")
        .when((F.col("face_count") == 6) & (F.col("root_w") != F.col("root_h")), "cubemap not square")
    )
    return assets.withColumn("broken", broken)
