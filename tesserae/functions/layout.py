"""Pyramid geometry as column expressions, in 64-bit integers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column) -> Column:
    return x.cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def dim_at(root: Column, shift: Column) -> Column:
    """Root size halved ``shift`` times, rounded up; 1 from 32 halvings on."""
    s = F.least(shift.cast("int"), F.lit(32))
    part = F.call_function("shiftright", _long(root) + F.call_function("shiftleft", F.lit(1).cast("bigint"), s) - 1, s)
    return F.when(shift >= 32, F.lit(1).cast("bigint")).otherwise(part)


def level_dim(root: Column, levels: Column, level: Column) -> Column:
    return dim_at(root, levels - 1 - level)


def grid(size: Column, tile_size: Column, untiled: Column | None = None) -> Column:
    """Tiles along a side; one where the group is untiled."""
    n = _div(_long(size) + _long(tile_size) - 1, _long(tile_size))
    return n if untiled is None else F.when(untiled, F.lit(1).cast("bigint")).otherwise(n)


def tile_dim(size: Column, tile_size: Column, at: Column, untiled: Column) -> Column:
    """Pixels of tile number ``at`` along a side: the rest at the edge, never under one."""
    rest = F.least(_long(tile_size), _long(size) - _long(at) * _long(tile_size))
    return F.when(untiled, _long(size)).otherwise(F.greatest(F.lit(1).cast("bigint"), rest))


def level_range(levels: Column, level_count: Column, level_skip: Column) -> tuple[Column, Column]:
    """First level that a group covers, and the one after its last."""
    return levels - level_skip - level_count, levels - level_skip


def levels_for(w: Column, h: Column, tile_size: Column) -> Column:
    """Levels until the coarsest fits one tile; raises for a tile size under one."""
    side = F.greatest(_long(w), _long(h))
    fits = F.filter(F.sequence(F.lit(0), F.lit(32)), lambda s: dim_at(side, s) <= tile_size)
    checked = F.when(tile_size >= 1, F.array_min(fits)).otherwise(F.raise_error(F.lit("tile size must be at least 1")).cast("int"))
    return checked + 1


def front_matter_len(group_count: Column, total_tiles: Column) -> Column:
    return F.lit(24) + 48 * _long(group_count) + 8 * (_long(total_tiles) + 1)


def nearest_level_size(face: Column, levels: Column, native: Column) -> Column:
    """The level size nearest ``native``; of equally near ones that of the coarsest level."""
    sizes = F.transform(F.sequence(F.lit(0), levels - 1), lambda level: level_dim(face, levels, level))
    ranked = F.transform(sizes, lambda d, i: F.struct(F.abs(d - native).alias("off"), i.alias("level"), d.alias("size")))
    return F.when(levels < 1, _long(face)).otherwise(F.array_min(ranked)["size"])
