"""Per-pixel arithmetic: 16-bit packing, radiometry, cube faces and their sources."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import _div


def split16_pack(count: Column) -> tuple[Column, Column, Column]:
    """r, g, b of a 16-bit count: high byte, low byte, zero."""
    return F.shiftright(count, 8), count.bitwiseAND(255), F.lit(0)


def split16_unpack(r: Column, g: Column) -> Column:
    """The count of packed bytes; blue is ignored."""
    return F.shiftleft(r, 8).bitwiseOR(g)


def physical(count: Column, scale: Column, offset: Column, nodata: Column) -> Column:
    """count * scale + offset; NaN where the count is the nodata value."""
    return F.when(count == nodata, F.lit(float("nan"))).otherwise(count * scale + offset)


def gray8(count: Column) -> Column:
    """A count narrowed to 8 bits, modulo 256."""
    return count.bitwiseAND(255)


def gray_rgb(gray: Column) -> tuple[Column, Column, Column]:
    """r, g, b of a gray value."""
    return gray, gray, gray


def texel(at: Column, n: Column) -> Column:
    """Centre of texel ``at`` of ``n``, from -1 to 1."""
    return 2.0 * (at.cast("double") + 0.5) / n.cast("double") - 1.0


def face_direction(face: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """x, y, z of the point (a, b) of a cube face."""
    one = F.lit(1.0)
    # fixed values: the axes of the six faces
    table = {0: (-one, -a, -b), 1: (one, a, -b), 2: (-a, one, -b), 3: (a, -one, -b), 4: (b, -a, -one), 5: (-b, -a, one)}

    def pick(axis: int) -> Column:
        found = F.lit(None).cast("double")
        for number, direction in table.items():
            found = F.when(face == number, direction[axis]).otherwise(found)
        return found

    return pick(0), pick(1), pick(2)


def direction_face(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """face, a, b that a direction points at: the largest axis, x before y before z; the zero vector gives NaN."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    by_x = (ax >= ay) & (ax >= az)
    by_y = ~by_x & (ay >= az)
    face = (
        F.when(by_x, F.when(x < 0, 0).otherwise(1)).when(by_y, F.when(y > 0, 2).otherwise(3)).otherwise(F.when(z < 0, 4).otherwise(5))
    )
    part = lambda top, below: F.coalesce(top * F.try_divide(F.lit(1.0), F.abs(below)), F.lit(float("nan")))
    a = F.when(by_x, part(F.when(x < 0, -y).otherwise(y), x)).when(by_y, part(F.when(y > 0, -x).otherwise(x), y)).otherwise(part(-y, z))
    b = F.when(by_x, part(-z, x)).when(by_y, part(-z, y)).otherwise(part(F.when(z < 0, x).otherwise(-x), z))
    return face, a, b


def source_coordinates(face: Column, a: Column, b: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixel of a 2:1 panorama that a face point comes from, as 32-bit floats."""
    x, y, z = face_direction(face, a, b)
    turn = F.atan2(y, x)
    # atan2 takes no notice of a zero's sign here, which matters straight up: the negative zero lies at half a turn
    poles = F.when(x.cast("string") == "-0.0", math.pi).otherwise(0.0)
    lon = F.when((x == 0) & (y == 0), poles).when(turn < 0, turn + 2 * math.pi).otherwise(turn)
    up = z / F.sqrt(x * x + y * y + z * z)
    lat = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), up)))
    sx = width.cast("double") * lon / (2 * math.pi) - 0.5
    sy = height.cast("double") * lat / math.pi - 0.5
    return sx.cast("float"), sy.cast("float")


def half(at: Column) -> Column:
    return _div(at.cast("bigint"), F.lit(2).cast("bigint")).cast("int")
