"""Code registries, flags and unit labels of band groups, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The format's registries.
SEMANTICS = {0: "rgb", 1: "nir", 2: "tir", 3: "depth"}
CODECS = {0: "jpeg", 1: "webp", 2: "webp-split16", 3: "depthpack", 4: "jpegxl"}
SAMPLES = {0: "rgb8", 1: "gray8", 2: "u16"}
FACES = {0: "front", 1: "back", 2: "left", 3: "right", 4: "down", 5: "up"}
UNTILED, NEAREST = 1, 2
JPEG, WEBP, SPLIT16 = 0, 1, 2
#: Codec numbers of our own payloads; the format has assigned none of them.
RAW, DEFLATED = 200, 201


def name(code: Column, registry: dict[int, str], other: str = "other") -> Column:
    """The name of a code; unknown codes keep their number and are ``other``."""
    found = F.lit(None).cast("string")
    for number, text in registry.items():
        found = F.when(code == number, text).otherwise(found)
    return F.coalesce(found, F.lit(other))


def code(text: Column, registry: dict[int, str]) -> Column:
    found = F.lit(None).cast("int")
    for number, value in registry.items():
        found = F.when(text == value, number).otherwise(found)
    return found


def untiled(flags: Column) -> Column:
    return flags.bitwiseAND(UNTILED) != 0


def nearest(flags: Column) -> Column:
    return flags.bitwiseAND(NEAREST) != 0


def flags(is_untiled: bool, is_nearest: bool) -> int:
    return UNTILED * is_untiled | NEAREST * is_nearest


def unit_label(unit: Column) -> Column:
    """Text of an 8-byte unit up to its padding; NULL where it is not UTF-8."""
    return F.try_validate_utf8(F.rtrim(unit.cast("string"), F.lit("\x00")))


def unit_bytes(label: Column) -> Column:
    """A label as 8 bytes, cut or padded with zeros."""
    return F.unhex(F.rpad(F.hex(F.substring(label.cast("binary"), 1, 8)), 16, "0"))


def sniff_codec(blob: Column) -> Column:
    """Codec number by the first bytes: 0 jpeg, 1 webp, else NULL."""
    head = lambda at, n: F.hex(F.substring(blob, at, n))
    return F.when(head(1, 3) == "FFD8FF", 0).when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), 1)
