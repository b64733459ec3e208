"""Deep Zoom archives to tile relations.

Archives arrive as rows of Spark's ``binaryFile`` source (path, content). An
archive is read by one task, as a ZIP's directory is at its end; its tiles are
rows from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import registry as R

#: Letters of the six faces in archives.
LETTERS = {"f": 0, "b": 1, "l": 2, "r": 3, "d": 4, "u": 5}
ENTRIES = ("asset_id bigint, name string, tile_size int, overlap int, width bigint, height bigint,"
           " level bigint, col bigint, row bigint, seq int, blob binary")


def descriptor(xml: bytes) -> dict:
    """TileSize (kept to 16 bits), Overlap (default 0), Width and Height of a .dzi file."""
    import xml.etree.ElementTree as ET

    local = lambda tag: tag.rsplit("}", 1)[-1]
    found: dict = {"overlap": 0}
    for node in ET.fromstring(xml).iter():
        if local(node.tag) == "Image":
            found["tile_size"] = int(node.attrib["TileSize"]) & 0xFFFF
            found["overlap"] = int(node.attrib.get("Overlap", 0))
        elif local(node.tag) == "Size":
            found["width"], found["height"] = int(node.attrib["Width"]), int(node.attrib["Height"])
    if missing := {"tile_size", "width", "height"} - found.keys():
        raise ValueError(f"descriptor lacks {sorted(missing)}")
    return found


def tile_place(path: str) -> tuple[str, int, int, int] | None:
    """name, level, column and row of a tile's path, or None for other files; one wrapping folder is allowed."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if len(parts) not in (3, 4):
        return None
    folder, level, tile = parts[-3:]
    numbers = tile.split(".")[0].split("_")
    digits = [level, *numbers[:2]]
    if not folder.endswith("_files") or len(digits) < 3 or not all(d.isascii() and d.isdigit() for d in digits):
        return None
    return folder.removesuffix("_files"), *map(int, digits)


def _entries(batches):
    import io
    import zipfile

    import pyarrow as pa

    schema = pa.schema([
        ("asset_id", pa.int64()), ("name", pa.string()), ("tile_size", pa.int32()), ("overlap", pa.int32()), ("width", pa.int64()),
        ("height", pa.int64()), ("level", pa.int64()), ("col", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("blob", pa.binary())])
    for batch in batches:
        for asset_id, content in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for seq, entry in enumerate(archive.infolist()):
                    if entry.is_dir():
                        continue
                    last = entry.filename.replace("\\", "/").rsplit("/", 1)[-1]
                    row = {"asset_id": asset_id, "seq": seq}
                    if last.endswith(".dzi"):
                        rows.append(row | {"name": last.removesuffix(".dzi")} | descriptor(archive.read(entry)))
                    elif place := tile_place(entry.filename):
                        rows.append(row | dict(zip(("name", "level", "col", "row"), place)) | {"blob": archive.read(entry)})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptors and tiles of archives (asset_id, content); of entries for one thing the last in the archive wins."""
    entries = files.select(F.col("asset_id").cast("bigint").alias("asset_id"), "content").mapInArrow(_entries, ENTRIES)
    last = lambda value: F.max_by(value, "seq")
    infos = entries.where("level IS NULL").groupBy("asset_id", "name").agg(
        last(F.struct("tile_size", "overlap", "width", "height")).alias("i")).select("asset_id", "name", "i.*")
    tiles = entries.where("level IS NOT NULL").groupBy("asset_id", "name", "level", "col", "row").agg(last("blob").alias("blob"))
    return infos, tiles


def plans(infos: DataFrame, tiles: DataFrame) -> DataFrame:
    """How each archive is laid out, by its front face: kind, geometry, levels kept and dropped, and what forbids it."""
    names = tiles.groupBy("asset_id").agg(F.collect_set("name").alias("names"))
    cube = F.forall(F.array(*map(F.lit, LETTERS)), lambda x: F.array_contains("names", x))
    names = names.withColumn("kind", F.when(cube, "cube").when(F.size("names") == 1, "planar"))
    names = names.withColumn("name", F.when(F.col("kind") == "cube", "f").otherwise(F.get("names", F.lit(0))))
    finest = tiles.groupBy("asset_id", "name").agg(F.max("level").alias("finest"))
    found = names.join(infos, ["asset_id", "name"], "left").join(finest, ["asset_id", "name"], "left")
    found = found.withColumn("levels", F.when(F.col("tile_size") >= 1, L.levels_for(F.col("width"), F.col("height"), F.greatest("tile_size", F.lit(1)))))
    fault = (
        F.when(F.col("kind").isNull(), "neither six faces nor one pyramid").when(F.col("width").isNull(), "no descriptor")
        .when((F.col("kind") == "cube") & (F.col("width") != F.col("height")), "face not square").when(F.col("overlap") != 0, "overlap")
        .when(F.col("tile_size") == 0, "tile size 0").when(F.col("finest") + 1 < F.col("levels"), "too few levels")
    )
    return found.select(
        "asset_id", "kind", F.when(F.col("kind") == "cube", 6).otherwise(1).alias("face_count"), "levels", "tile_size",
        F.col("width").alias("root_w"), F.col("height").alias("root_h"), "finest",
        (F.col("finest") + 1 - F.col("levels")).alias("dropped_coarse_levels"), F.lit(1).alias("group_count"), fault.alias("fault"))


def assemble(plan: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every tile of the layout of each plan without fault, with its blob (NULL: absent) and codec."""
    from .layout import enumerate_tiles, level_table

    good = plan.where("fault IS NULL")
    groups = good.select("asset_id", F.lit(0).alias("group"), F.lit(0).alias("flags"), F.col("levels").alias("level_count"), F.lit(0).alias("level_skip"))
    wanted = enumerate_tiles(level_table(good, groups)).join(good.select("asset_id", "levels", "finest").hint("shuffle_hash"), "asset_id")
    wanted = wanted.withColumn("zoom", F.col("finest") - (F.col("levels") - 1 - F.col("level")))
    face = F.lit(None).cast("int")
    for letter, number in LETTERS.items():
        face = F.when(F.col("name") == letter, number).otherwise(face)
    own = tiles.join(good.select("asset_id", "kind").hint("shuffle_hash"), "asset_id").select(
        "asset_id", F.when(F.col("kind") == "cube", face).otherwise(0).alias("face"), F.col("level").alias("zoom"), "col", "row", "blob")
    found = wanted.join(own, ["asset_id", "face", "zoom", "col", "row"], "left")
    return found.withColumn("codec", R.sniff_codec(F.col("blob"))).drop("levels", "finest", "zoom", "tile_w", "tile_h")


def report(plan: DataFrame, assembled: DataFrame) -> DataFrame:
    """Per archive: tiles copied and absent, levels dropped, codec, notes, and what forbids packing it (NULL: nothing)."""
    there = F.col("blob").isNotNull()
    counts = assembled.groupBy("asset_id").agg(
        F.count_if(there).alias("tiles_copied"), F.count_if(~there).alias("tiles_absent"), F.count_if(there & F.col("codec").isNull()).alias("unknown"),
        F.count_distinct("codec").alias("codecs"), F.min("codec").alias("codec"))
    found = plan.join(counts, "asset_id", "left")
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("unknown") > 0, "a tile is neither jpeg nor webp")
        .when(F.col("codecs") > 1, "mixed codecs").when(F.col("tiles_copied") == 0, "no tiles"))
    odd = (F.col("face_count") == 6) & (F.col("root_w") != F.col("tile_size") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("levels") - 1))
    notes = F.array_compact(F.array(
        F.when(odd, "coarsest level is smaller than a tile"),
        F.when(F.col("tiles_absent") > 0, F.concat(F.col("tiles_absent").cast("string"), F.lit(" tiles absent in source")))))
    return found.withColumn("fault", fault).withColumn("notes", notes).drop("unknown", "codecs", "finest")
