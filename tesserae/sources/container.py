"""Bytes of containers, and a Spark data source that reads and writes them.

``spark.read.format("tiles").load(path)`` gives one row a tile. Planning reads
each file's front matter only; a task seeks to the bytes of its own tiles, and
to none where ``includeBlob`` is false (``blobBytes`` reads so many of each at
most). Filters on group, level, face, row and col are applied to the index
before any blob is read. Writing groups rows by asset on the way in and stores
one file an asset. ``scan`` reads folders of so many files that their front
matter is better read by tasks, too. Paths are those of pyarrow's file systems
(a plain path, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import bisect
import struct
from array import array
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION = b"TPCK", 1
HEADER_LEN, DESCRIPTOR_LEN = 24, 48
MAX_TILES = 67_108_864
_HEADER = struct.Struct("<4sBBBBHxxIIxxxx")
_DESCRIPTOR = struct.Struct("<BBBBBBxxddHHHxx8s8x")

SCHEMA = ("asset string, `group` int, level int, face int, row bigint, col bigint, ordinal bigint,"
          " start_off bigint, end_off bigint, blob binary")


class FormatError(ValueError):
    """Bytes or parameters that the format does not allow; ``needed``: bytes that would be enough to go on."""

    def __init__(self, kind: str, needed: int | None = None):
        super().__init__(kind if needed is None else f"{kind}: {needed} bytes needed")
        self.kind, self.needed = kind, needed

    def __reduce__(self):
        return type(self), (self.kind, self.needed)


@dataclass(frozen=True)
class Header:
    face_count: int
    levels: int
    tile_size: int
    root_w: int
    root_h: int
    group_count: int = 0

    def check(self) -> None:
        if self.face_count not in (1, 6):
            raise FormatError("face_count")
        for name in ("levels", "group_count", "tile_size", "root_w", "root_h"):
            if getattr(self, name) < 1:
                raise FormatError(name)
        if self.face_count == 6 and self.root_w != self.root_h:
            raise FormatError("cubemap not square")

    def to_bytes(self) -> bytes:
        self.check()
        try:
            return _HEADER.pack(MAGIC, VERSION, self.face_count, self.levels, self.group_count, self.tile_size, self.root_w, self.root_h)
        except struct.error as e:
            raise FormatError(f"header: {e}") from e

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER_LEN:
            raise FormatError("truncated", HEADER_LEN)
        magic, version, faces, levels, groups, tile, w, h = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise FormatError("magic")
        if version != VERSION:
            raise FormatError("version")
        found = cls(faces, levels, tile, w, h, groups)
        found.check()
        return found


@dataclass(frozen=True)
class Group:
    semantic: int = 0
    codec: int = 0
    sample: int = 0
    flags: int = 0
    level_count: int = 1
    level_skip: int = 0
    scale: float = 0.0
    offset: float = 0.0
    nodata: int = 0
    min: int = 0
    max: int = 0
    unit: bytes = b""

    @property
    def untiled(self) -> bool:
        return bool(self.flags & 1)

    @property
    def unit_label(self) -> str | None:
        try:
            return self.unit.rstrip(b"\0").decode()
        except UnicodeDecodeError:
            return None

    def check(self, levels: int) -> None:
        if not 1 <= self.level_count <= levels or not 0 <= self.level_skip <= levels - self.level_count:
            raise FormatError("level window")

    def to_bytes(self, levels: int) -> bytes:
        self.check(levels)
        try:
            return _DESCRIPTOR.pack(
                self.semantic, self.codec, self.sample, self.flags, self.level_count, self.level_skip, self.scale, self.offset,
                self.nodata, self.min, self.max, self.unit[:8])
        except struct.error as e:
            raise FormatError(f"descriptor: {e}") from e

    @classmethod
    def parse(cls, data: bytes, at: int = 0) -> Group:
        if len(data) - at < DESCRIPTOR_LEN:
            raise FormatError("truncated", at + DESCRIPTOR_LEN)
        return cls(*_DESCRIPTOR.unpack_from(data, at))


def halved(side: int, times: int) -> int:
    return 1 if times >= 32 else -(-side >> times) if side < 0 else (side + (1 << times) - 1) >> times


@dataclass
class Layout:
    """Runs of ordinals of a header's groups and levels."""

    header: Header
    groups: list[Group]
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # base, group, level, cols, rows

    def __post_init__(self):
        h, base = self.header, 0
        if len(self.groups) > 255:
            raise FormatError("group count")
        for number, g in enumerate(self.groups):
            g.check(h.levels)
            high = h.levels - g.level_skip
            for level in range(high - g.level_count, high):
                w, t = self.level_dims(level), h.tile_size
                cols, rows = (1, 1) if g.untiled else (-(-w[0] // t), -(-w[1] // t))
                self.runs.append((base, number, level, cols, rows))
                base += h.face_count * cols * rows
                if base > MAX_TILES:
                    raise FormatError("too many tiles")
        self.total = base
        self.front_len = HEADER_LEN + DESCRIPTOR_LEN * len(self.groups) + 8 * (base + 1)
        self._at = {(g, level): (b, cols, rows) for b, g, level, cols, rows in self.runs}
        self._bases = [r[0] for r in self.runs]

    def level_dims(self, level: int) -> tuple[int, int]:
        s = self.header.levels - 1 - level
        return halved(self.header.root_w, s), halved(self.header.root_h, s)

    def ordinal(self, group: int, level: int, face: int, row: int, col: int) -> int | None:
        base, cols, rows = self._at.get((group, level), (0, 0, 0))
        if not (0 <= face < self.header.face_count and 0 <= row < rows and 0 <= col < cols):
            return None
        return base + (face * rows + row) * cols + col

    def place(self, ordinal: int) -> tuple[int, int, int, int, int] | None:
        if not 0 <= ordinal < self.total:
            return None
        base, group, level, cols, rows = self.runs[bisect.bisect_right(self._bases, ordinal) - 1]
        face, inside = divmod(ordinal - base, cols * rows)
        return group, level, face, *divmod(inside, cols)


def required_len(prefix: bytes) -> int:
    """How many bytes of a file are needed next: header, descriptors, or the whole front matter."""
    if len(prefix) < HEADER_LEN:
        return HEADER_LEN
    header = Header.parse(prefix)
    end = HEADER_LEN + DESCRIPTOR_LEN * header.group_count
    return end if len(prefix) < end else _layout(header, prefix).front_len


def _layout(header: Header, data: bytes) -> Layout:
    return Layout(header, [Group.parse(data, HEADER_LEN + DESCRIPTOR_LEN * i) for i in range(header.group_count)])


@dataclass
class FrontMatter:
    layout: Layout
    offsets: list[int]

    @property
    def file_len(self) -> int:
        return self.offsets[-1]

    @classmethod
    def parse(cls, data: bytes) -> FrontMatter:
        needed = required_len(data)
        while len(data) >= needed:
            layout = _layout(Header.parse(data), data) if needed > HEADER_LEN else None
            if layout and len(data) >= layout.front_len:
                break
            following = required_len(data[:needed] if layout is None else data)
            if following == needed:
                break
            needed = following
        if len(data) < needed:
            raise FormatError("truncated", needed)
        layout = _layout(Header.parse(data), data)
        offsets = list(struct.unpack_from(f"<{layout.total + 1}Q", data, layout.front_len - 8 * (layout.total + 1)))
        if offsets[0] != layout.front_len or any(b < a for a, b in zip(offsets, offsets[1:])) or offsets[-1] >= 1 << 63:
            raise FormatError("index")
        return cls(layout, offsets)

    @classmethod
    def whole(cls, data: bytes) -> FrontMatter:
        """Front matter of a whole file, which must hold all of its bytes; more may follow."""
        found = cls.parse(data)
        if len(data) < found.file_len:
            raise FormatError("truncated", found.file_len)
        return found

    @classmethod
    def read(cls, stream) -> FrontMatter:
        """From a seekable stream, reading no more than the front matter."""
        data = b""
        while (needed := required_len(data)) > len(data):
            more = stream.read(needed - len(data))
            if not more:
                raise FormatError("truncated", needed)
            data += more
        return cls.parse(data)

    def tile_range(self, *place: int) -> tuple[int, int] | None:
        ordinal = self.layout.ordinal(*place)
        return None if ordinal is None else self.ordinal_range(ordinal)

    def ordinal_range(self, ordinal: int) -> tuple[int, int] | None:
        start, end = self.offsets[ordinal], self.offsets[ordinal + 1]
        return (start, end) if end > start else None

    def level_range(self, group: int, level: int) -> tuple[int, int] | None:
        if (found := self.layout._at.get((group, level))) is None:
            return None
        base, cols, rows = found
        return self.offsets[base], self.offsets[base + self.layout.header.face_count * cols * rows]


class Builder:
    """Collects blobs of one container and gives its bytes."""

    def __init__(self, header: Header, groups: list[Group]):
        header = replace(header, group_count=len(groups))
        if len(groups) > 255:
            raise FormatError("group count")
        header.check()
        self.header, self.groups = header, groups
        self.layout = Layout(header, groups)
        self.blobs: dict[int, bytes] = {}
        self.cursor = 0

    def set_ordinal(self, ordinal: int, blob: bytes | None) -> None:
        if not 0 <= ordinal < self.layout.total:
            raise FormatError("tile outside the layout")
        self.blobs[ordinal] = blob or b""

    def set_tile(self, place: tuple[int, int, int, int, int], blob: bytes | None) -> None:
        ordinal = self.layout.ordinal(*place)
        self.set_ordinal(-1 if ordinal is None else ordinal, blob)

    def push(self, blob: bytes | None) -> None:
        self.set_ordinal(self.cursor, blob)
        self.cursor += 1

    def front(self, sizes: list[int]) -> bytes:
        offsets = [self.layout.front_len]
        for size in sizes:
            offsets.append(offsets[-1] + size)
        head = self.header.to_bytes() + b"".join(g.to_bytes(self.header.levels) for g in self.groups)
        return head + struct.pack(f"<{len(offsets)}Q", *offsets)

    def finish(self) -> bytes:
        blobs = [self.blobs.get(i, b"") for i in range(self.layout.total)]
        return self.front([len(b) for b in blobs]) + b"".join(blobs)


def _system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Names of the files of a folder and its folders, or of a single file; hidden ones are left out."""
    from pyarrow import fs

    system, at = _system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    base = at.rstrip("/")
    found = (x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File)
    names = sorted(x[len(base) + 1 :] if x.startswith(base + "/") else x for x in found)
    return [f"{path.rstrip('/')}/{n}" for n in names if not any(part.startswith(("_", ".")) for part in n.split("/"))]


def _open(path: str):
    system, at = _system(path)
    return system.open_input_file(at)


def _asset(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class TileRun(InputPartition):
    """Tiles ``first`` to ``last`` of a file, with their offsets, so that no task reads the index again."""

    path: str
    first: int
    last: int
    layout: Layout
    offsets: array


def _runs(path: str, wanted: dict[int, set[int]], run_bytes: int):
    """Runs of tiles of about ``run_bytes`` bytes or 100,000 tiles; levels that no filter lets pass are left out."""
    with _open(path) as f:
        front = FrontMatter.read(f)
    faces = front.layout.header.face_count
    for base, group, level, cols, rows in front.layout.runs:
        if group not in wanted.get(0, {group}) or level not in wanted.get(1, {level}):
            continue
        first, end = base, base + faces * cols * rows
        while first < end:
            last = bisect.bisect_right(front.offsets, front.offsets[first] + run_bytes, first + 1, min(end, first + 100_000))
            last = max(first + 1, last)
            yield TileRun(path, first, last, front.layout, array("Q", front.offsets[first : last + 1]))
            first = last


def _rows(run: TileRun, wanted: dict[int, set[int]], most: int | None):
    """Rows of a run's tiles, with ``most`` bytes of each blob (None: all)."""
    asset = _asset(run.path)
    with _open(run.path) as f:
        for i in range(run.last - run.first):
            place = run.layout.place(run.first + i)
            if any(place[at] not in some for at, some in wanted.items()):
                continue
            start, end = run.offsets[i], run.offsets[i + 1]
            blob = None
            if end > start and most != 0:
                n = end - start if most is None else min(most, end - start)
                f.seek(start)
                blob = f.read(n)
                if len(blob) < n:
                    raise FormatError("truncated", end)
            yield (asset, *place, run.first + i, start, end, blob)


class TileReader(DataSourceReader):
    COLUMNS = {("group",): 0, ("level",): 1, ("face",): 2, ("row",): 3, ("col",): 4}

    def __init__(self, options):
        self.path = options["path"]
        most = options.get("blobBytes")
        self.most = 0 if options.get("includeBlob", "true").lower() == "false" else None if most is None else int(most)
        self.run_bytes = int(options.get("runBytes", 64_000_000))
        self.wanted: dict[int, set[int]] = {}

    def pushFilters(self, filters):
        for f in filters:
            at = self.COLUMNS.get(getattr(f, "attribute", None))
            if at is not None and isinstance(f, EqualTo):
                self.wanted[at] = self.wanted.get(at, {f.value}) & {f.value}
            elif at is not None and isinstance(f, In):
                self.wanted[at] = self.wanted.get(at, set(f.value)) & set(f.value)
            else:
                yield f

    def partitions(self):
        """Runs of all files, whose front matter is read by several threads."""
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(16) as pool:
            found = pool.map(lambda path: list(_runs(path, self.wanted, self.run_bytes)), _files(self.path))
            return [run for runs in found for run in runs]

    def read(self, partition):
        yield from _rows(partition, self.wanted, self.most)


def scan(spark: SparkSession, path: str, blob_bytes: int | None = None, run_bytes: int = 64_000_000) -> DataFrame:
    """The rows of ``format("tiles")`` of a folder of very many files: tasks read the front matter, and others the tiles.

    Spark lists the files (``binaryFile``, names only); runs of tiles are dealt
    evenly. ``blob_bytes`` are read of each blob at most.
    """
    import pickle

    def plan(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                for run in _runs(name, {}, run_bytes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([run.first]), pa.array([pickle.dumps(run)], pa.binary())], names=["path", "first", "run"])

    def read(batches):
        import pyarrow as pa

        names = ["asset", "group", "level", "face", "row", "col", "ordinal", "start_off", "end_off", "blob"]
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            for run in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in _rows(pickle.loads(run), {}, blob_bytes):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) == 10_000 or size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    runs = files.mapInArrow(plan, "path string, first bigint, run binary")
    return runs.repartition("path", "first").select("run").mapInArrow(read, SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TileWriter(DataSourceWriter):
    """Files from the rows of ``pack``: an asset's parts follow each other and are appended as they come (``suffix``: of the names).

    Files are written to a folder of the job and moved into place when all
    tasks have ended. What attempts that failed have left goes with that folder.
    """

    def __init__(self, options):
        import uuid

        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".tpc")
        self.stage = f"{self.path}/_{uuid.uuid4().hex}"

    def write(self, rows):
        import uuid

        system, stage = _system(self.stage)
        system.create_dir(stage, recursive=True)
        done, now, f = [], None, None
        try:
            for row in rows:
                if f is None or row["asset"] != now:
                    if f:
                        f.close()
                    now = row["asset"]
                    part = f"{stage}/{uuid.uuid4().hex}"
                    f = system.open_output_stream(part)
                    done.append((part, f"{now}{self.suffix}"))
                f.write(row["content"])
        finally:
            if f:
                f.close()
        return Written(done)

    def commit(self, messages):
        system, at = _system(self.path)
        for message in messages:
            for part, name in message.files if message else ():
                system.move(part, f"{at}/{name}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        system, stage = _system(self.stage)
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


class TileSource(DataSource):
    @classmethod
    def name(cls):
        return "tiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TileReader(self.options)

    def writer(self, schema, overwrite):
        return TileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("tiles")`` known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)


#: Entries of the index in one row of ``pack``.
CHUNK = 8192


def pack(tiles: DataFrame, assets: DataFrame, groups: DataFrame) -> DataFrame:
    """(asset, part, content) of each asset from its tiles (asset_id, ordinal, blob), in the order of the file.

    Parts below zero are the front matter: the header with its descriptors,
    then CHUNK entries of the index each; the others are blobs by ordinal. No
    row holds more than one of these, so neither a container nor its index need
    fit in memory. Each asset's rows are in one partition.
    """
    from ..operators import layout
    from ..operators import tiles as index

    names = ["semantic", "codec", "sample", "flags", "level_count", "level_skip", "scale", "offset", "nodata", "min", "max", "unit"]
    described = groups.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("group", *names))).alias("groups"))
    whole = assets.join(described, "asset_id").select(
        F.col("asset_id").cast("string").alias("asset"), "face_count", "levels", "tile_size", "root_w", "root_h", "groups")

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                header = Header(*(row[n] for n in ("face_count", "levels", "tile_size", "root_w", "root_h")))
                built = Builder(header, [Group(*(g[n] for n in names)) for g in row["groups"]])
                content = built.header.to_bytes() + b"".join(g.to_bytes(header.levels) for g in built.groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["asset"]], pa.string()), pa.array([-(1 << 40)], pa.int64()), pa.array([content], pa.binary())], names=["asset", "part", "content"])

    levels = layout.level_table(assets, groups)
    every = layout.enumerate_tiles(levels).select("asset_id", "ordinal", F.lit(True).alias("known"))
    present = tiles.where(F.octet_length("blob") > 0).select("asset_id", F.col("ordinal").cast("bigint").alias("ordinal"), "blob")
    given = present.groupBy("asset_id", "ordinal").agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("blob")).cast("bigint").alias("n_bytes"))
    placed = every.join(given, ["asset_id", "ordinal"], "full")
    placed = placed.where(F.assert_true(F.col("known"), F.lit("tile outside the layout")).isNull())
    placed = placed.where(F.assert_true(F.coalesce("times", F.lit(1)) == 1, F.lit("tile given twice")).isNull())
    offsets = index.offset_index(placed.select("asset_id", "ordinal", "n_bytes"), layout.totals(levels, groups).select("asset_id", "front_matter_len"))
    last = Window.partitionBy("asset_id").orderBy(F.desc("chunk"))
    chunks = offsets.groupBy("asset_id", F.floor(F.col("ordinal") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "start_off"))).alias("x"), F.max("end_off").alias("end"))
    chunks = chunks.withColumn("nth", F.row_number().over(last)).select(
        F.col("asset_id").cast("string").alias("asset"), (F.col("chunk") - (1 << 39)).cast("bigint").alias("part"),
        F.when(F.col("nth") == 1, F.concat(F.col("x.start_off"), F.array("end"))).otherwise(F.col("x.start_off")).alias("offsets"))

    def entries(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            content = [np.asarray(x, "<u8").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary())], names=["asset", "part", "content"])

    schema = "asset string, part bigint, content binary"
    bodies = present.select(F.col("asset_id").cast("string").alias("asset"), F.col("ordinal").alias("part"), F.col("blob").alias("content"))
    rows = whole.mapInArrow(heads, schema).unionByName(chunks.mapInArrow(entries, schema)).unionByName(bodies)
    return rows.repartition("asset").sortWithinPartitions("asset", "part")


def parse(files: DataFrame) -> DataFrame:
    """Rows of whole files (asset, content) as rows of tiles; works on streams too."""

    def run(batches):
        import pyarrow as pa

        names = ["asset", "group", "level", "face", "row", "col", "ordinal", "start_off", "end_off", "blob"]
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            for asset, content in zip(*(c.to_pylist() for c in batch.columns)):
                front = FrontMatter.whole(content)
                for at in range(0, front.layout.total, 10_000):
                    rows = []
                    for i in range(at, min(at + 10_000, front.layout.total)):
                        start, end = front.offsets[i : i + 2]
                        rows.append((asset, *front.layout.place(i), i, start, end, content[start:end] or None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select(F.col("asset").cast("string").alias("asset"), "content").mapInArrow(run, SCHEMA)
