"""Shared helpers: reading tables, durable intermediates, text to bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, only a
    local master gets a folder of its own; on a cluster the setting is needed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="tesserae-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return "file://" + _LOCAL_DIR[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, hashed: bool = False) -> list:
    """All columns of ``df``, whatever their names; ``hashed``: only those that can be hashed (no maps)."""
    return [F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if not hashed or "map<" not in f.dataType.simpleString()]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written out with a number for each row, and the name of that column.

    Ids of documents may be null or repeated, these numbers are not; they are
    made once and read back, so they stay if a task runs again.
    """
    name = unused(df, "row")
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def remainder(doc_id, n: int):
    """crc32 of the decimal doc_id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    import pyarrow as pa

    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in binary.to_pylist()]


#: Bytes of text that a worker turns into Python objects at once (a longer text makes a slice of its own), and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096


def slices(batches, column: int):
    """Runs of rows of Arrow batches with the bytes of their texts, so that no whole batch is held as Python objects."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at
            part = batch.slice(at, max(1, min(n, SLICE_ROWS)))
            yield part, as_bytes(part.column(column))
            at += part.num_rows
