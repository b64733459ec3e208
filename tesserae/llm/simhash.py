"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

``fingerprints`` gives each text its 64-bit SimHash. ``links`` compares
distinct fingerprints: two within RADIUS bits agree on at least BANDS - RADIUS
of BANDS equal bit bands, so each such choice of bands is a bucket key, and
only fingerprints that share a bucket are compared. Buckets are laid into
blocks whose fingerprints are stored as bit planes; a whole block is compared
with many fingerprints at once by carry-save counters of differing bits, and
rows of the block are abandoned once all their lanes exceed the radius.
A bucket of more than BUCKET fingerprints is linked exactly in another way
that stays linear: two fingerprints are within two bits if and only if some
value is within one bit of both, so these fingerprints are grouped by their
one-bit neighbours. ``components`` spreads the smallest label along the links.

Defined results: null and empty texts have no words and the fingerprint zero,
which links like any other; fewer than three words make one shingle; repeated
rows each keep a row; component_id ignores null doc_ids unless a component has
no other. Extra columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Differing bits up to which fingerprints link; the neighbour grouping needs it to be 2.
RADIUS = 2
#: Bands of 16 bits; two of four always agree within two bits.
BANDS = 4
#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints of a bucket that one task compares; larger buckets go by neighbours.
BUCKET = 2048
#: Fingerprints of a compared block.
BLOCK = 1024


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of UTF-8 text."""
    import numpy as np
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < SHINGLE:
        return digest(b" ".join(found), SEED)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE))))
    n = len(found) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.dtype("<u8"), n)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    for batch, texts in common.slices(batches, 1):
        found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def planes(values):
    """Bit planes of an array of uint64: 64 rows of 64-lane words; lanes past the end stay zero."""
    import numpy as np

    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(values, radius: int = RADIUS):
    """Index pairs (i < j) of uint64 values that differ in at most ``radius`` (0 to 2) bits."""
    import numpy as np

    n = len(values)
    store = planes(values)
    full = ~np.uint64(0)
    rows = np.arange(n)
    flip = np.where((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
    valid = np.zeros(store.shape[1] * 64, np.uint8)
    valid[:n] = 1
    spare = ~np.packbits(valid, bitorder="little").view("<u8")
    one = np.zeros((n, store.shape[1]), np.uint64)
    two = np.zeros_like(one)
    over = np.tile(spare, (n, 1))

    def add(x, lane_one, lane_two, lane_over):
        """Add single bits to the two-bit lane counters; a count of four or more sticks in ``over``."""
        carry = lane_one & x
        lane_one ^= x
        lane_over |= lane_two & carry
        lane_two ^= carry

    for b in range(0, 63, 3):
        x, y, z = (store[b + i][None, :] ^ flip[rows, b + i][:, None] for i in range(3))
        half = x ^ y
        add(half ^ z, one, two, over)
        carry = (x & y) | (half & z)
        over |= two & carry
        two ^= carry
        over |= one & two if radius == 2 else two if radius == 1 else one | two
        if b % 9 == 6:
            live = np.flatnonzero((over != full).any(axis=1))
            if len(live) < len(rows):
                rows, one, two, over = rows[live], one[live], two[live], over[live]
            if not len(rows):
                break
    if len(rows):
        add(store[63][None, :] ^ flip[rows, 63][:, None], one, two, over)
        over |= one & two if radius == 2 else two if radius == 1 else one | two
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(near)
    i = rows[i]
    keep = i < j
    return i[keep], j[keep]


def _star(n, i, j):
    """Smallest index that each of n items reaches through the pairs."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def _link_batches(batches):
    """Rows of bucket members in; (fp, root) out for every member that another one links to."""
    import numpy as np
    import pyarrow as pa

    def compared(values):
        values = np.unique(values)
        label = _star(len(values), *within(values))
        moved = np.flatnonzero(label != np.arange(len(values)))
        pair = [values[moved].view(np.int64), values[label[moved]].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        for bucket in batch.column(0):
            values = bucket.values.to_numpy(zero_copy_only=False).view(np.uint64)
            if n and n + len(values) > BLOCK:
                yield compared(np.concatenate(held))
                held, n = [], 0
            held.append(values)
            n += len(values)
    if n:
        yield compared(np.concatenate(held))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes`` (fp) that connect all within RADIUS bits."""
    width = 64 // BANDS
    band = lambda i: F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1)
    keys = [
        F.lit(k << 2 * width) + F.shiftleft(band(i), width) + band(j)
        for k, (i, j) in enumerate(combinations(range(BANDS), BANDS - RADIUS))
    ]
    members = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.materialize(members.join(size, "key").select("key", "n", "fp"), "buckets")
    small = (
        shared.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        .mapInArrow(_link_batches, "a bigint, b bigint")
    )
    large = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    one_bit = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    near = large.select("fp", F.explode(one_bit).alias("key"))
    lowest = near.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    hot = near.join(lowest, "key").where("fp != b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(hot).distinct()


def components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest ``rep`` of ``nodes`` (fp, rep) that links reach from fp.

    Labels start as the linked fingerprints' own rep and fall to the smallest
    label among neighbours, then to their label's own label, until none falls.
    Each round is written out, so losing an executor repeats one round at most.
    """
    edges = common.materialize(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    ends = edges.select(F.col("a").alias("fp")).distinct()
    label = common.materialize(
        nodes.join(ends, "fp", "left_semi").select("fp", F.col("fp").alias("head"), F.col("rep").alias("low")), "labels"
    )
    # label: head is the fingerprint that owns the smallest rep seen so far
    while True:
        best = lambda rep, head: F.min(F.struct(F.col(rep).isNull().alias("none"), F.col(rep).alias("low"), F.col(head).alias("head")))
        reached = (
            edges.join(label, edges["a"] == label["fp"]).groupBy("b").agg(best("low", "head").alias("best"))
        )
        own = F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("head"))
        lower = label.join(reached, label["fp"] == reached["b"], "left").select(
            "fp", F.coalesce(F.least("best", own), own).alias("now"), F.col("head").alias("before")
        )
        lower = lower.select("fp", F.col("now.low").alias("low"), F.col("now.head").alias("head"), "before")
        lower = common.materialize(lower, "labels")
        jump = lower.select(F.col("fp").alias("at"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        after = lower.join(jump, F.col("head") == F.col("at"), "left").select(
            "fp", F.coalesce("head2", "head").alias("head"),
            F.when(F.col("head2").isNull(), F.col("low")).otherwise(F.col("low2")).alias("low"),
            "before",
        )
        after = common.materialize(after, "labels")
        label = after.select("fp", "head", "low")
        if after.where(F.col("head") != F.col("before")).isEmpty():
            break
    rest = nodes.join(label.select("fp", F.col("low").alias("reached")), "fp", "left")
    return rest.select("fp", F.coalesce("reached", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    marked = common.materialize(fingerprints(docs), "fingerprints")
    nodes = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    return marked.join(components(nodes, links(nodes.select("fp"))), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, all columns: that of the smallest doc_id (null last), then the first by a hash of all columns."""
    rows, row = common.numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("member"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*common.columns(docs, hashed=True)).alias("hash"), F.col(row).alias("at"))
    kept = (
        rows.select(F.col(row).alias("member"), order.alias("order")).join(found, "member")
        .groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.at").alias("kept"))
    )
    return rows.join(kept, rows[row] == kept["kept"], "left_semi").select(*common.columns(docs))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
