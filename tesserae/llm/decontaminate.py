"""Benchmark decontamination with a document-sharded positional inverted index.

``build_index`` turns training documents into index shards: each shard is one
row that holds a bounded run of documents and, by term, the positions at which
the term stands. ``search`` sends the windows of the test items to all shards.
In a shard each window starts from the postings of its rarest word (by corpus
frequency, counted over all shards), shifted by the word's offset, and is cut
down by the postings of the window's other words, rarest first, each shifted
by its own offset; what is left are exact phrase matches. Proximity matches,
where most words stand within a few words of their place, start from the
postings of as many of the rarest words as cannot all be missing. Documents never leave their shard, so a frequent word, line or passage
makes no key of a shuffle.

Defined results: a null or empty text has no words and no hits; an item
without words has no window; repeated documents or items are each treated as
they stand, with an item_id counted once per document; an empty benchmark
gives no hits. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 10
#: Words that may lie between a word and its place in a proximity match.
SLOP = 2
#: Share of a window's words that a proximity match needs.
NEAR = 0.8
#: Words after which an index shard is closed (a longer document fills one alone).
SHARD_WORDS = 1_000_000
#: Characters of benchmark text sent to the executors at once; more items go in further passes.
PASS_CHARS = 8_000_000

#: Separators become blanks and A-Z become a-z; bytes of other scripts stay.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32
    for c in range(256)
)

INDEX_SCHEMA = (
    "shard string, doc_id array<bigint>, base array<int>, n_words array<int>,"
    " term array<string>, size array<int>, postings binary"
)
MATCH_SCHEMA = (
    "shard string, ord int, doc_id bigint, n_words bigint,"
    " hits array<struct<start:int,end:int>>, items array<string>, near array<string>"
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(_WORDS).split()


def _index_batches(vocabulary):
    """A function for mapInArrow; vocabulary: broadcast terms to store, or None for all."""
    import uuid

    import numpy as np
    import pyarrow as pa
    import zstandard

    schema = pa.schema(
        [
            ("shard", pa.string()),
            ("doc_id", pa.list_(pa.int64())),
            ("base", pa.list_(pa.int32())),
            ("n_words", pa.list_(pa.int32())),
            ("term", pa.list_(pa.string())),
            ("size", pa.list_(pa.int32())),
            ("postings", pa.binary()),
        ]
    )

    def run(batches):
        terms = None if vocabulary is None else vocabulary.value
        pack = zstandard.ZstdCompressor(level=1)

        def closed(ids, bases, counts, parts, names):
            tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
            places = np.concatenate(
                [np.arange(len(p), dtype=np.int32) + b for p, b in zip(parts, bases)]
            ) if parts else np.empty(0, np.int32)
            if terms is not None:
                keep = tokens >= 0
                tokens, places = tokens[keep], places[keep]
            order = np.argsort(tokens, kind="stable")
            tokens, places = tokens[order], places[order]
            present, first, size = np.unique(tokens, return_index=True, return_counts=True)
            gaps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
            row = {
                "shard": uuid.uuid4().hex, "doc_id": ids, "base": bases, "n_words": counts,
                "term": [names[i].decode("utf-8", "replace") for i in present.tolist()],
                "size": size.tolist(), "postings": pack.compress(gaps.tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        ids, bases, counts, parts, at = [], [], [], [], 0
        if terms is None:
            own: dict[bytes, int] = {}
            names: list[bytes] = []
        else:
            names = list(terms)
        for batch, texts in common.slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                found = words(text)
                if terms is None:
                    for w in found:
                        if w not in own:
                            own[w] = len(names)
                            names.append(w)
                    codes = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
                else:
                    get = terms.get
                    codes = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
                ids.append(doc_id)
                bases.append(at)
                counts.append(len(found))
                parts.append(codes)
                at += len(found) + WINDOW * (SLOP + 1)  # no match reaches into the next document
                if at >= SHARD_WORDS:
                    yield closed(ids, bases, counts, parts, names)
                    ids, bases, counts, parts, at = [], [], [], [], 0
                    if terms is None:
                        own, names = {}, []
        if ids:
            yield closed(ids, bases, counts, parts, names)

    return run


def build_index(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """Index shards of ``docs`` (doc_id, text); ``terms``: store these words' postings only.

    Postings of words that no query holds take no part in any intersection, so a
    search for known items may leave them out.
    """
    spark = docs.sparkSession
    known = None
    if terms is not None:
        known = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_index_batches(known), INDEX_SCHEMA)


def windows(text: str | None) -> list[tuple[bytes, ...]]:
    """Windows of an item: each run of WINDOW words, or all its words if fewer."""
    found = words((text or "").encode())
    if len(found) < WINDOW:
        return [tuple(found)] if found else []
    return [tuple(found[i : i + WINDOW]) for i in range(len(found) - WINDOW + 1)]


def _search_batches(queries):
    """queries: broadcast dict with terms, and by window length arrays of terms, offsets and items."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    hit = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema(
        [
            ("shard", pa.string()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("hits", pa.list_(hit)), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())),
        ]
    )
    block = 1_000_000

    def candidates(first, size, places, lists):
        """Blocks of (window, start of the rarest word's posting), at most about ``block`` each."""
        much = size[lists]
        live = np.flatnonzero(much)
        while len(live):
            cut = max(1, int(np.searchsorted(np.cumsum(much[live]), block, "right")))
            now, live = live[:cut], live[cut:]
            n = much[now]
            which = np.repeat(now, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield which, places[np.repeat(first[lists[now]], n) + within].astype(np.int64)

    def signatures(at):
        """By place, bits of the words that stand within twice SLOP of it; 64 words share a bit, so a set bit proves nothing."""
        own = np.where(at < 0, np.uint64(0), np.uint64(1) << (at & 63).astype(np.uint64))
        seen = own.copy()
        for d in range(1, 2 * SLOP + 1):
            seen[d:] |= own[:-d]
            seen[:-d] |= own[d:]
        return seen

    def close_matches(length, terms, offsets, items, first, size, places, at, seen, base):
        """Arrays of (document, item): some start has enough of a window's words within SLOP of their places.

        Such a start has at least one of the window's ``may_miss + 1`` rarest
        words near its place, so the postings of those words, moved by up to
        SLOP, reach every match.
        """
        may_miss = length - math.ceil(NEAR * length - 1e-9)
        pad = WINDOW * (SLOP + 1)
        out = []
        for k in range(min(may_miss + 1, length)):
            for which, place in candidates(first, size, places, terms[:, k]):
                # words near their places for a moved start are within twice SLOP for this one
                start = place - offsets[which, k] + pad
                missed = np.zeros(len(start), np.int64)
                for j in range(length):
                    bit = (terms[which, j] & 63).astype(np.uint64)
                    missed += (seen[start + offsets[which, j]] >> bit) & np.uint64(1) == 0
                    keep = missed <= may_miss
                    which, place, start, missed = which[keep], place[keep], start[keep], missed[keep]
                for move in range(-SLOP, SLOP + 1):
                    live, missed = np.arange(len(start)), np.zeros(len(start), np.int64)
                    for j in range(length):
                        want, spot = terms[which[live], j], start[live] + move + offsets[which[live], j]
                        missed[live] += sum(at[spot + d] == want for d in range(-SLOP, SLOP + 1)) == 0
                        live = live[missed[live] <= may_miss]
                    if len(live):
                        doc = np.searchsorted(base, place[live], "right") - 1
                        out.append(np.unique(np.stack([doc, items[which[live]]]), axis=1))
        return out

    def run(batches):
        q = queries.value
        n_terms = len(q["terms"])
        number = {t: i for i, t in enumerate(q["terms"])}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for shard in batch.to_pylist():
                base, counts = np.array(shard["base"], np.int64), np.array(shard["n_words"], np.int64)
                sizes = np.array(shard["size"], np.int64)
                gaps = np.frombuffer(unpack.decompress(shard["postings"]), np.int32)
                places = np.cumsum(gaps, dtype=np.int32)
                end = int(base[-1] + counts[-1]) + WINDOW * (SLOP + 1)
                codes = np.fromiter((number.get(t, -1) for t in shard["term"]), np.int32, len(sizes))
                at = np.full(end + 2 * WINDOW * (SLOP + 1), -1, np.int32)
                pad = WINDOW * (SLOP + 1)
                at[places + pad] = np.repeat(codes, sizes)
                first, size = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
                begin = np.cumsum(sizes) - sizes
                ours = codes >= 0
                first[codes[ours]], size[codes[ours]] = begin[ours], sizes[ours]
                cover = np.zeros(end + 2, np.int32)
                exact, near = [], []
                seen = signatures(at)
                for length, (terms, offsets, items) in q["windows"].items():
                    near += close_matches(length, terms, offsets, items, first, size, places, at, seen, base)
                    for which, place in candidates(first, size, places, terms[:, 0]):
                        start = place - offsets[which, 0]
                        live = np.flatnonzero(start >= 0)
                        for k in range(1, length):
                            w = which[live]
                            live = live[at[start[live] + offsets[w, k] + pad] == terms[w, k]]
                        if len(live):
                            np.add.at(cover, start[live], 1)
                            np.add.at(cover, start[live] + length, -1)
                            doc = np.searchsorted(base, place[live], "right") - 1
                            exact.append(np.unique(np.stack([doc, items[which[live]]]), axis=1))
                n = len(base)
                hits, names, close_names = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                for pairs, out in ((exact, names), (near, close_names)):
                    if pairs:
                        for d, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
                            out[d].append(q["items"][i])
                if exact:
                    inside = (np.cumsum(cover) > 0).astype(np.int8)
                    edge = np.diff(inside, prepend=0, append=0)
                    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                    owner = np.searchsorted(base, starts, "right") - 1
                    for d, s, e in zip(owner.tolist(), (starts - base[owner]).tolist(), (ends - base[owner]).tolist()):
                        hits[d].append({"start": s, "end": e})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard["shard"]] * n, pa.string()), pa.array(range(n), pa.int32()),
                        pa.array(shard["doc_id"], pa.int64()), pa.array(shard["n_words"], pa.int64()),
                        pa.array(hits, schema.field(4).type), pa.array(names, schema.field(5).type),
                        pa.array(close_names, schema.field(6).type),
                    ],
                    schema=schema,
                )

    return run


def _prepared(items: list, frequency: dict[bytes, int]) -> dict:
    import numpy as np

    terms = sorted({w for _, ws in items for win in ws for w in win})
    number = {t: i for i, t in enumerate(terms)}
    names = sorted({name for name, _ in items})
    place = {n: i for i, n in enumerate(names)}
    by_length: dict[int, dict] = {}
    for name, ws in items:
        for win in ws:
            by_length.setdefault(len(win), {}).setdefault((win, place[name]), None)
    out = {}
    for length, found in by_length.items():
        rows = [[(frequency.get(w, 0), k, number[w]) for k, w in enumerate(win)] for win, _ in found]
        rows = [sorted(r) for r in rows]
        out[length] = (
            np.array([[x[2] for x in r] for r in rows], np.int32),
            np.array([[x[1] for x in r] for r in rows], np.int64),
            np.array([i for _, i in found], np.int64),
        )
    return {"terms": [t.decode("utf-8", "replace") for t in terms], "windows": out, "items": names}


def search(index: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """Matches of ``items`` (name, text; bounded by PASS_CHARS by the caller) per indexed document.

    Returns MATCH_SCHEMA: hits are merged word ranges of exact matches, items
    the names of items with one, near those with a proximity match.
    """
    cut = [(name, windows(text)) for name, text in items]
    vocabulary = {w for _, ws in cut for win in ws for w in win}
    names = [w.decode("utf-8", "replace") for w in vocabulary]
    # one row a query word at most, and query words are bounded by PASS_CHARS
    counted = (
        index.select(F.explode(F.arrays_zip("term", "size")).alias("x"))
        .groupBy(F.col("x.term").alias("term")).agg(F.sum("x.size").alias("n"))
    )
    if index.sparkSession is not None and names:
        wanted = F.broadcast(index.sparkSession.createDataFrame([(n,) for n in names], "term string"))
        counted = counted.join(wanted, "term", "left_semi")
    else:
        counted = counted.limit(0)
    frequency = {r["term"].encode(): r["n"] for r in counted.collect()}
    queries = index.sparkSession.sparkContext.broadcast(_prepared(cut, frequency))
    return index.mapInArrow(_search_batches(queries), MATCH_SCHEMA)


def _passes(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """Items as (name, text), in lists of about PASS_CHARS characters; read pass by pass."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.length("text") + F.length("name"))).first()[0] or 0
    n = -(-total // PASS_CHARS) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield n, [(r["name"], r["text"]) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCH_SCHEMA rows for every document against every benchmark item.

    A benchmark of up to PASS_CHARS characters is searched in one pass without
    any shuffle. A larger one is searched in several passes over one full
    index, and the passes are merged per document.
    """
    index, parts = None, []
    for n, items in _passes(benchmark):
        if index is None:
            terms = sorted({w for _, text in items for w in words(text.encode())}) if n == 1 else None
            index = common.materialize(build_index(docs, terms), "index")
        one = search(index, items)
        if n == 1:
            return one
        parts.append(common.materialize(one, "pass"))  # so the plan has a scan for each pass, no more
    found = functools.reduce(DataFrame.unionByName, parts)
    gather = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return found.groupBy("shard", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        gather("hits"), gather("items"), gather("near"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
    )["n"]
    items = F.array_sort(F.array_distinct("items"))
    return matches(docs, benchmark).select(
        "doc_id", "n_words", covered.cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("bigint").alias("n_near_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, without an exact match; each row is judged by its own text, whatever its doc_id."""
    rows, row = common.numbered(docs)
    found = matches(rows.select(F.col(row).alias("doc_id"), "text"), benchmark)
    bad = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("bad"))
    return rows.join(bad, rows[row] == bad["bad"], "left_anti").select(*common.columns(docs))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("n_near_items")


def op5_near(spark, sf_dir: str) -> DataFrame:
    """The proximity half of ``op5_decontaminate``: doc_id, n_words, n_near_items and the items themselves, in order."""
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    near = F.array_sort(F.array_distinct("near"))
    return found.select("doc_id", "n_words", F.size(near).cast("bigint").alias("n_near_items"), near.alias("near_items"))


#: The same rows in DuckDB SQL.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
 bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
 di AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
 m AS (SELECT rid, i, n, item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM di) JOIN bw USING (n, k)),
 h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1),
 t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
