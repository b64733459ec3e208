"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are made of passages of labelled texts. Both hold ordinary
passages. The toxic one also holds passages of toxic texts, the ordinary one
their twins, in which the marked strings are overwritten: strings (words and
word starts) that stand in clearly more contexts in toxic text than in ordinary
text. Contexts, the words before, are counted once each, so that copies of one
document are no evidence. So the dictionaries differ in what is toxic alone,
and what is ordinary about a passage makes no difference.

A window is WINDOW words, set between a lead that both dictionaries hold and a
short tail, so that zstandard looks for matches in all of it. Its distance is
how many bytes shorter the toxic dictionary makes it. Windows that are SHORTER
bytes shorter at least are looked at again, word by word, each word being a
window then. A document is scored by how many of these are at least CLOSE bytes
shorter, their share of its words, and the three largest distances, through a
logistic threshold that is calibrated on labelled rows the dictionaries have
not seen.

Fitting uses bounded samples of labelled rows (FIT_ROWS); scoring covers all
windows of all texts.

Defined results: null and empty texts have no windows and score low; repeated
rows each keep a row; without labelled rows of both kinds every score is 0;
labels of a document that disagree count as toxic; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows (about) that fit the dictionaries and the threshold, by label: ordinary, toxic.
FIT_ROWS = (4500, 2500)
#: A marked string has so many contexts a toxic document, so many at least, and so many times those of ordinary documents.
CONTEXTS, FEWEST, TIMES = 0.02, 8, 40
#: Characters of the word starts that may be marked, besides whole words.
STARTS = range(4, 10)
#: Words of a window, and of a passage in the toxic dictionary.
WINDOW, PASSAGE = 8, 3
#: Bytes (about) of ordinary and of toxic passages in the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32_000, 4_000
#: Bytes from which a window is looked at again, and from which a word in it is close to toxic text.
SHORTER, CLOSE = 1, 2
LEVEL, MIN_MATCH = 13, 3
LEAD, TAIL = bytes(range(128, 160)), bytes(range(200, 208))

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters (a-z and all non-ASCII characters) of UTF-8 text."""
    return text.translate(_WORDS).split()


def windows(found: list[bytes], size: int = WINDOW):
    """Runs of ``size`` words, the last may be shorter."""
    return [found[i : i + size] for i in range(0, len(found), size)]


class Distances:
    """Window to the bytes that the toxic dictionary saves over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def compress(content: bytes):
            held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=MIN_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress

        self.ordinary, self.toxic = compress(ordinary), compress(toxic)

    def __call__(self, window: list[bytes]) -> int:
        window = b"%b %b %b" % (LEAD, b" ".join(window), TAIL)
        return len(self.ordinary(window)) - len(self.toxic(window))


def features(text: bytes, distances: Distances) -> tuple[float, ...]:
    import heapq

    found = words(text)
    near = [distances([w]) for window in windows(found) if distances(window) >= SHORTER for w in window]
    close = sum(d >= CLOSE for d in near)
    return math.log1p(close), 50 * close / (len(found) + 1), sum(max(0, d) for d in heapq.nlargest(3, near)) / 10


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of the labelled rows that may be learned from.

    Labels are drawn before their texts are read, and only the drawn ones
    (about FIT_ROWS) are sent around.
    """
    marks = labels.where((common.remainder(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = common.materialize(marks, "marks")
    there = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.abs(F.xxhash64("doc_id", F.lit("toxicity")) % 1_000_000)
    share = F.lit(0)
    for label, n in there.items():
        share = F.when(F.col("toxic") == label, min(1.0, FIT_ROWS[label] / n) * 1_000_000).otherwise(share)
    drawn = marks.where(draw < share).select(F.col("doc_id").alias("drawn"), F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn")).select("doc_id", "text", "toxic")


def _marked(sample: DataFrame, n: dict[int, int]) -> list[str]:
    """The strings that mark toxic text, shortest first; a word start has a blank before it, a word also one after."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = sample.select("toxic", F.array_remove(F.split(lower, r"[\x00-\x60\x7B-\x7F]+"), "").alias("w"))
    pairs = found.select("toxic", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("w"), F.get("w", i - 1).alias("before")))).alias("x"))
    by_word = pairs.groupBy("toxic", "x.w").agg(F.count_distinct(F.coalesce("x.before", F.lit(""))).alias("n"))
    starts = [F.when(F.length("w") >= k, F.concat(F.lit(" "), F.substring("w", 1, k))) for k in STARTS]
    whole = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    side = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    strings = by_word.select("toxic", "n", F.explode(F.array_compact(F.array(whole, *starts))).alias("s")).groupBy("s").agg(
        side(1).alias("t"), side(0).alias("o"))
    few = max(FEWEST, CONTEXTS * n[1])
    clear = strings.where((F.col("t") >= few) & (F.col("t") * n[0] >= TIMES * n[1] * (F.col("o") + 0.5)))
    kept: list[str] = []
    for s in sorted((r["s"] for r in clear.select("s").collect()), key=lambda s: (len(s), s)):  # of a bounded sample
        if not any(s.startswith(k) for k in kept):
            kept.append(s)
    return kept


def _passage_batches(marked: list[bytes]):
    """Texts and labels in; a passage of each ordinary text, and of toxic texts the first passage around each marked string."""

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch, texts in common.slices(batches, 0):
            out = []
            for text, toxic in zip(texts, batch.column(1).to_pylist()):
                found = [b" %b " % b" ".join(w) for w in windows(words(text), PASSAGE if toxic else WINDOW)]
                if toxic:
                    first: dict[bytes, bytes] = {}
                    for window in found:
                        for s in marked:
                            if s in window:
                                first.setdefault(s, window)
                    out += first.items()
                elif found:
                    out.append((b"", found[zlib.crc32(text) % len(found)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["mark", "passage"])

    return run


def _dictionaries(passages: list[tuple[bytes, bytes]], marked: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, from (marked string or none, passage)."""
    import hashlib

    by_mark: dict[bytes, list[bytes]] = {}
    for mark, passage in sorted(set(passages), key=lambda x: hashlib.sha256(x[1]).digest()):
        by_mark.setdefault(mark, []).append(passage)
    usual = twins = toxic = b""
    for passage in by_mark.pop(b"", []):
        if len(usual) < ORDINARY_BYTES:
            usual += passage
    turn = 0
    while by_mark and len(toxic) < TOXIC_BYTES:  # one passage of each marked string in turn
        for mark in sorted(by_mark):
            passage = twin = by_mark[mark][turn] if turn < len(by_mark[mark]) else b""
            for s in marked:
                body, filler = s.strip(), bytes(1 + i * 7 % 30 for i in range(len(s.strip())))
                twin = twin.replace(s, s.replace(body, filler))
            toxic, twins = toxic + passage, twins + twin
        turn += 1
        by_mark = {mark: found for mark, found in by_mark.items() if turn < len(found)}
    return usual + twins, usual + toxic


def _calibrated(rows: list[tuple[tuple[float, ...], int]]) -> list[float]:
    """Logistic weights (intercept first), shifted so that 0.5 is the best F1 on these rows."""
    import numpy as np

    x = np.array([(1.0, *f) for f, _ in rows])
    y = np.array([label for _, label in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w * (np.arange(len(w)) > 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    order = np.argsort(x @ w, kind="stable")
    z = (x @ w)[order]
    cuts = np.flatnonzero(np.diff(z) > 1e-9)  # between a row and the next one
    if len(cuts):
        hits = y.sum() - np.cumsum(y[order])[cuts]
        f1 = 2 * hits / np.maximum(1.0, len(y) - 1 - cuts + y.sum())
        best = cuts[f1 >= f1.max() - 1e-12]
        best = best[len(best) // 2]
        w[0] -= (z[best] + z[best + 1]) / 2
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame):
    """(ordinary content, toxic content, logistic weights), or None where a kind of label has no rows."""
    sample = _sample(docs, labels)
    sample = common.materialize(sample.withColumn("third", F.abs(F.xxhash64("doc_id", F.lit("part")) % 3)), "labelled")
    size = {(r["toxic"], r["apart"]): r["n"] for r in sample.groupBy("toxic", (F.col("third") == 0).alias("apart")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 4:
        return None
    marked = [s.encode() for s in _marked(sample.where("third > 0"), {0: size[0, False], 1: size[1, False]})]
    found = sample.where("third > 0").select("text", "toxic").mapInArrow(_passage_batches(marked), "mark binary, passage binary")
    passages = [(bytes(r["mark"]), bytes(r["passage"])) for r in found.collect()]  # of a bounded sample
    ordinary, toxic = _dictionaries(passages, marked)

    def run(batches):
        import pyarrow as pa

        distances = Distances(ordinary, toxic)
        for batch, texts in common.slices(batches, 1):
            found = [list(features(t, distances)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(0)], names=["f", "toxic"])

    seen = sample.where("third = 0").select("toxic", "text").mapInArrow(run, "f array<double>, toxic int").collect()
    return ordinary, toxic, _calibrated(sorted((tuple(r["f"]), r["toxic"]) for r in seen))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every row; ``model`` is what ``fit`` returns."""

    def run(batches):
        import pyarrow as pa

        distances = Distances(*model[:2]) if model else None
        for batch, texts in common.slices(batches, 1):
            scores = []
            for text in texts:
                odds = sum(w * f for w, f in zip(model[2], (1.0, *features(text, distances)))) if model else 0
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if model else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that score under 0.5."""
    model = fit(docs, labels)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        distances = Distances(*model[:2])
        for batch, texts in common.slices(batches, at):
            clean = [sum(w * f for w, f in zip(model[2], (1.0, *features(t, distances)))) < 0 for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, schema) if model else docs


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(common.remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
