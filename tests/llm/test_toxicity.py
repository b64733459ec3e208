import math
import os
import zlib

import pytest

from tesserae.llm import toxicity as T


@pytest.fixture(scope="module")
def larger():
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no larger tables")
    return path


def test_held_out_accuracy(spark, larger):
    got = {r.doc_id: r for r in T.op6_toxicity(spark, larger).where("held_out").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{larger}/labels.parquet").collect() if r.doc_id in got]
    hits = sum(got[d].predicted and t for d, t in labels)
    said, toxic = sum(got[d].predicted for d, _ in labels), sum(t for _, t in labels)
    assert toxic > 30 and hits / toxic > 0.85 and hits / said > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_distances_find_fitted_strings():
    usual = [(b"", " {} {} plain words go here so far ".format(a * 3, b * 4).encode()) for a in "abcdefgh" for b in "ijkl"]
    marked = [b" chlla", b" pathetic "]
    toxic = [(b" pathetic ", b" you pathetic thing "), (b" chlla", b" la chllanu vien ")]
    d = T.Distances(*T._dictionaries([*usual, *toxic], marked))
    assert d(b"aaa iiii so pathetic words go here plain".split()) >= T.CLOSE <= d([b"pathetic"])
    assert d(b"bbb jjjj chllaque words go here plain".split()) >= T.CLOSE <= d([b"chllaque"])
    assert all(d(w.split()) < T.CLOSE for w in (b"aaa iiii so plain words", b"you", b"thing", b"vien", b"", b"x" * 500))


def test_score_is_that_of_plain_windows(spark, larger):
    """Brute force over the whole table: each window compressed anew by both dictionaries."""
    import re

    import zstandard

    path = larger.replace("sf0.1", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    ordinary, toxic, weights = T.fit(docs, labels)

    def length(content, window):
        how = zstandard.ZstdCompressionParameters.from_level(
            13, min_match=3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content + T.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return lambda w: len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(T.LEAD + w + T.TAIL))

    one, two = length(ordinary, None), length(toxic, None)
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in T.op6_toxicity(spark, path).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::5]:
        found = re.findall("[a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        cut = [found[i : i + 8] for i in range(0, len(found), 8)]
        distance = lambda w: one(f" {w} ".encode()) - two(f" {w} ".encode())
        d = [distance(w) for ws in cut if distance(" ".join(ws)) >= 1 for w in ws]
        close = sum(x >= 2 for x in d)
        f = (1, math.log1p(close), 50 * close / (len(found) + 1), sum(sorted((max(0, x) for x in d), reverse=True)[:3]) / 10)
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, f))))
        assert got[r.doc_id] == (pytest.approx(score, abs=1e-9), int(score >= 0.5), zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def made(spark):
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 1
        body = [f"w{i * 7 % 13}x".replace("1", "q"), "plain", "abcdefghijk"[i % 11] * 3, "talk", "lmnop"[i % 5] * 4] * 3
        for k in (range(2, 15, 4) if toxic else ()):
            body[k] = "vilestword"
        rows.append((i, " ".join(body), "a", "b"))
        marks.append((i, int(toxic)))
    rows += [(1000, None, "a", "b"), (1001, "", "a", "b"), (None, "vilestword " * 9, "a", "b"), (1001, "", "a", "b"), (1002, "vilestword talk " * 90_000, "a", "b")]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string, toxic string"),
            spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_edge_cases(spark):
    docs, labels = made(spark)
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == 405
    for r in got:
        toxic = r.doc_id in (None, 1002) or r.doc_id < 1000 and r.doc_id % 4 == 1
        assert (r.score >= 0.5) == toxic, r
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 303
    assert T.score(docs.limit(0), model).count() == 0
    assert T.fit(docs, labels.where("toxic = 0")) is None and T.fit(docs.limit(0), labels) is None
    assert {r.score for r in T.score(docs, None).collect()} == {0.0}
    assert T.keep_clean(docs, labels.limit(0)).count() == 405
