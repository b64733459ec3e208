import random

import numpy as np
import xxhash

from tesserae.llm import simhash as S


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """rows of (doc_id, fingerprint) -> component of each row, by comparing all pairs."""
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [low[find(i)] for i in range(len(rows))]


def test_whole_table_against_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op10_simhash(spark, sf_dir).collect()}
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute(rows))}


def test_bit_sliced_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(8)]
    values = np.unique(np.array(values, dtype=np.uint64))
    for radius in (0, 1, 2):
        i, j = S.within(values, radius)
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values))
                if int(values[a] ^ values[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def chain(n, rng):
    """Fingerprints of which each is one or two bits from the one before."""
    at, out = rng.getrandbits(64), []
    for _ in range(n):
        out.append(at)
        for b in rng.sample(range(64), rng.choice((1, 2))):
            at ^= 1 << b
    return out


def check(spark, rows):
    marked = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id bigint, fp bigint")
    nodes = marked.groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "rep")
    got = {r.fp % 2**64: r.component_id for r in S.components(nodes, S.links(nodes.select("fp"))).collect()}
    assert got == {f: c for (_, f), c in zip(rows, brute(rows))}


def test_chains_and_large_buckets(spark, monkeypatch):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    fps = [f for _ in range(4) for f in chain(25, rng)]
    fps += [center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)] + [rng.getrandbits(64) for _ in range(50)]
    ids = rng.sample(range(10_000), len(fps))
    rows = list(zip(ids, fps))
    check(spark, rows)
    monkeypatch.setattr(S, "BUCKET", 20)
    check(spark, rows)


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One"), (7, "one"), (3, "ONE two"), (None, "a b c d"), (2, "x y z " * 40_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, fp int")
    got = sorted(map(str, ((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect())))
    marked = [(a, slow_fingerprint(b)) for a, b in rows]
    assert got == sorted(map(str, ((d, f, c) for (d, f), c in zip(marked, brute(marked)))))
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    same = "a b c d e f g h"
    rows = [(7, "first text entirely of its own", 1), (7, "second and quite another thing here", 2), (None, "third one without any id at all", 3),
            (None, "fourth one lacks an id as well now", 4), (9, same, 5), (3, same, 6), (3, same, 7), (None, same, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.row for r in kept.collect()))
    assert got[:4] == [1, 2, 3, 4] and len(got) == 5 and got[4] in (6, 7)
    assert S.keep_one(docs.limit(0)).count() == 0
