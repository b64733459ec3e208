import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe
from tesserae.llm import lm as M

M_PATH, M_PATTERN = bpe.public_vocabulary()


def tokens(text):
    return (text or "").encode().lower().split()


def brute(rows, held):
    """Base figures of (doc_id, text) rows by plain counting."""
    count, n = Counter(), 0
    for d, t in rows:
        if not held(d):
            count.update(tokens(t))
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        found = [*tokens(t), "end"]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in found)
        out.append((d, len(found), sum(count[w] > 0 for w in found), n, round(base, 4)))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in df)


@pytest.mark.parametrize("hot", [150_000, 20])
def test_whole_table(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT", hot)
    monkeypatch.setattr(M, "STEPS", 60)
    got = M.op8_lm(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(got) == brute(rows, lambda d: zlib.crc32(str(d).encode()) % 5 == 1)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_texts_are_likelier_than_by_word_counts(spark, sf_dir):
    """At sf0.01: the base score gives each unseen word the same, however many there may be, so it is no distribution, and a tiny table suits it."""
    held = M.op8_lm(spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert held.model > held.base


def vocabulary():
    with open(M_PATH, "rb") as f:
        return M.Subwords(f.read(), M_PATTERN)


def test_ids_of_many_words_are_those_of_each():
    sub = vocabulary()
    found = [w.encode() for w in ("a", "it's", "x!!y", "Ätsch", "", "1234a", "don't", "##", "漢字", "a\u00a0", "\u00a0b", "the", "'s", "ß" * 40)]
    ids, sizes = sub.encode(found)
    each = [sub.encoding.encode_ordinary(" " + w.decode()) if w else [sub.end] for w in found]
    assert sizes.tolist() == list(map(len, each)) and ids.tolist() == sum(each, [])
    assert sub.begins[sub.encode([b"the", b""])[0]].all() and [len(x) for x in sub.encode([])] == [0, 0]


def small_model():
    rng = np.random.default_rng(1)
    counts, begins = rng.integers(0, 50, 2400).astype(float), rng.random(2400) < 0.5
    begins[-1] = True
    texts = [np.array([*rng.integers(0, 2399, n), 2399], np.int32) for n in (0, 1, 5, 23, 24, 25, 47, 48, 49, 200)]
    model = M.Model(counts, begins, texts)
    model.weights["far"] = rng.standard_normal(M.CONTEXT).astype(np.float32)
    model.learn_pairs(rng.integers(0, 9, (M.CLASSES + 1, M.CLASSES)))
    model.prepare()
    return model, texts


def test_each_id_is_scored_once_in_its_window():
    model, texts = small_model()
    sizes = np.array(list(map(len, texts)))
    got, side = model.chances(model.code[np.concatenate(texts)], sizes)
    want, want_side = [], []
    for text in texts:
        stream = np.concatenate([[M.BEGIN], model.code[text]]).astype(np.int64)
        for t in range(len(text)):
            at = max(0, t // M.STRIDE * M.STRIDE - (M.CONTEXT - M.STRIDE))
            out = model.forward(stream[None, at : t + 1])
            kind, leaf = divmod(int(stream[t + 1]), M.LEAVES)
            odds = out[-2][0, -1] @ model.weights["leaf"][kind] + model.weights["leaf_bias"][kind]
            want.append(np.exp(out[-1][0, -1][kind] + odds[leaf]) / np.exp(odds).sum())
            start = np.exp(out[-1][0, -1][: M.CLASSES // 2]).sum()
            want_side.append(start if kind < M.CLASSES // 2 else 1 - start)
    assert got == pytest.approx(np.array(want), rel=1e-3) and side == pytest.approx(np.array(want_side), rel=1e-3)


def test_probabilities_sum_to_one_and_see_no_future():
    model, texts = small_model()
    codes = np.concatenate([[M.BEGIN], model.code[texts[-1]]])[None, :30].astype(np.int64)
    out = model.forward(codes)
    total = 0.0
    for i in range(2400):
        kind, leaf = divmod(int(model.code[i]), M.LEAVES)
        odds = out[-2][0, 7] @ model.weights["leaf"][kind] + model.weights["leaf_bias"][kind]
        total += np.exp(out[-1][0, 7][kind] + odds[leaf]) / np.exp(odds).sum() * model.inside[i]
    assert total == pytest.approx(1, rel=1e-3)
    changed = codes.copy()
    changed[0, 20:] = 3
    assert np.allclose(model.forward(changed)[-1][0, :20], out[-1][0, :20], atol=1e-4)


def test_what_may_follow_sums_to_one(spark):
    """Counts and attention mixed, over all ids that may follow a known, a known and ended, and an unknown beginning."""
    sub = vocabulary()
    learned = [(b"thinking", 5), (b"thinker", 3), (b"thin", 2), (b"xylophonist", 1)]
    docs = spark.createDataFrame([(bytearray(w), n) for w, n in learned], "word binary, n long")
    sent = spark.sparkContext.broadcast((open(M_PATH, "rb").read(), M_PATTERN))
    rows = docs.repartition(1).mapInArrow(M._node_batches(sent), "node long, parent long, n long, ends long").collect()
    by_id = np.zeros(sub.end + 1)
    for r in rows:
        if r.parent is None:
            by_id[r.node] += r.n
    found = M.Beginnings(*M._arrays([r for r in rows if r.parent is not None], "node", "parent", "n", "ends"))
    found.share[1:] = 0.7
    model = M.Model(by_id, sub.begins)
    model.prepare()
    every = np.arange(sub.end + 1)
    for word in (b"think", b"thin", b"zebra"):
        ids, _ = sub.encode([word])
        # each next id in turn: those inside a word go on with it, the others end it
        total = 0.0
        codes = np.concatenate([model.code[ids], [0]])
        by_code = {}
        for c in np.unique(model.code):
            codes[-1] = c
            chance, side = model.chances(codes, np.array([len(codes)]))
            by_code[c] = chance[-1], side[-1]
        chance, side = (np.array([by_code[c][k] for c in model.code]) for k in (0, 1))
        chance = chance * model.inside
        inner = np.flatnonzero(~sub.begins)
        longer = np.concatenate([np.append(np.tile(ids, (len(inner), 1)), inner[:, None], axis=1).reshape(-1), ids])
        sizes = np.array([len(ids) + 1] * len(inner) + [len(ids)])
        known, other, alone = found.mixed(longer.astype(np.int32), sizes).T
        at = np.cumsum(sizes)[:-1] - 2
        total += (known[at] + chance[inner] * (other[at] / side[inner] + alone[at])).sum()
        outer = sub.begins[every]
        total += (chance[outer] * (other[-1] / side[outer] + alone[-1])).sum()
        assert total == pytest.approx(1, rel=1e-2)


def test_gradients_are_those_of_the_loss():
    model, _ = small_model()
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    rng = np.random.default_rng(2)
    codes, targets = rng.integers(0, M.BEGIN, (2, 2, 9))
    codes[:, 0], codes[1, :3] = M.BEGIN, M.BLANK
    codes[1, 3] = M.BEGIN
    weight = (codes != M.BLANK).astype(float)
    _, grads = model.gradients(codes, targets, weight)
    for name in model.weights:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        step = 1e-5
        model.weights[name][at] += step
        up = model.gradients(codes, targets, weight)[0]
        model.weights[name][at] -= 2 * step
        down = model.gradients(codes, targets, weight)[0]
        model.weights[name][at] += step
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=1e-3, abs=1e-7)


def test_fitting_learns_an_order(monkeypatch):
    monkeypatch.setattr(M, "STEPS", 120)
    text = np.array([*([3, 9, 27, 50] * 40), 60], np.int32)
    model = M.Model(np.ones(61), np.arange(61) % 2 == 0, [text])

    def score():
        model.prepare()
        return np.log(model.chances(model.code[text], np.array([len(text)]))[0]).sum()

    before = score()
    losses = model.fit([text] * 5)
    assert losses[-1] < 0.5 * losses[0] and score() > 0.5 * before


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 3)
    rows = [(1, None), (2, ""), (3, "A b c \x0b d"), (3, "a b"), (None, "b É end"), (4, "x y " * 50_000), (11, "unseen word b")]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, c string")
    got = M.score(docs, F.col("doc_id") != 11).collect()
    assert result(got) == brute(rows, lambda d: d == 11)
    assert M.score(docs.limit(0), F.lit(True)).count() == 0
    none = M.score(docs, F.lit(False)).collect()
    assert result(none) == brute(rows, lambda d: True)


def test_what_follows_a_class_is_counted_in_all_documents(spark, monkeypatch):
    """A pattern of documents that take no part in fitting makes their like more probable."""
    monkeypatch.setattr(M, "FIT_ROWS", 0)
    apart = "a " * 40 + "b " * 40
    scores = {}
    for learned in (apart, "a b " * 40):  # the same counts of words, in different order
        rows = [(i, learned) for i in range(50)] + [(100, "a b " * 20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        scores[learned] = {r.doc_id: r.score for r in M.score(docs, F.col("doc_id") < 100).collect()}[100]
    assert scores["a b " * 40] > scores[apart] + 10


def test_pairs_of_classes_are_those_of_the_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts = [tokens(r.text) for r in docs.collect()]
    hot = [w for w, _ in Counter(w for t in texts for w in t).most_common(300)]
    first, last = {w: i % M.CLASSES for i, w in enumerate(hot)}, {w: i % 7 for i, w in enumerate(hot)}
    first["end"] = last["end"] = 5
    want = Counter()
    for t in texts:
        stops, begins = [M.CLASSES, *(last.get(w) for w in t)], [*(first.get(w) for w in t), 5]
        want.update((a, b) for a, b in zip(stops, begins) if a is not None and b is not None)
    sent = spark.sparkContext.broadcast((hot, np.array([-1, *first.values()]), np.array([-1, *last.values()])))
    got = Counter()
    for r in docs.mapInArrow(M._pair_batches(sent), "pair long, n long").collect():
        got[divmod(r.pair, M.CLASSES)] += r.n
    assert got == want


def test_beginnings_are_counted_over_all_words(spark, sf_dir):
    sub = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    counts = Counter(w for r in docs.collect() for w in tokens(r.text))
    want, ended = Counter(), Counter()
    for w, n in counts.items():
        ids = sub.encoding.encode_ordinary(" " + w.decode())
        for i in range(len(ids)):
            want[tuple(ids[: i + 1])] += n
        ended[tuple(ids)] += n
    sent = spark.sparkContext.broadcast((open(M_PATH, "rb").read(), M_PATTERN))
    table = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    rows = table.mapInArrow(M._node_batches(sent), "node long, parent long, n long, ends long").where("parent IS NOT NULL")
    got = {r.node: (r.n, r.ends) for r in rows.groupBy("node").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).collect()}
    keys = list(want)
    nodes = M.nodes_of(np.array([i for k in keys for i in k], np.int32), np.array(list(map(len, keys))))
    last = np.cumsum(list(map(len, keys))) - 1
    assert got == {int(nodes[at]): (want[k], ended[k]) for k, at in zip(keys, last)}


def test_least_counts_keep_within_bounds(spark):
    table = spark.createDataFrame([(c,) for c in [1] * 50 + [2] * 20 + list(range(3, 40))], "c long")
    for most in (0, 5, 36, 37, 60, 106, 107, 500):
        kept = table.where(F.col("c") >= M._most(table, "c", most)).count()
        assert kept <= most and kept >= min(most - 20, 37)


def test_what_stands_together_is_counted_in_all_documents(spark, sf_dir):
    """Neighbours and documents of places, also of words that are not hot, against plain counting."""
    sub = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts = [[sub.encode([w])[0].tolist() for w in [*tokens(r.text), b""]] for r in docs.collect()]
    place = (np.arange(sub.end + 1) % M.PLACES).astype(np.int16)
    want, seen = np.zeros((M.PLACES + 1, M.PLACES)), np.zeros((len(texts), M.PLACES))
    for row, t in enumerate(texts):
        np.add.at(want, ([M.PLACES, *(place[w[-1]] for w in t[:-1])], [place[w[0]] for w in t]), 1)
        np.add.at(seen[row], place[[i for w in t for i in w]], 1)
    hot = [w for w, _ in Counter(w for r in docs.collect() for w in tokens(r.text)).most_common(50)]
    sent, path = spark.sparkContext.broadcast((place, hot)), spark.sparkContext.broadcast((open(M_PATH, "rb").read(), M_PATTERN))
    got = M._summed(docs.repartition(3), M._place_batches(path, sent), (M.PLACES + 1) * M.PLACES + 2 * M.SINGLES**2)
    assert (got[: want.size].reshape(want.shape) == want).all()
    for side, near in enumerate(got[want.size :].reshape(2, M.SINGLES, M.SINGLES)):
        own = np.sqrt(seen[:, side * M.SINGLES : (side + 1) * M.SINGLES])
        assert near / 2.0**16 == pytest.approx(np.triu(own.T @ own), rel=1e-4, abs=1e-3)


def test_gradients_of_scored_windows_are_those_of_the_loss():
    model, texts = small_model()
    sizes = np.array(list(map(len, texts)))
    codes = model.code[np.concatenate(texts)]
    chance, side = model.chances(codes, sizes)
    stream, targets, late = model.windows(codes, sizes)
    there = np.zeros(len(targets), bool)
    there[late] = True
    got = model.slopes(stream, targets, there)
    assert got[0][late] == pytest.approx(chance, rel=1e-3) and got[1][late] == pytest.approx(side, rel=1e-3)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}

    def loss():
        model.prepare()
        return -np.log(model.slopes(stream, targets, there)[0][there].astype(np.float64)).mean()

    for name, grad in got[2].items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = model.weights[name][at], 3e-3
        model.weights[name][at] = old + step
        up = loss()
        model.weights[name][at] = old - step
        assert (up - loss()) / (2 * step) == pytest.approx(grad[at], rel=2e-2, abs=1e-4)
        model.weights[name][at] = old


def test_every_id_is_fitted_and_tells_the_shares_once(spark, sf_dir):
    sub = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.col("doc_id").cast("long").alias("draw"))
    n = [(r.draw, sum(len(sub.encode([w])[0]) for w in [*tokens(r.text), b""])) for r in docs.collect()]
    model = M.Model(np.ones(sub.end + 1), sub.begins)
    found = M.Beginnings(*(np.zeros(0, np.int64) for _ in range(4)))
    fitted = {n[3][0], n[10][0]}
    sent, path = spark.sparkContext.broadcast((model, found, [b"the"], fitted)), spark.sparkContext.broadcast((open(M_PATH, "rb").read(), M_PATTERN))
    fitter = M.Fitter(model)
    total = M._summed(docs.repartition(3), M._fit_batches(path, sent), len(fitter.result()))
    assert total[: len(fitter.histogram)].sum() == sum(k - 1 for d, k in n if d not in fitted)
    assert total[len(fitter.histogram)] >= sum(k for _, k in n) / M.IDS_AT_ONCE
    fitter.take(total)
    assert all(not np.array_equal(w, model.weights[k]) for k, w in fitter.model.weights.items())


def test_weights_are_fitted_to_all_documents(spark, monkeypatch):
    """What the word before the last one tells, in documents outside the first sample; words and their neighbours are counted alike."""
    monkeypatch.setattr(M, "FIT_ROWS", 0)
    texts = ["on it in . at it by . " * 30, "on it by . at it in . " * 30]
    scores = []
    for learned in texts:
        rows = [(i, learned) for i in range(6000)] + [(6000, texts[0])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        scores.append({r.doc_id: r.score for r in M.score(docs, F.col("doc_id") < 6000).where("doc_id = 6000").collect()}[6000])
    assert scores[0] > scores[1] + 5


def test_rows_are_summed_by_code():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 700):
        codes, rows, at = rng.integers(0, 40, n), rng.standard_normal((2 * n, 5)), rng.permutation(2 * n)[:n]
        want = np.ones((50, 5))
        np.add.at(want, codes, rows[at])
        got = np.ones((50, 5))
        M.add_by(got, codes, rows, at)
        assert got == pytest.approx(want)


class Sent:
    """Stands for a broadcast."""

    def __init__(self, *value):
        self.value = value


def test_a_worker_reads_the_hot_words_once(sf_dir, monkeypatch):
    """Tasks of one worker share what was read of the hot words, and results do not depend on it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet").slice(0, 20)
    batch = pa.RecordBatch.from_arrays([table["text"].combine_chunks(), table["doc_id"].combine_chunks()], names=["text", "draw"])
    back = pa.RecordBatch.from_arrays(batch.columns[::-1], names=["doc_id", "text"])
    path, sub, hot = Sent(open(M_PATH, "rb").read(), M_PATTERN), vocabulary(), [b"the", b"and"]
    model = M.Model(np.ones(sub.end + 1), sub.begins)
    model.prepare()
    found, place = M.Beginnings(*(np.zeros(0, np.int64) for _ in range(4))), (np.arange(sub.end + 1) % M.PLACES).astype(np.int16)
    read, parts = [], M.Reader._parts
    monkeypatch.setattr(M.Reader, "_parts", lambda self, some: read.append(some) or parts(self, some))
    for run, rows in (
        (M._place_batches(path, Sent(place, hot)), batch), (M._fit_batches(path, Sent(model, found, hot, set())), batch),
        (M._score_batches(path, Sent(model, found, hot, np.ones(2))), back),
    ):
        read.clear()
        first, second = ([x.to_pydict() for x in run(iter([rows]))] for _ in range(2))
        assert first == second and [x for x in read if x[:2] == hot] == [[*hot, b""]]
