import math

import pytest

from tesserae.llm import langid as L


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in L.op2_langid(spark, path).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(docs) and len(held) > 150
    assert sum(got[d].lang_pred == docs[d].lang for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


MODEL = L.Model(["a", "b"], {"the": {"a": 9, "b": 1}, "das": {"b": 8}},
                {g: {"a": w.count(g), "b": v.count(g)} for w, v in [("^then$the", "^dass$das")] for g in {*L.grams("then"), *L.grams("dass")}})


def slow(text):
    found = L.words(text)
    total = [math.fsum(x) for x in zip(*(MODEL.word_logs[MODEL.words[w]] if w in MODEL.words else MODEL.unknown(w) for w in found))]
    return total


@pytest.mark.parametrize("kept", [24_000_000, 1])
def test_sums_against_plain_loop(monkeypatch, kept):
    monkeypatch.setattr(L, "KEPT_BYTES", kept)
    scorer = L.Scorer(MODEL)
    text = "The then dass thess DASS x q " * 700 + " ".join("th" + chr(97 + i % 26) * (i % 9) for i in range(3000))
    assert scorer.sums(L.words(text)) == pytest.approx(slow(text))
    assert scorer.predict("then the")[0] == "a" and scorer.predict("dass das 12")[0] == "b"
    assert scorer.predict(" 12 \n!") == ("und", 0.0) == scorer.predict("")


def test_backoff_takes_the_longest_known():
    model = L.Model(["a"], {}, {"^": {"a": 1}, "a": {"a": 2}, "^a": {"a": 3}, "$": {"a": 4}})
    g = {k: model.gram_logs[i] for k, i in model.grams.items()}
    assert model.unknown("az") == pytest.approx(((g["^a"][0] + g["$"][0]) / 2,))
    assert L.Model(["a"], {}, {}).unknown("az") == (0.0,)


def test_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "42 !", "en"), (102, "the dog", None), (None, "die katze", "de"), (103, "the cat " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "s", "s") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string")
    got = L.predict(docs, L.fit(docs)).collect()
    assert len(got) == len(rows)
    said = {(r.doc_id, r.lang_pred) for r in got}
    assert {(100, "und"), (101, "und"), (102, "und"), (102, "en"), (None, "de"), (103, "en")} <= said
    nothing = L.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(docs.limit(0), nothing).count() == 0


def test_query_against_plain_counting(spark):
    """Brute force over the whole table: counts, smoothing, backoff and sums in plain loops."""
    import re
    import zlib
    from collections import Counter, defaultdict

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    parts = lambda w: [f"^{w}$"[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n)]
    counts = [defaultdict(Counter), defaultdict(Counter)]  # of words, of n-grams: all 200 documents are within the sample's bound
    for r in docs:
        if not held(r.doc_id) and r.lang is not None:
            for w in words(r.text):
                counts[0][w][r.lang] += 1
                for g in parts(w):
                    counts[1][g][r.lang] += 1
    langs = sorted({r.lang for r in docs if not held(r.doc_id) and r.lang is not None})
    logs = []
    for found in counts:
        known = {k: c for k, c in found.items() if sum(c.values()) > 1}
        total = {x: sum(c[x] for c in known.values()) for x in langs}
        logs.append({k: [math.log((c[x] + 0.5) / (total[x] + 0.5 * (len(known) + 1))) for x in langs] for k, c in known.items()})

    def of(w):
        if w in logs[0]:
            return logs[0][w]
        marked = f"^{w}$"
        ends = [next((logs[1][marked[e - n : e]] for n in range(min(4, e), 0, -1) if marked[e - n : e] in logs[1]), None) for e in range(2, len(marked) + 1)]
        ends = [x for x in ends if x]
        return [math.fsum(x) / len(ends) for x in zip(*ends)] if ends else [0.0] * len(langs)

    got = {r.doc_id: r for r in L.op2_langid(spark, path).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found = words(r.text)
        if not any(c.isalpha() for w in found for c in w):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = [math.fsum(x) for x in zip(*map(of, found))]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        score = 1 / math.fsum(math.exp((t - total[best]) * min(1, 20 / len(found))) for t in total)
        assert got[r.doc_id].lang_pred == langs[best] and got[r.doc_id].score == pytest.approx(score, rel=1e-6)
        assert got[r.doc_id].held_out == held(r.doc_id)


def test_ties_long_words_and_rare_languages(spark, monkeypatch):
    tie = L.Model(["a", "b"], {"same": {"a": 3, "b": 3}}, {})
    assert L.Scorer(tie).predict("same same") == ("a", 0.5)
    monkeypatch.setattr(L, "FIT_ROWS", 60)
    rows = [(i, "the cat and the dog go home", "en") for i in range(3000)] + [(5000 + i, "x" * 300 + "zqzq", "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs.where("crc32(cast(doc_id AS string)) % 4 <> 2"))
    assert model.langs == ["en", "zz"] and "zqzq" in model.grams
    assert L.Scorer(model).predict("zqzqzq")[0] == "zz"
