import math

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = T.load_pieces(PATH)


def one(word, scores):
    """Best (score, count) of a word by trying every cut, without sharing."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        found = [(best[end - 1][0] + T.BYTE_SCORE * size, best[end - 1][1] + size)]
        found += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    return best[-1]


@settings(deadline=None)
@given(st.sets(st.text(alphabet="abcé漢", min_size=1, max_size=9)))
def test_shared_prefixes_change_nothing(words):
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -2.5, "c": -1.0, "ca": -2.0, "é": -3.0, "bc": -3.0}
    assert T.Walk(scores).counts(sorted(words)) == {w: one(w, scores) for w in words}


def brute(text):
    words = [T.MARK + w for w in (text or "").split()]
    found = [one(w, PIECES) for w in words]
    return len(words), sum(n for _, n in found), math.fsum(s for s, _ in found)


def test_whole_table(spark, sf_dir):
    got = {r.doc_id: r for r in T.op4_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n_words, n_tokens, score = brute(r.text)
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (n_words, n_tokens)
        assert got[r.doc_id].log_prob == pytest.approx(score)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    rows = [(1, None), (2, ""), (3, " \n "), (3, "The the 漢字 😀"), (None, "the"), (4, "ab" * 20_000)]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id bigint, text string, n_words int")
    got = sorted(str((r.doc_id, r.n_words, r.n_tokens)) for r in T.count_tokens(docs, PATH).collect())
    short = [str((a, *brute(b)[:2])) for a, b in rows[:-1]]
    assert [x for x in got if not x.startswith("(4,")] == sorted(short)
    assert T.count_tokens(docs.limit(0), PATH).count() == 0
