import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import bpe as B

PATH, PATTERN = B.public_vocabulary()
with open(PATH, "rb") as f:
    RANKS = B.load_ranks(f.read())
ENCODER = B.Encoder(RANKS, PATTERN)
TOKENS = ENCODER.transducer.tokens
KNOWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="abtheingon éß'\n\t 0189"), st.text(alphabet="aé漢😀́ ")))
def test_ids_are_the_librarys(text):
    ids = ENCODER.encode(text)
    assert ids == KNOWN.encode_ordinary(text)
    machine = B.Utf8Machine(TOKENS)
    assert "".join(machine.feed([i]) for i in ids) + machine.end() == text


@given(st.binary(max_size=12))
def test_utf8_machine_is_the_standard_decoder(data):
    ids = [RANKS[data[i : i + 1]] for i in range(len(data))]
    machine = B.Utf8Machine(TOKENS)
    assert machine.feed(ids) + machine.end() == data.decode("utf-8", "replace")


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "KEPT_STATES", 3)
    monkeypatch.setattr(B, "KEPT_PAIRS", 3)
    monkeypatch.setattr(B, "KEPT_TOKENS", 2)
    monkeypatch.setattr(B, "LONG_TEXT", 10)
    monkeypatch.setattr(B, "HELD_BYTES", 200)
    text = "internationalization " * 3 + "x" * 2000 + "Überraschung" * 30
    assert B.Encoder(RANKS, PATTERN).encode(text) == KNOWN.encode_ordinary(text)


def digests(text):
    ids = KNOWN.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_whole_table(spark, sf_dir):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op9_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {r.doc_id: digests(r.text) for r in docs}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\n x"), (3, "a\x00b\x1c\x85 c"), (None, "<|endoftext|>"), (4, "häß " * 300_000)]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id bigint, text string, ids int")
    out = B.encode(docs, PATH, PATTERN)
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()))) == sorted(
        str((a, *digests(b))) for a, b in rows)
    assert sorted(r.text for r in B.decode(out, PATH).collect()) == sorted(b or "" for _, b in rows)
    assert B.encode(docs.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("text", ["", "a", "ab" * 40])
def test_merged(text):
    assert ENCODER.transducer.merged(text.encode()) == (KNOWN.encode_ordinary(text) if text else [])


@pytest.mark.parametrize("held", [B.HELD_IDS, 50])
def test_query_returns_the_ids_themselves(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(B, "HELD_IDS", held)
    got = {r.doc_id: r.ids for r in B.op9_bpe(spark, sf_dir).select("doc_id", "ids").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {r.doc_id: KNOWN.encode_ordinary(r.text or "") for r in docs}
