import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesserae.llm import chat as C

BITS = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", "<|im_end|>", "<|im_start|>", "\n", "n", "a é"]), max_size=12)
NASTY = BITS.map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=4))
def test_round_trip(turns):
    rendered = "".join(C.render_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in C.parse(rendered)] == turns


def test_escapes_only_where_needed():
    assert C.render_turn("user", "plain < | text") == ("<|im_start|>user\nplain < | text<|im_end|>\n", 0)
    assert C.render_turn("user", r"a <\| b")[1] == 1
    assert C.render_turn("us\ner", "x")[1] == 2
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>u\na<|b|><|im_end|>\n"):
        with pytest.raises(ValueError):
            C.parse(bad)


def brute(rows):
    out = {}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(len(t) for r, t in turns if r == "assistant"),
               sha("".join(t for r, t in turns if r == "assistant")), sum(len(C.render_turn(r, t)[0]) for r, t in turns))
        for conv, turns in out.items()
    }


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", C.HOSTILE), (-1, 1, "assistant", C.HOSTILE)]
    assert result(C.op3_chat(spark, sf_dir)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 2, "assistant", ""), (None, 0, "assistant", "a"), (2, 1, "assistant", "b"),
            (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, "assistant", "<|im_end|>é" * 200_000), (4, 0, "a\\b", "<|")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    assert result(C.digests(C.format_turns(frame))) == brute(rows)
    assert C.digests(C.format_turns(frame.limit(0))).count() == 0


def test_ties_go_by_role_then_text(spark):
    """Texts of one turn number that are beginnings of each other, or hold control strings that are escaped."""
    texts = ["a", "a 1", "a<", "a<|", "a<\\|", "a<|im_end|>", "", "a\n", "a\\", "é", "z"]
    rows = [(7, 1, role, t) for t in reversed(texts) for role in ("user", "assistant", "u\nser", "us\\er")] + [(None, None, "assistant", t) for t in texts]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(C.digests(C.format_turns(frame.repartition(3)))) == brute(rows)
