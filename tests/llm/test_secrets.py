import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import native, secrets as S

KINDS = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute(text):
    found = []
    for i, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), i, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return tuple(sum(k == kind for *_, k in found) for kind in KINDS) + (hashlib.sha256(joined.encode()).hexdigest(),)


def base(r):
    return (r.n_assign, r.n_access, r.n_hex, r.base_sha256)


def test_whole_table(spark, sf_dir):
    got = {r.doc_id: r for r in S.op1_secrets(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {k: base(r) for k, r in got.items()} == {r.doc_id: brute(r.text) for r in docs}


RNG = random.Random(5)
PLANTED = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
HEX = "0123456789abcdef" * 2
TEXTS = [
    None, "", "nothing here", f"tOkEn = '{PLANTED}' and é {HEX}", "token: secret: abcdefgh1", "AKIA" + "B2" * 6, f"x{HEX}AKIA{'Z9' * 8}",
    f"ghp_{PLANTED}", "get_user_account_name_from_database", f"é{PLANTED}", "thonanthereatingoranthhe", "password:short api_key=" + "a" * 8,
    f"k {PLANTED} " * 3, ("word " * 50 + f'passwd="{PLANTED}" ') * 300, "mytoken: " + PLANTED, f"abcdefghijabcdefghij_token : {PLANTED}", "\n" + HEX,
]


@pytest.fixture(scope="module")
def small(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, HEX)]
    return spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, found string"), rows


def test_edge_cases(spark, small):
    docs, rows = small
    out = S.scan(docs.drop("found"), S.train(docs.limit(0))).select("doc_id", "text", S._written(F.col("found")).alias("spans")).collect()
    for r in out:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("markov")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == brute(r.text)[3], r.text
        extra = [x.split(":") for x in r.spans.split(",") if x.startswith("markov")]
        taken = {i for x in kept for i in range(int(x.split(":")[1]), int(x.split(":")[2]))}
        assert not any(taken & set(range(int(a), int(b))) for _, a, b in extra)
    spans = {r.text: r.spans for r in out}
    assert spans[f"ghp_{PLANTED}"] == "markov:0:40" and spans[f"é{PLANTED}"] == "markov:1:37"
    assert spans["get_user_account_name_from_database"] == spans["thonanthereatingoranthhe"] == spans["nothing here"] == ""
    assert spans[f"k {PLANTED} " * 3].count("markov") == 3
    assert S.scan(docs.limit(0)).count() == 0


def test_redaction(spark, small):
    docs, _ = small
    got = {r.doc_id: r.text for r in S.redact(docs.drop("found").where("doc_id < 13"), "#", S.train(docs.limit(0))).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "nothing here"
    assert got[3] == "#' and é #" and got[7] == "#" and got[12] == "k # " * 3


def test_running_sums(spark):
    for values in ([], [5], list(range(40)), [1] * 1000):
        frame = spark.createDataFrame([(values,)], "v array<long>")
        want = [sum(values[:i]) for i in range(len(values) + 1)]
        assert frame.select(native.running_sums(F.col("v"))).first()[0] == want


def test_running_maxima(spark):
    for values in ([], [5, 3], [7, 1, 9, 2] * 30):
        frame = spark.createDataFrame([(values,)], "v array<long>")
        want = [max([0, *values[:i]]) for i in range(len(values) + 1)]
        assert frame.select(native.running(F.col("v"), F.greatest)).first()[0] == want


def test_columns_of_the_input_stay(spark, small):
    docs, _ = small
    docs = docs.withColumn("Found_", F.lit(3))
    out = S.redact(docs, "#", S.train(docs.limit(0)))
    assert out.columns == docs.columns
    assert {(r.found, r.Found_) for r in out.collect()} == {("z", 3)}
    assert S.scan(docs, S.train(docs.limit(0)), "spans").columns == [*docs.columns, "spans"]


def test_many_spans_of_one_text(spark):
    text = ("password=abcdefgh1 " + HEX + " ") * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert S.redact(docs, "#", S.train(docs.limit(0))).first().text == "# # " * 2000
