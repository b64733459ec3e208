import re
from collections import Counter

from tesserae.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(wins)
    inside = {i + k for i, w in enumerate(wins) if count[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_whole_table_and_labels(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op7_quality(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {k: base(r) for k, r in got.items()} == {r.doc_id: brute(r.text) for r in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(labels[d], r.kept) for d, r in got.items() if d in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)
    assert not any(r.kept and r.base_failed for r in got.values())


def test_edge_cases(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "a b a b a", "x\n\nx\n x\nx", "é ü " * 60, "a b c\x0bd\x0ce\rf " * 9000,
             "ab c d a bc d", "\x00 \x1c \x85 a", "one two three four one two three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "same row"), (0, "same row"), (None, "x y z")]
    docs = spark.createDataFrame([(a, b, "w") for a, b in rows], "doc_id int, text string, words string")
    got = Q.judge(docs)
    assert sorted(map(str, ((r.doc_id, base(r)) for r in got.collect()))) == sorted(str((a, brute(b))) for a, b in rows)
    assert Q.judge(docs.limit(0)).count() == 0


def test_fit_weighs_rules_by_what_they_see(spark):
    clean, one, many = (1, 1, 1, 0, 0, 0, 0), (1, 1, 1, -1, 0, 0, 0), (1, 1, -1, -1, -1, -1, -1)
    prior, accuracy = Q.fit([(clean, 800), (one, 100), (many, 100)])
    assert Q.posterior(clean, prior, accuracy) > 0.5 > Q.posterior(one, prior, accuracy) > Q.posterior(many, prior, accuracy)
    assert len(Q.rules()) == Q.RULES
    assert Q.fit([]) == (Q.PRIOR, [Q.ACCURACY] * 7)
