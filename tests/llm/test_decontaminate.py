import hashlib
import re

from tesserae.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """doc_id -> (n_words, n_hit, items), by comparing every window with every position."""
    wins = {}
    for name, text in items:
        w = words(text)
        for win in [w[i : i + 10] for i in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []:
            wins.setdefault(tuple(win), set()).add(name)
    out = {}
    lengths = sorted({len(w) for w in wins})
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    names |= wins[key]
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in df.collect()}


def test_whole_tables_against_brute_force(spark, sf_dir):
    got = D.op5_decontaminate(spark, sf_dir)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert result(got) == want
    assert any(x[1] for x in want.values())


LONG = " ".join(f"w{i % 37}é" for i in range(5000))
DOCS = [
    (1, None), (2, ""), (3, "One two, THREE four five six seven eight nine ten eleven!"), (4, "alpha beta"),
    (5, "x alpha-beta alpha beta y"), (6, LONG), (6, LONG), (7, "ten nine eight"), (None, "alpha beta"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "Alpha beta"), (3, None), (4, "  .. "),
         (2, "alpha beta"), (5, " ".join(f"w{i % 37}é" for i in range(30)))]


def frames(spark):
    docs = spark.createDataFrame([(a, b, "x") for a, b in DOCS], "doc_id bigint, text string, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id int, text string")


def test_edge_cases(spark):
    docs, items = frames(spark)
    got = D.decontaminate(docs, items)
    assert got.count() == len(DOCS)
    assert result(got) == brute(DOCS, [(str(a), b) for a, b in ITEMS])
    assert {r.doc_id for r in got.collect() if r.contaminated} == {3, 4, 5, 6, None}


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in D.decontaminate(docs, items.limit(0)).collect())


def test_many_passes_agree_with_one(spark, monkeypatch):
    docs, items = frames(spark)
    one = result(D.decontaminate(docs, items))
    monkeypatch.setattr(D, "PASS_CHARS", 60)
    monkeypatch.setattr(D, "SHARD_WORDS", 100)
    assert result(D.decontaminate(docs, items)) == one


def test_proximity_without_exact_match(spark):
    docs = spark.createDataFrame([(1, "one two three four uh five six seven eight nine ten")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id int, text string")
    row = D.decontaminate(docs, items).first()
    assert (row.n_hit, row.n_items, row.n_near_items) == (0, 0, 1)


def brute_near(docs, items):
    """(doc_id, item) where some start has 8 of 10 of a window's words within two words of their places."""
    out = set()
    for doc_id, text in docs:
        d = words(text)
        for name, item in items:
            w = words(item)
            n = min(10, len(w))
            for win in [w[i : i + n] for i in range(len(w) - n + 1)] if w else []:
                need = -(-8 * n // 10)
                for s in range(-n - 2, len(d) + 3):
                    if sum(x in d[max(0, s + j - 2) : max(0, s + j + 3)] for j, x in enumerate(win)) >= need:
                        out.add((doc_id, name))
                        break
    return out


def test_proximity_with_words_replaced_against_brute_force(spark):
    import random

    rng = random.Random(7)
    rows, items = [], []
    for i in range(30):
        own = [f"i{i}w{j}" if j % 3 == 0 else rng.choice("the of and to in is".split()) for j in range(rng.choice((1, 4, 5, 9, 10, 14)))]
        items.append((str(i), " ".join(own)))
        for changed in range(4):
            copy = list(own)
            for at in rng.sample(range(len(own)), min(changed, len(own))):
                copy[at] = rng.choice(("zz", "the", f"i{i}w0"))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                copy.insert(rng.randrange(len(copy) + 1), "uh")
            around = [rng.choice("the of and to in is other".split()) for _ in range(rng.choice((0, 0, 12)))]
            rows.append((len(rows), " ".join(around + copy + around)))
    # the rarest word replaced, also where the corpus does not hold it at all
    rows.append((1000, "one two three four five six CHANGED eight nine ten"))
    items.append(("s", "one two three four five six seven eight nine ten"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, x) for r in D.matches(docs, bench).select("doc_id", "near").collect() for x in r.near}
    assert got == brute_near(rows, items)
    assert (1000, "s") in got


def test_near_items_are_a_registered_result(spark, sf_dir, tmp_path):
    import __spark_entry__

    docs, items = frames(spark)
    docs.where("doc_id <> 6 OR doc_id IS NULL").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = __spark_entry__.queries()["op5_near"](spark, str(tmp_path)).collect()
    rows = [(a, b) for a, b in DOCS if a != 6]
    near = brute_near(rows, [(str(a), b) for a, b in ITEMS])
    assert {(r.doc_id, x) for r in got for x in r.near_items} == near and near
    assert len(got) == len(rows) and all(r.n_near_items == len(r.near_items) for r in got)
