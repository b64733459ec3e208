import hashlib

import corpus_pipeline as C
from pyspark.sql import functions as F

from tesserae.llm import secrets, toxicity

from .test_bpe import digests
from .test_decontaminate import brute as brute_hits
from .test_simhash import brute as brute_components
from .test_simhash import slow_fingerprint


def test_whole_table_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    if model:
        distances = toxicity.Distances(*model[:2])
        odds = lambda t: sum(w * f for w, f in zip(model[2], (1.0, *toxicity.features((t or "").encode(), distances))))
        texts = {d: t for d, t in texts.items() if odds(t) < 0}
    rows = [(d, slow_fingerprint(t)) for d, t in sorted(texts.items())]
    texts = {d: texts[d] for (d, _), c in zip(rows, brute_components(rows)) if c == d}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits(list(texts.items()), items)
    texts = {d: t for d, t in texts.items() if not hits[d][1]}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: r.found for r in secrets.scan(left).select("doc_id", "found").collect()}
    for d, found in spans.items():
        out, at = "", 0
        for x in found:
            if x.start >= at:
                out += texts[d][at : x.start] + "[SECRET]"
            at = max(at, x.end)
        texts[d] = out + texts[d][at:]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, sf_dir).collect()}
    assert got == {d: digests(t) for d, t in texts.items()}
    assert 0 < len(got) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    rows = [(1, "same words here now", "en", "a", 19), (2, "same words here now", "en", "a", 19), (1, "same words here now", "en", "a", 19),
            (None, "a lone text without an id", None, None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, 'x token = "abcdefgh12"', "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert docs.count() == 4
    assert got == {1: ("same words here now", 19), None: ("a lone text without an id", 25), 4: (None, 0), 6: ('x [SECRET]"', 11)}
    assert C.encode(spark, docs.select(*docs.columns), sf_dir).agg(F.sum("n_tokens")).first()[0] > 0


def test_ids_reach_the_result(spark, sf_dir):
    rows = C.run(spark, sf_dir).collect()
    assert all(len(r.ids) == r.n_tokens for r in rows) and any(r.ids for r in rows)
    assert all(hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in rows)


def test_rows_are_judged_by_themselves(spark, sf_dir):
    """Null and repeated ids: no row goes because of another one that shares its id; clashing columns stay."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    own = [f"{w} " + " ".join(f"{w}{i}{w}" for i in range(30)) for w in ("ab", "cd", "ef", "gh", "ij", "kl", "mn")]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (7, own[3]), (7, own[4]), (8, own[5]), (8, item), (None, item), (9, own[6]), (9, own[6]), (None, own[6])]
    docs = spark.createDataFrame([(d, t, "en", "a", 5, i, 42) for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, nth_of_id int")
    near = C.drop_near_duplicates(spark, docs, sf_dir)
    kept = {r.row for r in near.collect()}
    assert near.columns == docs.columns and {r.nth_of_id for r in near.collect()} == {42}
    assert {0, 1, 2, 3, 4, 5} <= kept and len(kept & {6, 7}) == 1 and len(kept & {8, 9}) == 1 and 10 not in kept
    clean = C.drop_contaminated(spark, docs, sf_dir)
    assert {r.row for r in clean.collect()} == {0, 1, 2, 3, 4, 5, 8, 9, 10} and clean.columns == docs.columns
    done = C.replace_secrets(spark, clean, sf_dir)
    assert sorted(map(str, done.drop("n_chars").collect())) == sorted(map(str, clean.drop("n_chars").collect()))
    assert C.encode(spark, done, sf_dir).count() == 9


def test_columns_of_any_name_and_type_stay(spark, sf_dir):
    docs = spark.sql("""SELECT id AS doc_id, concat('text number ', id, ' is its own') AS text, 'en' AS lang, 'a' AS source, 9L AS n_chars,
        map('k', id) AS held, id AS `a.b`, id AS `Row`, id AS `back``tick`, array(id) AS found FROM range(3)""")
    for _, stage in C.STAGES[1:-1]:
        docs = stage(spark, docs, sf_dir)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "held", "a.b", "Row", "back`tick", "found"]
    assert sorted((r.doc_id, r["a.b"], r.Row, r.held["k"], r.found) for r in docs.collect()) == [(i, i, i, i, [i]) for i in range(3)]
