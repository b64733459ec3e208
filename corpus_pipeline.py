"""A training corpus from raw documents: five stages, each on all that the one before kept.

Documents that score as toxic go; of each group of near duplicates one stays;
documents that hold benchmark text go; secrets in the texts are replaced; the
texts are encoded.

Defined results: every stage judges rows, not doc_ids, so rows with null or
repeated ids are each treated as they stand; rows that are equal in all columns
are near duplicates like any other; null and empty texts are alike to all
stages and no secret, and of their group one row stays, the one of the smallest
doc_id; further columns of the documents stay up to the last stage, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bpe, common, decontaminate, secrets, simhash, toxicity


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def replace_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secrets", replace_secrets), ("byte_bpe", encode),
]

#: Compressed lengths, fitted thresholds and byte-pair merges are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
