"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept and returns them less those it rejects (quality, near-duplicates,
contamination) or with personal data redacted; the last returns the places of all token pieces in their sequences.
Stages are written as Parquet and read back, so that each is planned on true sizes and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import decontaminate, near_dedup, packing, pii, quality_rules, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line-frequency rules keep.

    Null and empty texts have no words and are rejected; texts of any length are read whole. Repeated rows share their
    fate and all stay or go; nulls in other columns are kept (null sources are one host). Of documents that lose the
    same frequent line, the one with the smallest line fingerprint keeps it. An empty table gives an empty result.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The smallest doc_id of a group stays, nulls last; of rows that repeat it and its text, one. Rows without words are
    linked with nothing and all stay; so does a null doc_id that nothing else is linked with. Texts are read whole. An
    empty table gives an empty result.
    """
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words stand in benchmark passages.

    Null and empty texts have no words and stay. Repeated rows share their fate. Null or wordless items match nothing,
    and an empty benchmark leaves all documents. An empty table gives an empty result.
    """
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars brought up to date where a text changes.

    Null texts stay null, empty ones empty. Overlapping spans become one, named by the first; of equal starts, by the
    order of kinds. Repeated rows all stay. An empty table gives an empty result.
    """
    return pii.redact(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of at most 2048 tokens.

    Null and empty texts are a piece of one end id. Longer texts are cut into pieces. Repeated rows are packed once
    each; pieces of one length are numbered by doc_id, piece and ids. An empty table gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: SQL can't express the tokenizer of the last stage; tests/llm/test_methods.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its result is written."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = set(shared.WRITTEN)
        docs = shared.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        shared.clean(spark, [p for p in shared.WRITTEN[:-1] if p not in before])
    return docs
