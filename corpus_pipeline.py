"""A corpus pipeline: language ID, near-dedup, decontamination, surrogates, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import langid
from lamella.llm.common import column_of, packed, shared_folder, table
from lamella.llm.decontaminate import decontaminate
from lamella.llm.mixing import mix
from lamella.llm.pii import session_key, surrogates
from lamella.llm.simhash import similar_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go; lang is set where it was null."""
    apart = ["doc_id", "text", "lang"]
    found = langid.identify(packed(docs, apart), keep=[*apart, "lm_doc"])
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return found.where(F.col("lang_pred") != langid.NONE).select(*[lang if c == "lang" else column_of(c, apart) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays.

    Candidates by SimHash and its Gray-order index, and by MinHash beyond its radius; links by exact similarity.
    A repeated row of that id stays once; rows without an id stay.
    """
    groups = similar_groups(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates(docs, session_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: SQL cannot express the trained classifier and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
