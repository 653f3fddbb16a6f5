"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import benchmark_hits, item_digest
from . import toxicity
from .html import extract_text
from .langid import held_out, identify
from .linededup import line_dedup
from .mixing import mix
from .pii import session_key, surrogates
from .simhash import hex_fingerprint, simhash_groups
from .suffixdedup import repeated_spans
from .sql import ORACLES
from .topk import top_k


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates(docs, session_key(spark), count_col="n_mentions")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        item_digest(F.col("items")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.rate(docs, lexicon).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", "n_units", "n_removed", spans.alias("removed"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_text": op2_html_text,
        "op3_surrogates": op3_surrogates,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_topk": op6_topk,
        "op7_line_dedup": op7_line_dedup,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
