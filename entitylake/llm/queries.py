"""The registered queries of the corpus operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, debruijn, itq, langid, linedrop, mixing, permutation, radix, simhash, spelling, toxicity, wrapper
from .common import table

#: Rank file and pattern of the tokenizer that the query uses; the operator takes both as parameters.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path(RANK_FILE), "pattern": public_tokenizers.PATTERN}


def op1_itq_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op2_debruijn_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.repeated_words(table(spark, folder, "documents", "doc_id", "text")).drop("n_spans")


def op3_radix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return radix.repeated_bytes(table(spark, folder, "documents", "doc_id", "text"))


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents", "doc_id", "text"), **tokenizer())


def op5_subsequence_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    return toxicity.split_score(table(spark, folder, "documents", "doc_id", "text"), labels)


def op6_wrapper_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_text(table(spark, folder, "pages", "page_id", "url", "html"))


def op7_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.split_predict(table(spark, folder, "documents", "doc_id", "text", "lang"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_words(table(spark, folder, "documents", "doc_id", "text", "source"))


def op10_permutation_search(spark: SparkSession, folder: str) -> DataFrame:
    return permutation.self_search(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents", "doc_id", "text"))


def op12_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return linedrop.line_digests(table(spark, folder, "documents", "doc_id", "text"))


def op13_hadamard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_itq_near_vectors": op1_itq_near_vectors,
    "op2_debruijn_repeats": op2_debruijn_repeats,
    "op3_radix_repeats": op3_radix_repeats,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_subsequence_toxicity": op5_subsequence_toxicity,
    "op6_wrapper_main_text": op6_wrapper_main_text,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_language_id": op8_language_id,
    "op9_mix_sources": op9_mix_sources,
    "op10_permutation_search": op10_permutation_search,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_runs": op12_line_runs,
    "op13_hadamard_clusters": op13_hadamard_clusters,
}

ORACLE: dict[str, str] = {
    "op2_debruijn_repeats": debruijn.SQL,
    "op3_radix_repeats": radix.SQL,
    "op9_mix_sources": mixing.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_line_runs": linedrop.SQL,
    "op13_hadamard_clusters": centroids.SQL,
}
