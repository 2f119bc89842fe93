"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import ann, bpe, html_extract, imatch, lang_id, line_dedup, mixing, near_dup, pii, substring_dedup
from chronofold.llm.common import table

#: The ranks file and split pattern of the encoding queries; a parameter, never copied here.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", "text")
    chosen = mixing.choose(docs, mixing.Mix(), mixing.words_in(F.col("text")))
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, PATTERN)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs).drop("base")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_with_next(docs, imatch.lexicon(docs))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_mixing, op3_suffix_dedup, op4_byte_bpe, op5_personal_data, op6_line_dedup, op7_imatch_fingerprints, op8_nearest_neighbours, op9_language_id, op10_minhash_near_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle(mixing.Mix()), "op6_line_dedup": line_dedup.oracle()}
