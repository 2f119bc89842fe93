"""A training-corpus pipeline: five stages over documents, each written as Parquet and reread.

1. language ID: documents that no language model accepts go;
2. line dedup: repeated multi-line chunks are cut from the texts, documents left empty by it go;
3. near-duplicates: of each group of near copies (four fifths of their five-word shingles shared) the document of the smallest doc_id stays;
4. mixing: whole documents are chosen to the target weights of domains, languages and sources, one epoch;
5. encoding: token counts and digests of the byte-level BPE ids and of their decoding.

Stages 1 to 4 return the columns of documents. Stage 1 learns from the labels of its own input,
as a corpus-wide service would; predictions never read a document's own label.

Defined results: a null text, or one without letters, is rejected by stage 1, as is one whose bits per letter exceed what calibration
texts of its length reach; an empty table gives an empty table; of rows that repeat a doc_id and a text
all stay together or go together up to stage 3, and stage 4 chooses among them as among any documents; documents without a
doc_id are compared with nothing and never removed as copies; columns that documents has beside its own pass through by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, lang_id, line_dedup, mixing, near_dup
from chronofold.llm.common import cut, drop_cuts, like_documents, table
from chronofold.llm.queries import PATTERN, RANKS

#: Percent of the union of two documents' shingles that makes them near copies here.
NEAR = 80
MIX = mixing.Mix(share=0.75, epochs=1)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.train(docs.where(~lang_id.held_out()))
    return like_documents(lang_id.identify(docs, model).where("accepted"), spark, sf_dir)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_chunks(docs).where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return like_documents(out, spark, sf_dir)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = near_dup.near_duplicates(docs, NEAR)
    gone = verdicts.where("not kept").select("doc_id").distinct()
    return like_documents(docs.join(gone.hint("merge"), "doc_id", "left_anti"), spark, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagged = docs.withColumn("domain", mixing.domain_of(F.col("source")))
    return like_documents(mixing.choose(tagged, MIX, mixing.words_in(F.col("text"))), spark, sf_dir)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, RANKS, PATTERN, passing=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_near),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: SQL expresses neither the language models nor the encoding; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = cut(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            drop_cuts(spark, docs)
        docs = out
    return docs
