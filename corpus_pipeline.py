"""Corpus cleaning in five stages: quality rules, near-duplicates, decontamination, private data,
tokens. Each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, partenum, quality, sentencepiece_codec, surrogates
from pairloom.llm.queries import TOKENIZER, surrogate_params
from pairloom.llm.storage import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts, repetitive ones, and texts that are
    little but lines of their source's other documents. A text of any length is judged whole; rows that
    repeat stay or go together; an empty table stays empty; further columns pass through."""
    return quality.keep_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; so does every document
    without words or without an id, which has no links. Rows that repeat an id stay together. An empty table
    stays empty; further columns pass through."""
    later = partenum.join_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other slots, go. Null and empty texts hold none;
    rows that repeat a doc_id go together; an empty table stays empty; further columns pass through."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data gets surrogates; n_chars follows the new text. No row goes, a null text stays null, repeated
    rows change alike; an empty table stays empty; further columns pass through."""
    out = surrogates.replace_private(docs, surrogate_params(spark)).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, beside its columns, with both checks. A null or empty text has no ids; every row gets
    a result, of any length and repeated or not; an empty table gives none."""
    return sentencepiece_codec.encode_texts(docs, TOKENIZER, docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written to the shared folder, and the
    table of the stage before it is removed. What single stages do with odd rows holds for the whole."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch.write(out, f"stage{i + 1}")
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            scratch.drop(before)
        before = path
    return docs
