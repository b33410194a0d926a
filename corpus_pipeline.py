"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; stages are joined by Parquet tables in the folder that the executors share. All
stages but the last return the columns of their input, whatever their names, and an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oncelog.llm import decontamination, language_id, simhash_dedup, source_mix, token_output
from oncelog.llm.common import Workspace, scratch, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with at least half of the posterior.

    Null texts and texts without letters go; rows without lang, doc_id or source are judged
    by their text like others; repeated rows stay or go together. Without any labelled row
    there is no language to tell, and all go.
    """
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 over five-word shingles), that of the smallest doc_id.

    Null and empty texts are equal to each other; null doc_ids come last; rows of one doc_id
    and different texts are separate documents, rows that repeat both are copies.
    """
    return simhash_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or with other numbers, names and units.

    Null and empty texts are clean; rows of one doc_id, null too, are kept or dropped together.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source cut to its words.

    Documents without words are not taken; a null source is a source; null doc_ids have no
    quality label; rows that tie at a source's cut share what is left.
    """
    return source_mix.mixed_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as binary shards and read back.

    A null text is a document of the end id; null doc_ids come first, repeated ones side by side.
    """
    return token_output.write_tokens(docs, scratch(spark, "tokens"), token_output.default_tokenizer()).documents()


STAGES = [("language", identify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL has no tokenizer; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.write(stage(spark, docs, sf_dir), name)
        work.drop(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    work.drop(docs)
    return out
