"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a set of tables bucketed and sorted by digest, one row per distinct text:
(digest, keep_id, n). A batch is reduced to digests, pre-aggregated to one row per
text (so a text that a third of all rows share is one row before any join), and
anti-joined with the index: unseen digests are appended as a new bucketed run, and
seen ones add their counts in a run of updates. Runs are folded when the index is read.

Defined cases: a null text counts as empty; a null doc_id is smaller than every other
(it stays only where no row of its group has a doc_id); rows that repeat a doc_id all
count, and all of them are kept or dropped alike; an empty table gives an empty index;
other columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunLog, fresh, materialize, table, text_or_empty


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; digest is the sha256 of the text's UTF-8 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("digest"))


class DigestIndex:
    """A growing index of distinct texts; an index of a known name is opened, in any session."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.log = RunLog(spark, name or f"digest_index_{uuid.uuid4().hex}", "digest", "digest string, keep_id long, n long", buckets)

    def rows(self) -> DataFrame:
        """digest, keep_id, n: one row per distinct text seen so far."""
        runs = self.log.rows()
        if runs is None:
            return self.spark.createDataFrame([], "digest string, keep_id long, n long")
        return runs.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, digest); returns its texts that the index had not seen."""
        texts = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        if not self.log.runs:
            return self.spark.table(self.log.append(texts))
        seen = self.rows().select("digest")
        texts = materialize(texts, "digests")
        new = texts.join(seen.hint("merge"), "digest", "left_anti")
        again = texts.join(seen.hint("merge"), "digest", "left_semi")
        self.log.append(again)
        return self.spark.table(self.log.append(new))

    def compact(self) -> None:
        """Folds all runs into one."""
        if len(self.log.runs) > 1:
            self.log.replace(self.rows())


def mark_duplicates(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of a batch that the index holds."""
    # a plain table: joined with buckets, a text that many rows share would stay in one task
    marked = batch.join(materialize(index.rows(), "known"), "digest", "left")
    return marked.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs whose text the index has not seen, one of each text (the largest doc_id)."""
    (name,) = fresh(docs.columns, "digest")
    own = docs.withColumn(name, F.sha2(text_or_empty().cast("binary"), 256))
    new = index.add(digests(docs))
    stay = own.join(new, (own[name] == new["digest"]) & own["doc_id"].eqNullSafe(new["keep_id"]), "left_semi")
    return stay.dropDuplicates([name]).drop(name)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents in two batches, the second merged with the first's index."""
    rows = materialize(digests(table(spark, sf_dir, "documents")), "digests")
    index = DigestIndex(spark)
    late = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(False))
    for batch in (rows.where(~late), rows.where(late)):
        index.add(batch)
    index.compact()
    return mark_duplicates(rows, index)


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
