"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

Each batch of documents is reduced to digests of its normalised texts, grouped (a partial
aggregate runs before the shuffle, so a text of many copies sends one row a task), and
sort-merge anti-joined with the index; unseen digests are appended to it as a run of its own.
The index is a folder that all executors share (``runs``); opened again in a later session, it
dedups new data against all earlier batches.

Defined cases: a null text counts as empty; empty texts are equal to one another; of
repeated rows with one ``doc_id`` all stay rows of the result and count in ``group_size``, and
all rows with the id that stays are marked kept; a null ``doc_id`` sorts after all others when
that id is chosen; other columns are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.runs import RunStore, halves
from shapeloom.shared import shared_path, stored, tidy

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of blanks replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Runs of (digest, keep_id), bucketed and sorted by digest, in the folder ``path``: one row
    for each text that any batch has had."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.store = RunStore(spark, path, f"digest string, keep_id {id_type}", "digest", buckets)

    def read(self) -> DataFrame:
        return self.store.read()

    def add(self, groups: DataFrame) -> DataFrame:
        """Appends those (digest, keep_id) rows whose digest no run has, and returns them."""
        for run in self.store.runs:
            groups = groups.join(self.store.table(run).select("digest").hint("merge"), "digest", "left_anti")
        return self.store.table(self.store.append(groups.select("digest", "keep_id")))

    def drop(self) -> None:
        self.store.drop()


@tidy
def exact_dedup(batches: DataFrame | list[DataFrame], index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    The batches go through the index one after another. ``keep_id`` is the smallest id of the
    first batch that has the text, in this call or an earlier one; only rows of that batch are
    kept, and ``group_size`` counts the rows of this call. Digests not in the index are
    appended to it.
    """
    rows = fresh = None
    for batch in [batches] if isinstance(batches, DataFrame) else batches:
        own = stored(batch.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "exact-digests")
        new = index.add(own.groupBy("digest").agg(F.min("id").alias("keep_id"))).select("digest")
        fresh = new if fresh is None else fresh.unionByName(new)
        rows = own if rows is None else rows.unionByName(own)
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    kept = index.read().join(groups.hint("merge"), "digest").join(fresh.withColumn("fresh", F.lit(True)).hint("merge"), "digest", "left")
    groups = stored(kept, "exact-groups", small=True)
    index.store.settle()
    out = rows.join(groups.hint("merge"), "digest")
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.coalesce("fresh", F.lit(False)) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches by ascending id, the second against the index that the
    first one left."""
    index = DigestIndex(spark, shared_path(spark, "digest-index"))
    out = exact_dedup(halves(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), index)
    index.drop()
    return out


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
