"""The corpus pipeline: quality, exact and near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the rows that stay with the columns of ``docs`` (the last one the digests of their ids). Its
result is written as Parquet and reread as the next one's ``docs``.

In all stages: ``docs`` may have further columns of any name, which stay; an empty table gives
an empty one; rows are told apart by id and text, so repeated and null ids are no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm import exact_dedup, jaccard_join, quality_knn, sentencepiece_fst
from shapeloom.llm.decontaminate import keep_clean
from shapeloom.llm.ids import LAST
from shapeloom.llm.language_model import held_out
from shapeloom.llm.runs import halves
from shapeloom.shared import delete, free_name, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above. Null and empty texts
    have the score of the share of good labels; without labelled rows every score is 0.5, below
    the threshold, so nothing stays; repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    model = quality_knn.fit(docs, labels)
    score = free_name(docs, "score")
    scored = quality_knn.score_quality(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality_knn.THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id (one of several with that id). Null counts
    as empty, and empty texts are equal; a null id counts as larger than all others, and texts
    of blanks only are equal to one blank."""
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digest-index"))
    found = exact_dedup.exact_dedup(halves(docs), index)
    index.drop()
    d, h = free_name(docs, "_d"), free_name(docs, "_h")
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = found.where("kept").select(shown.alias(d), F.col("text_sha256").alias(h)).distinct()
    rows = docs.withColumns({d: shown, h: exact_dedup.digest(F.col("text"))})
    return rows.join(kept.hint("merge"), [d, h], "left_semi").dropDuplicates([d, h]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: of those with the smallest id, the one with the
    least digest. Rows without words are a group each, of equal ones one stays.

    Ids may repeat or be null, so a row is known by its id and its text's digest; a null id
    counts as larger than all others.
    """
    d, h = free_name(docs, "_d"), free_name(docs, "_h")
    name = {d: F.coalesce("doc_id", F.lit(LAST)), h: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)}
    found = jaccard_join.similar_components(docs.withColumns(name), keep=[h])
    found = found.select(F.coalesce("doc_id", F.lit(LAST)).alias(d), h, "n_shingles", "class_id")
    own = F.concat_ws(":", d, h)  # of a row without words
    first = found.groupBy(F.when(F.col("n_shingles") > 0, F.col("class_id").cast("string")).otherwise(own)).agg(F.min(F.struct(d, h)).alias("k"))
    kept = first.select(f"k.{d}", f"k.{h}")
    return docs.withColumns(name).join(kept.hint("merge"), [d, h], "left_semi").dropDuplicates([d, h]).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs: one leaked passage is enough.
    Null, empty and wordless texts have none and stay; an empty benchmark drops nothing."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document that stayed, and of their decoded text, one row a row
    of ``docs``; null and empty texts have no ids."""
    return sentencepiece_fst.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier is no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
