"""Layouts under Structured Streaming.

Dehydration looks at one row at a time, so it runs on a stream as it is. Hydration needs the
quads of a subject together: each micro-batch is added to a quad table, and the subjects
that it touches, with all that lead to them over links, are hydrated again from that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shapeloom.operators.dehydrate import dehydrate_rows
from shapeloom.operators.hydrate import hydrate
from shapeloom.plans.layouts import Layouts
from shapeloom.shared import stored


def dehydrate_stream(layouts: Layouts, ref: str, rows: DataFrame, key: list[str], **options) -> DataFrame:
    """A stream of quads. Rows that fail emit nothing; quads aren't made distinct, as that
    would need state without bound (use ``dropDuplicatesWithinWatermark`` where time allows)."""
    return dehydrate_rows(layouts, ref, rows, key, **options).select(F.inline_outer("quads")).where("s IS NOT NULL")


def upwards(quads: DataFrame, touched: DataFrame) -> DataFrame:
    """The resources ``touched`` (in0) and all whose quads lead to one of them: a tree changes
    with the nested nodes that it shows. One join a level of links, until there is no new one."""
    links = quads.where(F.col("o").rlike("^(<|_:)")).select(F.col("o").alias("in0"), "s").distinct()
    known = new = stored(touched, "stream-touched", small=True)
    while True:
        new = links.join(new, "in0").select(F.col("s").alias("in0")).distinct().join(known, "in0", "left_anti")
        new = stored(new, "stream-parents", small=True)
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new), "stream-touched", small=True)


def hydrate_stream(layouts: Layouts, ref: str, quads: DataFrame, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that keeps all quads at ``table`` (Parquet, one folder a batch, so a
    repeated batch replaces its own) and gives ``sink`` the trees of touched subjects and of
    those above them."""

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.dropDuplicates().write.mode("overwrite").parquet(f"{table}/batch={number}")
        whole = spark.read.schema(new.schema).parquet(table).select("s", "p", "o", "g").dropDuplicates()
        touched = spark.read.schema(new.schema).parquet(f"{table}/batch={number}").select(F.col("s").alias("in0")).distinct()
        sink(hydrate(layouts, ref, whole, upwards(whole, touched), **options), number)

    return quads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
