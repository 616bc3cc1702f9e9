"""JSON trees: one document a line (or a file) in, canonical or pretty text out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("application/json", "json")


def read_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(key, value: VARIANT); the key is the file and a hash of the document."""
    lines = spark.read.option("wholetext", whole_files).text(path)
    rows = lines.where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value")
    return rows.select(F.concat_ws("#", "file", F.sha2("value", 256)).alias("key"), F.parse_json("value").alias("value"))


def pretty(lines: DataFrame, column: str = "json") -> DataFrame:
    """JSON texts indented, by Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shown = [None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"value": shown}, pa.schema([("value", pa.string())]))

    return lines.select(column).mapInArrow(run, "value string")


def write_json(trees: DataFrame, path: str, column: str = "json", indented: bool = False, mode: str = "errorifexists") -> None:
    """One tree a line; rows that failed (null) are left out."""
    rows = trees.where(F.col(column).isNotNull())
    (pretty(rows, column) if indented else rows.select(F.col(column).alias("value"))).write.mode(mode).text(path)
