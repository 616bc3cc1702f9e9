"""Immutable sorted runs with a manifest: what the incremental operators keep between batches.

A store is a folder. Each run is a folder of its own in it, bucketed and sorted by one key, and
never changes after its write. Which runs count is said by the manifest: numbered files, each
of which lists all runs of that version, of which the last one is valid. A run is written
first and committed by the next manifest file, which is created without overwriting, so a
writer that dies leaves a folder that no manifest names, and of two writers one fails. A store
opened again, in this session or another one, goes on from its last manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapeloom.llm.ids import is_whole
from shapeloom.shared import delete, file_system


class RunStore:
    """Runs of rows with the columns of ``schema`` (DDL), bucketed and sorted by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        self.buckets = self._manifest().get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {}
        fs, file = file_system(self.spark, f"{self.path}/manifest/{versions[-1]:012d}")
        stream = fs.open(file)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, runs: list[dict]) -> None:
        version = max(self._versions(), default=-1) + 1
        fs, file = file_system(self.spark, f"{self.path}/manifest/{version:012d}")
        stream = fs.create(file, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        stream.close()

    @property
    def runs(self) -> list[dict]:
        """The committed runs in the order of their commit, each a name and its number of rows."""
        return self._manifest().get("runs", [])

    def table(self, run: dict) -> DataFrame:
        """A run as a bucketed table, which joins on the key without a shuffle of its own. The
        session's catalog only needs to know its place."""
        name = f"run_{run['name']}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run['name']}'")
        return self.spark.table(name)

    def read(self, runs: list[dict] | None = None, bucketed: bool = True) -> DataFrame:
        """The rows of these runs (all, if not given). ``bucketed``: whether a join on the key
        shall do without a shuffle; if it has a shuffle, Spark can split keys of many rows."""
        out = None
        for run in self.runs if runs is None else runs:
            t = self.table(run) if bucketed else self.spark.read.schema(self.schema).parquet(f"{self.path}/{run['name']}")
            out = t if out is None else out.unionByName(t)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def _write(self, rows: DataFrame) -> dict:
        name, seen = uuid.uuid4().hex, Observation()
        dealt = rows.select(*self.schema.names).repartition(self.buckets, self.key).observe(seen, F.count(F.lit(1)).alias("rows"))
        dealt.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(f"run_{name}")
        return {"name": name, "rows": seen.get["rows"]}

    def _forget(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS run_{run['name']}")
        delete(self.spark, f"{self.path}/{run['name']}")

    def append(self, rows: DataFrame) -> dict:
        """Writes a run and commits it."""
        run = self._write(rows)
        self._commit([*self.runs, run])
        return run

    def compact(self, least: int = 1) -> None:
        """The last runs, ``least`` or more of them, become one. The merged run is written and
        committed before the old ones are deleted."""
        runs = self.runs
        old = runs[-least:] if least > 1 else runs
        if len(old) > 1:
            merged = self._write(self.read(old))
            self._commit([*runs[: len(runs) - len(old)], merged])
            for run in old:
                self._forget(run)

    def settle(self) -> None:
        """Merges the last two runs as long as the last is at least half as large as the one
        before it, so that each row is written again a logarithmic number of times and as many
        runs are left."""
        while len(runs := self.runs) > 1 and 2 * runs[-1]["rows"] >= runs[-2]["rows"]:
            self.compact(2)

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS run_{run['name']}")
        delete(self.spark, self.path)


def halves(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` as two batches: ids up to the middle one, then the larger ones and null. Ids that
    are no integers make one batch."""
    if not is_whole(docs, id_col):
        return [docs]
    cut = docs.agg(F.percentile_approx(id_col, 0.5)).first()[0]
    if cut is None:
        return [docs]
    low = F.coalesce(F.col(id_col) <= cut, F.lit(False))
    return [docs.where(low), docs.where(~low)]
