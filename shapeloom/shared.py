"""The folder that the driver and all executors share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session, whose driver is its one executor, gets a folder of its own
    where the setting is absent; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def delete(spark: SparkSession, path: str) -> None:
    fs, file = file_system(spark, path)
    fs.delete(file, True)


#: Shuffle partitions of small rows (ids, digests, links) that one task writes as one file.
TOGETHER = 8


def fewer_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, for rows that are small beside the documents they are
    about. A task goes through its shuffle partitions one after another, so it needs no more
    memory, and there are at least two tasks a core."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER
    return df.coalesce(max(n, 2 * spark.sparkContext.defaultParallelism))


#: Paths written by ``stored`` inside the calls of ``tidy`` functions that run now.
_written: list[list[str]] = []


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and no
    executor's loss can undo it. ``small``: its rows are small."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (fewer_files(df) if small else df).write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result, of small rows, is stored, and which leaves no other table that
    it stored on its way. The result stays in the shared folder as Spark's own checkpoints do;
    inside another such function it goes with that one's tables."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        own: list[str] = []
        _written.append(own)
        try:
            df = f(*args, **kwargs)
        finally:
            _written.pop()
        out = stored(df, f.__name__.replace("_", "-"), small=True)
        for path in own:
            delete(df.sparkSession, path)
        return out

    return run


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
