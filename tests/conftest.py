import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{root / 'shared'}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canonical, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows at the smallest size against its SQL's."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        mine = sorted(tuple(canonical(x) for x in r) for r in df.select(*columns).collect())
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in got.fetchall())
        assert mine == theirs

    return check
