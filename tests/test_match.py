"""What a plan of graph patterns keeps in one task."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from shapeloom.operators import match as M
from shapeloom.operators.match import GRAPH, star
from shapeloom.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quads_are_dealt_out_before_a_star_sorts_them(spark):
    below = plan(QUERIES["preset_types"](spark, DATA)).rpartition("Exchange")[2]
    assert "Generate" in below  # the scan that makes the quads
    assert "Sort" not in below and "Aggregate" not in below


def test_star_over_graphs_and_many_quads_of_one_subject(spark):
    rows = [("a", "p", "1", ""), ("a", "q", "2", ""), ("a", "p", "3", "g"), ("b", "q", "4", ""), ("c", "p", "5", "g"), ("a", "r", "6", "")]
    rows += [("b", "p", f"o{i}", "") for i in range(500)]
    quads = spark.createDataFrame(rows, "s string, p string, o string, g string")
    frames = spark.createDataFrame([(g, s) for g in ("", "g") for s in "abcd"], f"{GRAPH} string, _0 string")
    got = star(quads, frames, "_0", [("q", "y", "ny"), ("p", "x", "nx"), ("p", "z", "nz")])
    assert sorted(map(tuple, got.select(GRAPH, "_0", F.coalesce("x", F.lit("-")), "nx", F.coalesce("y", F.lit("-")), "ny", F.coalesce("z", F.lit("-")), "nz").collect())) == [
        ("", "a", "1", 1, "2", 1, "1", 1),
        ("", "b", "-", 2, "4", 1, "-", 2),
        ("", "c", "-", 0, "-", 0, "-", 0),
        ("", "d", "-", 0, "-", 0, "-", 0),
        ("g", "a", "3", 1, "-", 0, "3", 1),
        ("g", "b", "-", 0, "-", 0, "-", 0),
        ("g", "c", "5", 1, "-", 0, "5", 1),
        ("g", "d", "-", 0, "-", 0, "-", 0),
    ]


def test_a_triangle_shuffles_its_large_side_as_keys_and_then_what_passes_a_filter(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = plan(QUERIES["bgp_triangle"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    large = got[: got.index("SortMergeJoin [o_orderkey")].split("\n")  # from the result down to the keys
    shuffles = [i for i, x in enumerate(large) if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and "o_custkey" in large[shuffles[1]]
    assert any("BroadcastHashJoin" in x and "_word" in x for x in large[shuffles[0] : shuffles[1]])


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_cycles_of_patterns(spark, monkeypatch, words):
    monkeypatch.setattr(M, "WORDS", words)
    rng = random.Random(7)
    rows = sorted({(f"n{rng.randrange(12)}", rng.choice("pq"), f"n{rng.randrange(12)}", rng.choice(["", "g", "h"])) for _ in range(260)})
    quads = spark.createDataFrame(rows, "s string, p string, o string, g string")
    nodes = [f"n{i}" for i in range(12)]
    has = set(rows)
    frames = spark.createDataFrame([("",), ("g",)], f"{GRAPH} string")
    got = M.match(quads, frames, ((0, "p", 1, None), (1, "q", 2, None), (2, "p", 0, None)))
    want = [(g, a, b, c) for g in ("", "g") for a in nodes for b in nodes for c in nodes if {(a, "p", b, g), (b, "q", c, g), (c, "p", a, g)} <= has]
    assert want and sorted(map(tuple, got.select(GRAPH, "_0", "_1", "_2").collect())) == sorted(want)
    got = M.match(quads, spark.createDataFrame([("",)], f"{GRAPH} string"), ((0, "p", 1, 3), (1, "q", 2, 3), (0, "q", 2, 3)))
    want = [(a, b, c, g) for g in ("g", "h") for a in nodes for b in nodes for c in nodes if {(a, "p", b, g), (b, "q", c, g), (a, "q", c, g)} <= has]
    assert want and sorted(map(tuple, got.select("_0", "_1", "_2", "_3").collect())) == sorted(want)


def test_the_filter_of_a_cycle_lets_all_that_fits_through_and_little_else(spark):
    pairs = spark.range(50_000).select(F.col("id").cast("string").alias("_0"), (F.col("id") % 7).cast("string").alias("_1"))
    kept = M.likely(pairs, pairs.where("_0 % 10 = 0"), ["_0", "_1"])
    assert kept.columns == ["_0", "_1"] and kept.where("_0 % 10 = 0").count() == 5_000 and kept.count() < 5_500
