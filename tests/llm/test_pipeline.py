"""The stages against plain versions of them, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shapeloom.shared import stored
from tests.conftest import DATA
from tests.llm.test_cases import brute_components


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = [{tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} for w in bench if w]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stored(stage(spark, docs, DATA), "test-stage")
        kept = {r.doc_id for r in after.collect()}
        assert after.count() == len(kept) and kept <= set(before)
        if k == 0:
            good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
            bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
            assert len(good - kept) <= 0.05 * len(good) and len(bad & kept) <= 0.2 * len(bad)
        elif k == 1:
            least = {}
            for d, t in sorted(before.items()):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert kept == set(least.values())
        elif k == 2:
            assert kept == {d for d, (n, root) in brute_components(before.items()).items() if root == d}
        elif k == 3:
            low = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for d, t in before.items()}
            size = [len(next(iter(own))) for own in windows]
            found = {d: sum(any(tuple(w[i : i + n]) in own for i in range(len(w) - n + 1)) for own, n in zip(windows, size, strict=True)) for d, w in low.items()}
            leaked = {d for d in before if found[d]}
            assert leaked and kept == set(before) - leaked  # some were planted, and they go
        else:
            assert kept == set(before) and after.where("NOT lossless").count() == 0
            break
        assert after.columns == columns
        docs = after


LONG = "alpha beta gamma delta " * 20_000
ROWS = [(1, None, "en"), (None, "a b c", None), (2, "a b c", "en"), (2, "a b c", "en"), (3, "", "en"), (3, " \t\n", "en"), (4, LONG, "en"), (5, LONG + "end", "en"), (5, "other words of one id", "en"), (None, None, None)]


def rows_of(spark, clash=False):
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("_d", "_h", "_items", "score", "d", "id", "c", "n_shingles", "class_id", "component_id", "digest", "keep_id", "label", "w", "x", "key")
    return docs.withColumns({c: F.lit("x") for c in names}) if clash else docs


@pytest.mark.parametrize("clash", [False, True])
def test_stages_on_odd_rows(spark, clash):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    docs = rows_of(spark, clash)
    want = {
        "exact dedup": [(1, None), (2, "a b c"), (3, " \t\n"), (4, LONG), (5, LONG + "end"), (5, "other words of one id")],
        "n-gram Jaccard join": [(1, None), (2, "a b c"), (3, " \t\n"), (4, LONG), (5, "other words of one id")],
    }
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stored(stage(spark, docs, DATA), "test-stage")
        assert out.columns == docs.columns
        docs = out
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want.get(name, want["n-gram Jaccard join"]), key=str)
    ids = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in ids) == [1, 2, 3, 4, 5] and all(r.lossless for r in ids)


@pytest.mark.parametrize("clash", [False, True])
def test_quality_on_odd_rows(spark, clash):
    docs = rows_of(spark, clash)
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    both = real.unionByName(docs, allowMissingColumns=True)
    out = corpus_pipeline.quality(spark, both, DATA)
    assert out.columns == both.columns
    kept = out.where("text IS NOT NULL AND text <> ''").count()
    assert 100 < kept < real.count()
    assert corpus_pipeline.quality(spark, docs, DATA).columns == docs.columns


def test_of_two_rows_with_one_id_the_copy_goes(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (5, text + " x"), (5, "something else of more than five words"), (None, text + " y"), (None, text + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near(spark, docs, DATA).collect()) == sorted([text, "something else of more than five words"])


def test_empty_tables(spark):
    none = rows_of(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_registration():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert len(names) == 11
