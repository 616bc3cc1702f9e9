"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of 8 consecutive words of a benchmark item (the whole item if it is
shorter). For each pattern length there is one searcher: a shift table over blocks of two
words says how far the search may jump, a jump of zero leads to the bucket of patterns with
that suffix block, and the words of those patterns are compared one by one. Many cursors
advance together as numpy vectors, each over its own strip of a text; strips overlap by the
pattern length, so whole texts are searched.

The benchmark is compiled on the driver in blocks of at most ``BLOCK_WORDS`` words, which
bounds what is collected and broadcast; each block is one pass over the documents, and hits
of several blocks are merged by document.

Defined cases: null or wordless texts have no words and no hits; wordless items have no
window; repeated items count once by id; an item without id counts as the item "";
documents with equal ids each get their own row; other columns are ignored; an empty
benchmark gives zero hits, an empty table an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.lean import lean
from shapeloom.llm.words import NON_ALNUM, Words, chunked, mix, owner
from shapeloom.shared import free_name

WINDOW = 8
LEAST_ITEMS = 2
BLOCK_WORDS = 1_000_000
STRIP = 256


class Searcher:
    """Wu-Manber tables for distinct patterns of ``m`` words each."""

    def __init__(self, patterns: list[tuple[bytes, ...]], hashes: np.ndarray):
        self.patterns, self.m = patterns, hashes.shape[1]
        self.block = min(2, self.m)
        self.default = self.m - self.block + 1
        self.bits = min(22, max(10, int(np.ceil(np.log2(8 * len(patterns) * self.default)))))
        self.shift = np.full(1 << self.bits, self.default, np.int64)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.slot(self.blocks(hashes, end)), self.m - 1 - end)
        suffix = self.blocks(hashes, self.m - 1)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.bucket, self.hashes = suffix[order], order, hashes

    def blocks(self, hashes: np.ndarray, end) -> np.ndarray:
        """The hash of the block that ends at word ``end`` (an index or vector of them)."""
        x = hashes[..., end]
        return x if self.block == 1 else mix(x + np.uint64(3) * hashes[..., end - 1])

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences."""
        low, high = words.first[:-1] + self.m - 1, words.first[1:]
        n = np.maximum(0, -(-(high - low) // STRIP))
        doc = np.repeat(np.arange(len(n)), n)
        at = low[doc] + STRIP * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(at + STRIP, high[doc])
        ends = []
        while len(at):
            jump = self.shift[self.slot(self.blocks(h, at))]
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        block = self.blocks(h, end) if len(end) else np.empty(0, np.uint64)
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        each = hi - lo
        pos = np.repeat(end, each)
        k = self.bucket[np.repeat(lo, each) + np.arange(len(pos)) - np.repeat(np.cumsum(each) - each, each)]
        first = pos - self.m + 1
        same = np.ones(len(pos), bool)
        for j in range(self.m):  # direct comparison, by hash and then by the words themselves
            same &= h[first + j] == self.hashes[k, j]
        first, k = first[same], k[same]
        data, starts, stops = words.data, words.starts, words.ends
        ok = [all(data[starts[i + j] : stops[i + j]].tobytes() == w for j, w in enumerate(self.patterns[p])) for i, p in zip(first.tolist(), k.tolist(), strict=True)]
        ok = np.array(ok, bool)
        return first[ok], k[ok]


class Benchmark:
    """The searchers of one block of items; ``items[m][k]`` are the ids with a pattern."""

    def __init__(self, rows: list[tuple[str, str]]):
        by: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        hash_of: dict[tuple[bytes, ...], np.ndarray] = {}
        if rows:
            words = Words(pa.array([t for _, t in rows], pa.string()), NON_ALNUM, lower=True)
            h = words.hashes()
            for i, (item, _) in enumerate(rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                m = min(WINDOW, b - a)
                own = [words.data[words.starts[j] : words.ends[j]].tobytes() for j in range(a, b)]
                for j in range(b - a - m + 1 if m else 0):
                    key = tuple(own[j : j + m])
                    by.setdefault(m, {}).setdefault(key, set()).add(item)
                    hash_of[key] = h[a + j : a + j + m]
        self.searchers = [Searcher(list(ps), np.array([hash_of[p] for p in ps])) for _, ps in sorted(by.items())]
        self.items = [[sorted(x) for x in ps.values()] for _, ps in sorted(by.items())]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its number of words, hit spans in words, and item ids."""
        words = Words(column, NON_ALNUM, lower=True)
        h = words.hashes()
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        items: list[set[str]] = [set() for _ in range(len(column))]
        for s, ids in zip(self.searchers, self.items, strict=True):
            first, k = s.find(words, h)
            order = np.argsort(first, kind="stable")
            for f, p, d in zip(first[order].tolist(), k[order].tolist(), owner(first[order], words.first).tolist(), strict=True):
                a = f - int(words.first[d])
                if spans[d] and spans[d][-1][0] <= a <= spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], a + s.m))
                else:
                    spans[d].append((a, a + s.m))
                items[d].update(ids[p])
        return np.diff(words.first), [merged(x) for x in spans], [sorted(x) for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<s:int,e:int>>"
_span_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks whose size is known before they are collected."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.floor(F.length("text") / 2) + 1), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // limit))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) if n > 1 else items
        yield [(r.item, r.text) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document: id, n_words, spans (hit words, merged), items (ids)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    passes = []
    for block in _blocks(benchmark, block_words):
        table = spark.sparkContext.broadcast(Benchmark(block))

        def search(batches, table=table):
            for batch in chunked(batches):
                text = batch.column(1)
                n, spans, items = table.value.scan(text)
                key = [hashlib.md5(x.as_buffer() if x.is_valid else b"").digest() for x in text]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array([[{"s": a, "e": b} for a, b in x] for x in spans], _span_type), pa.array(items, pa.list_(pa.string()))], ["id", "key", "n_words", "spans", "items"])

        passes.append(rows.mapInArrow(lean(search), f"id {kind}, key binary, n_words long, spans {SPANS}, items array<string>"))
    out = passes[0]
    if len(passes) > 1:
        more = passes[1]
        for p in passes[2:]:
            more = more.unionByName(p)
        hits = more.where(F.size("items") > 0).groupBy("id", "key").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
        out = out.join(hits, out["id"].eqNullSafe(hits["id"]) & (out["key"] == hits["key"]), "left").select(
            out["id"], "n_words", F.concat("spans", F.coalesce("more_spans", F.array().cast(SPANS))).alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>"))))).alias("items")
        )
        join = lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x)))
        out = out.withColumn("spans", F.aggregate(F.array_sort("spans"), F.array().cast(SPANS), join))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = LEAST_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which fewer than ``least`` items have windows; nothing is
    shuffled. An item lies in one block, so the counts of several blocks add up."""
    spark, count = docs.sparkSession, free_name(docs, "_items")
    out = docs.withColumn(count, F.lit(0))
    for block in _blocks(benchmark, block_words):
        table = spark.sparkContext.broadcast(Benchmark(block))

        def add(batches, table=table):
            for batch in chunked(batches, text_col):
                items = table.value.scan(batch.column(batch.schema.get_field_index(text_col)))[2]
                at = batch.schema.get_field_index(count)
                total = np.asarray(batch.column(at)) + np.array([len(x) for x in items])
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

        out = out.mapInArrow(lean(add), out.schema)
    return out.where(F.col(count) < least).drop(count)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= LEAST_ITEMS).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bp AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k
       FROM (SELECT item, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bp),
occ AS (SELECT rid, i, m, item
        FROM (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
              FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms)) JOIN bp USING (m, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {LEAST_ITEMS} AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
