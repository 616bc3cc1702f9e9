"""Substring dedup: a log-structured index of fingerprints.

A window is 50 consecutive words. Its fingerprint is the least hash among its 26 runs of 25
words, so windows of equal words have equal fingerprints, and neighbouring windows mostly
share one: a text has one fingerprint for some 13 windows. The index holds sorted immutable
runs of (fingerprint, document) rows, one run a batch, bucketed and sorted by fingerprint, so
that a new batch is merge-joined with old runs without moving them. Runs are listed by a
manifest in the index's folder (``runs``); an index opened again goes on from there.

A batch goes through these steps:

1. Each text is read once for its digest and fingerprints. Texts with the same words form
   one class, of which only the smallest id goes on: all windows of the others occur in it.
2. The fingerprints become a new run. Those that two documents share (within the run, or
   with an older run) are the candidates; nothing else can be repeated.
3. Verification by the words: of the documents that hold candidates, in this batch and in the
   history, each window with such a fingerprint is named by the 128-bit digest of its 50 words.
   Neighbouring windows of one fingerprint are a context; equal contexts are put together in
   each task. The smallest id of each digest is a minimum, made in part before its shuffle, and
   goes back to the contexts; windows with a smaller id than their own are removed. No step
   deals rows by fingerprint, and a digest meets one row of a task, however many documents of
   it hold the passage.
4. ``settle`` merges runs of like sizes.

Defined cases: null and empty texts have no words; texts of fewer than 50 words lose none;
repeated rows and rows with one id are never "smaller" than each other, so neither removes
the other's words; ids that are no integers are compared as texts; a null id counts as the
largest 64-bit integer, or as a text behind all others; other columns are ignored; an empty table gives an empty result. An index
with older runs needs the documents of those (``history``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.ids import ordered_id
from shapeloom.llm.runs import RunStore, halves
from shapeloom.llm.words import Words, chunked, windows
from shapeloom.shared import shared_path, stored, tidy

WINDOW = 50
GRAM = 25
#: Windows of one context row: bits of an int.
CONTEXT = 30
#: Contexts that a task holds before it hands them on.
HELD = 50_000
DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, span = x, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, first word) of all windows."""
    h = words.hashes()
    grams, gram_at = windows(h, words.first, GRAM, 1)
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    full = np.full(len(h), np.uint64(2**64 - 1))
    full[gram_at] = grams
    inside = np.ones(len(h) - WINDOW + 1, bool)
    for cut in np.unique(words.first[(words.first > 0) & (words.first < len(h))]):
        inside[max(0, cut - WINDOW + 1) : cut] = False
    at = np.flatnonzero(inside)
    return sliding_min(full, WINDOW - GRAM + 1)[at], at


def joined_words(text: pa.Scalar) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(text.as_buffer().to_pybytes().split()) if text.is_valid else b""


def profile(docs: DataFrame) -> DataFrame:
    """(d, id, text) -> (d, id, n_words, digest, prints): digest of the words joined by one
    space, distinct fingerprints."""
    d, kind = (docs.schema[c].dataType.simpleString() for c in ("d", "id"))

    def run(batches):
        for batch in chunked(batches):
            words = Words(batch.column(2))
            f, at = fingerprints(words)
            cut = np.searchsorted(at, words.first).tolist()
            prints = [np.unique(f[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32)
            digest = [hashlib.sha256(joined_words(x)).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first), pa.int64()), pa.array(digest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prints).view(np.int64)))],
                ["d", "id", "n_words", "digest", "prints"],
            )

    return docs.select("d", "id", "text").mapInArrow(run, f"d {d}, id {kind}, n_words long, digest string, prints array<long>")


class FingerprintIndex:
    """Runs of (f, d), each bucketed and sorted by f, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path, id_type
        self.store = RunStore(spark, path, f"f bigint, d {id_type}", "f", buckets)

    @property
    def runs(self) -> list[dict]:
        return self.store.runs

    def shared(self, new: DataFrame, old: list[dict]) -> DataFrame:
        """Fingerprints of the run ``new`` that another document holds, there or in an old run."""
        out = new.groupBy("f").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("f")
        for run in old:
            out = out.unionByName(new.join(self.store.table(run).hint("merge"), "f", "left_semi").select("f"))
        return out.distinct() if old else out


def contexts(texts: DataFrame) -> DataFrame:
    """(d, digest, text, fs) -> rows of (cid, w, least, most, entries): the name of a context, the
    digests of its windows, the smallest and largest d that hold it in the task, and where
    (d, digest, at: word)."""
    d = texts.schema["d"].dataType.simpleString()
    id_type = pa.string() if d == "string" else pa.int64()
    where = pa.struct([("d", id_type), ("digest", pa.string()), ("at", pa.int32())])

    def run(batches):
        held: dict[bytes, list] = {}

        def flush():
            ds = [[e["d"] for e in v] for v in held.values()]
            cid = [hashlib.blake2b(w, digest_size=DIGEST).digest() for w in held]
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(list(held), pa.binary()), pa.array([min(x) for x in ds], id_type), pa.array([max(x) for x in ds], id_type), pa.array(list(held.values()), pa.list_(where))], ["cid", "w", "least", "most", "entries"])

        for batch in chunked(batches):
            words = Words(batch.column(2))
            f, at = fingerprints(words)
            cut = np.searchsorted(at, words.first)
            length = words.ends - words.starts
            for i, (d, digest, fs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)):
                a, b = cut[i], cut[i + 1]
                own, wanted = f[a:b], np.sort(fs.values.to_numpy().view(np.uint64))
                hit = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                if not hit.any():
                    continue
                new = np.ones(b - a, bool)
                new[1:] = (own[1:] != own[:-1]) | (hit[1:] != hit[:-1])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], b - a)
                joined = joined_words(batch.column(2)[i])
                size = length[words.first[i] : words.first[i + 1]]
                begin = (np.cumsum(size + 1) - size - 1).tolist()
                begin.append(len(joined) + 1)
                for s, e in zip(start[hit[start]].tolist(), stop[hit[start]].tolist(), strict=True):
                    for k in range(s, e, CONTEXT):
                        w = b"".join([hashlib.blake2b(joined[begin[j] : begin[j + WINDOW] - 1], digest_size=DIGEST).digest() for j in range(k, min(e, k + CONTEXT))])
                        held.setdefault(w, []).append({"d": d, "digest": digest, "at": k})
            if len(held) >= HELD:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return texts.select("d", "digest", "text", "fs").mapInArrow(run, f"cid binary, w binary, least {d}, most {d}, entries array<struct<d:{d},digest:string,at:int>>")


def resolve(rows: DataFrame) -> DataFrame:
    """Rows of ``contexts`` -> (d, digest, at, bits): bit j is set if the window at word ``at`` +
    j also starts in a smaller document."""
    rows = stored(rows, "window-contexts")
    count = (F.length("w") / DIGEST).cast("int")
    each = F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.substring("w", j * DIGEST + 1, F.lit(DIGEST)).alias("k"), j.alias("j"))))
    # A context is met once here for each of its places in a task; equal ones ask the same.
    wins = rows.groupBy("cid").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("w").alias("w")).select("cid", "least", "most", each.alias("x")).select("cid", "least", "most", "x.k", "x.j")
    wins = stored(wins, "window-digests")
    first = wins.groupBy("k").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select("k", "a")
    marks = wins.join(first.hint("merge"), "k").where("a < most").groupBy("cid").agg(F.collect_list(F.struct("j", "a")).alias("marks"))
    found = rows.select("cid", "entries").join(marks.hint("merge"), "cid").select("marks", F.explode("entries").alias("e"))
    bits = F.aggregate("marks", F.lit(0).cast("long"), lambda acc, m: F.when(m["a"] < F.col("e.d"), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), m["j"]))).otherwise(acc))
    return found.select("e.d", "e.digest", "e.at", bits.alias("bits")).where("bits <> 0")


def cut_out(texts: DataFrame) -> DataFrame:
    """(d, digest, text, hits: array<struct<at, bits>>) -> (d, digest, n_removed, kept_sha256,
    spans)."""
    kind = texts.schema["d"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, hits in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.array([h["at"] for h in hits], np.int64)
                bits = np.array([h["bits"] for h in hits], np.int64)
                for j in range(CONTEXT):
                    s = at[(bits >> j) & 1 == 1] + j
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"s": int(a), "e": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()
                out.append((int(gone.sum()), kept, spans))
            if out:
                n, kept, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["d", "digest", "n_removed", "kept_sha256", "spans"])

    return texts.select("d", "digest", "text", "hits").mapInArrow(run, f"d {kind}, digest string, n_removed long, kept_sha256 string, spans array<struct<s:int,e:int>>")


@tidy
def substring_dedup(docs: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document of the batch: id, n_words, n_removed, kept_sha256, spans (of
    removed words). ``history`` has the documents of the index's earlier runs."""
    old = index.runs
    if old and history is None:
        raise ValueError("the index has older runs: their documents are needed to verify")
    own = lambda df: df.select(ordered_id(df, id_col).alias("d"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = own(docs)
    known = stored(profile(rows), "window-profiles")
    classes = known.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min("d").alias("d"), F.first("prints").alias("prints"))
    new = index.store.table(index.store.append(classes.select(F.explode("prints").alias("f"), "d")))
    shared = index.shared(new, old)
    held = new.join(shared.hint("merge"), "f")
    for run in old:
        held = held.unionByName(index.store.table(run).join(shared.hint("merge"), "f"))
    wanted = held.groupBy("d").agg(F.collect_set("f").alias("fs"))
    texts = rows.select("d", "text")
    if history is not None:
        texts = texts.unionByName(own(history).select("d", "text"))
    words = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ")  # as in ``profile``
    texts = stored(texts.where("text IS NOT NULL").join(wanted.hint("merge"), "d").select("d", F.sha2(words.cast("binary"), 256).alias("digest"), "text", "fs"), "window-texts")
    hits = resolve(contexts(texts)).groupBy("d", "digest").agg(F.collect_list(F.struct("at", "bits")).alias("hits"))
    cut = cut_out(texts.select("d", "digest", "text").join(hits.hint("merge"), ["d", "digest"])).dropDuplicates(["d", "digest"])
    # Stored, so that the join below has two shuffles and Spark can split a text of many copies.
    first = stored(known.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min("d").alias("first")), "window-firsts", small=True)
    out = known.drop("prints").join(first.hint("merge"), "digest", "left").join(cut.hint("merge"), ["d", "digest"], "left")
    copy = F.col("d") > F.col("first")
    index.store.settle()
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, EMPTY).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>"))).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches by ascending id, the second against the index of the first,
    opened again from its folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path, out, seen = shared_path(spark, "window-index"), None, None
    for batch in halves(docs):
        found = substring_dedup(batch, FingerprintIndex(spark, path), seen)
        out = found if out is None else out.unionByName(found)
        seen = batch if seen is None else seen.unionByName(batch)
    FingerprintIndex(spark, path).store.drop()
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
gone AS (SELECT DISTINCT rid, p FROM (
         SELECT rid, unnest(range(i, i + {WINDOW})) AS p
         FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m)),
ws AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM ws ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
