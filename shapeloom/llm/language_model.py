"""LM scoring with a log-frequency Bloom filter.

All training n-grams (words and pairs of words, with a start and an end) are counted over
the whole corpus. N-grams are dealt to buckets by the first bits of their hash; a task sends
each bucket its distinct n-grams in order, as packed differences, with their counts. One bucket
makes one page of the filter: an n-gram of count c is entered at the levels 1 .. 1 + floor(log2 c),
and the page has ``BITS_PER_ENTRY`` bits for each entry, so the filter grows with the corpus
and no n-gram or level is left out. A count is read back by probing level after level until one
is missing, which gives the count's power of two; its estimate is the middle of that range.

A filter that grows with the corpus has no bound that would let it be broadcast, so its pages
are sent to workers one by one, and each chunk of documents sends its distinct n-grams to their
pages. The levels found there, and the exact counts of the words for the base score, come back
to the chunk. This is the one way at every size.

Probability of a word after another, with Dirichlet smoothing:
(c(h w) + MU p(w)) / (c(h) + MU), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

Words are known by 64-bit hashes of their bytes (``words``), pairs by 48 bits and those of their
bucket, which is far rarer to fail than the filter's own probes.

Defined cases: a null or empty text has the end only; a null id is never held out; repeated
rows each count and each have their row; with no training rows all counts, N and V are 0;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.words import BLANK, Words, chunked, mix
from shapeloom.shared import stored, tidy

BITS_PER_ENTRY = 10
PROBES = 3
#: Buckets for each shuffle partition, at least.
SPREAD = 4
#: Bytes of text of a chunk, and packed rows that Python is handed at once.
CHUNK = 4 << 20
BATCH = 256
MU = 100.0
HELD_OUT_OF = 10
#: Entries of a task's partial counts before they are handed on.
PARTIAL = 1 << 20
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text's words followed by the end; first token of each
    text (with one entry more)."""
    words = Words(text, BLANK, lower=True)
    h = words.hashes()
    first = words.first + np.arange(len(words.first))
    out = np.empty(len(h) + len(text), np.uint64)
    ends = first[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = h, mix(np.array([END]))[0]
    return out, first


def pairs(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token and the one before it in its text (or the start)."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[first[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + (t ^ np.uint64(0x2545F4914F6CDD1D)))


def bucket_of(x: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of the hash."""
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def cuts(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes, the buckets and where each begins (with one entry more)."""
    bucket = bucket_of(x, bits)
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[start], np.append(start, len(x))


class Page:
    """One bucket's part of the filter, ``size`` bits."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def places(self, x: np.ndarray, level: int) -> list[np.ndarray]:
        y = mix(x ^ np.uint64((0xD1B54A32D192ED03 * level) & (2**64 - 1)))
        step = mix(y) | np.uint64(1)
        return [((y + np.uint64(i) * step) % np.uint64(self.size)).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def of(cls, x: np.ndarray, count: np.ndarray) -> Page:
        """The page with these n-grams, which all have been seen."""
        level = levels_of(count)
        size = max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 8) * 8)
        page = cls(np.zeros(-(-size // 8), np.uint8), size)
        for k in range(1, int(level.max(initial=0)) + 1):
            for at in page.places(x[level >= k], k):
                np.bitwise_or.at(page.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return page

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The number of levels at which each n-gram is found."""
        out, live = np.zeros(len(x), np.uint8), np.arange(len(x))
        for level in range(1, 64):
            hit = np.ones(len(live), bool)
            for at in self.places(x[live], level):
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            out[live] = level
        return out


def levels_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) of counts from 1 on."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def counts_of(level: np.ndarray) -> np.ndarray:
    """Estimated counts: the middle of 2^(l-1) .. 2^l - 1."""
    return np.where(level > 0, (1.5 * 2.0 ** np.maximum(level.astype(np.int64) - 1, 0) - 0.5), 0.0)


def packed(x: np.ndarray, width: int) -> bytes:
    """Ascending numbers as the last ``width`` bytes of their differences, all first bytes
    first: most of the upper bytes are 0 and leave little for the shuffle."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def spread(data: bytes, width: int) -> np.ndarray:
    d = np.zeros((len(data) // width, 8), np.uint8)
    d[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=np.uint64)


def short_pairs(x: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of pairs after those of their bucket."""
    return (x << np.uint64(bits)) >> np.uint64(16)


def small_counts(c: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest one needs; the number of them tells how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(c.max(initial=0)) <= np.iinfo(k).max)
    return c.astype(kind).tobytes()


def large_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def bucket_rows(words: np.ndarray, wc: np.ndarray | None, two: np.ndarray, pc: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """(bucket, words, wc, pairs, pc) of ascending n-grams and their counts, if any."""
    wb, ws = cuts(words, bits)
    pb, ps = cuts(two, bits)
    w_at, p_at = dict(zip(wb.tolist(), range(len(wb)), strict=True)), dict(zip(pb.tolist(), range(len(pb)), strict=True))
    rows = []
    for b in sorted(w_at.keys() | p_at.keys()):
        i, j = w_at.get(b), p_at.get(b)
        w = slice(ws[i], ws[i + 1]) if i is not None else slice(0, 0)
        p = slice(ps[j], ps[j + 1]) if j is not None else slice(0, 0)
        rows.append((b, packed(words[w], 8), b"" if wc is None else small_counts(wc[w]), packed(short_pairs(two[p], bits), 6), b"" if pc is None else small_counts(pc[p])))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "words", "wc", "pairs", "pc"])


def partial_counts(texts: DataFrame, bits: int) -> DataFrame:
    """The counts of all n-grams of the column ``text``, in part, by bucket."""

    def count(batches):
        held: tuple[list, list] = ([], [])
        size = 0

        def flush():
            out = []
            for rows in held:
                x, c = (np.concatenate(z) for z in zip(*rows, strict=True))
                u, at = np.unique(x, return_inverse=True)
                out += [u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)]
            return bucket_rows(*out, bits)

        for batch in chunked(batches):
            t, first = tokens(batch.column(0))
            for rows, x in zip(held, (t, pairs(t, first)), strict=True):
                u, c = np.unique(x, return_counts=True)
                rows.append((u, c))
                size += len(u)
            if size >= PARTIAL:
                yield flush()
                held, size = ([], []), 0
        if size:
            yield flush()

    return texts.mapInArrow(count, "bucket int, words binary, wc binary, pairs binary, pc binary")


def summed(packs: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending n-grams and their counts over all (n-grams, counts) packs."""
    xs = [spread(x, width) for x, _ in packs]
    cs = [large_counts(c, len(x)) for x, (_, c) in zip(xs, packs, strict=True)]
    u, at = np.unique(np.concatenate(xs), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(cs), minlength=len(u)).astype(np.int64)


def by_bucket(batches):
    """(bucket, its rows) of batches that are sorted by their first column."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def build_model(train: DataFrame, bits: int) -> DataFrame:
    """(bucket, words, wc, size, page, tokens) for the column ``text`` of ``train``: the exact counts of
    the bucket's words, and its page of the filter with words and pairs."""

    def build(batches):
        for bucket, rows in by_bucket(batches):
            words, wc = summed([r[0:2] for r in rows], 8)
            two, pc = summed([r[2:4] for r in rows], 6)
            page = Page.of(np.concatenate([words, ~two]), np.concatenate([wc, pc]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([packed(words, 8)], pa.binary()), pa.array([small_counts(wc)], pa.binary()), pa.array([page.size], pa.int64()), pa.array([page.bits.tobytes()], pa.binary()), pa.array([int(wc.sum())], pa.int64()), pa.array([len(words)], pa.int64())],
                ["bucket", "words", "wc", "size", "page", "tokens", "distinct"],
            )

    dealt = partial_counts(train.select("text"), bits).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(build, "bucket int, words binary, wc binary, size long, page binary, tokens long, distinct long")


@contextmanager
def small_batches(spark: SparkSession):
    """What is run inside hands Python at most ``BATCH`` rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Grams:
    """The n-grams of a chunk of texts: of each token, the place of its word in ``words`` and
    of its pair in ``pairs``, which both ascend."""

    def __init__(self, text: pa.Array):
        t, self.first = tokens(text)
        self.words, self.at = np.unique(t, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pairs(t, self.first), return_inverse=True)


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def in_chunks(rows: DataFrame) -> DataFrame:
    """(id, text) -> (chunk, docs): Arrow batches under numbers of their own."""

    def pack(batches):
        for batch in chunked(batches, limit=CHUNK):
            chunk = int.from_bytes(os.urandom(8), "little", signed=True)  # kept, as the chunks are stored
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([to_bytes(batch)], pa.binary())], ["chunk", "docs"])

    return rows.mapInArrow(pack, "chunk long, docs binary")


def answers(chunks: DataFrame, model: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, counts, word_levels, pair_levels): of each chunk's n-grams in a bucket the
    exact counts of words and the levels of words and pairs."""

    def ask(batches):
        for batch in batches:
            for chunk, docs in zip(*batch.columns, strict=True):
                grams = Grams(from_bytes(docs.as_py()).column(1))
                rows = bucket_rows(grams.words, None, grams.pairs, None, bits)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([chunk.as_py()] * rows.num_rows, pa.int64()), rows.column(1), rows.column(3)], ["bucket", "chunk", "words", "pairs"])

    asked = chunks.select("chunk", "docs").mapInArrow(ask, "bucket int, chunk long, words binary, pairs binary")
    none = F.lit(None)
    asked = asked.select("bucket", "chunk", "words", "pairs", none.cast("binary").alias("wc"), none.cast("long").alias("size"))
    held = model.select("bucket", none.cast("long").alias("chunk"), "words", F.col("page").alias("pairs"), "wc", "size")
    met = held.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())  # a page, then what asks for it

    def probe(batches):
        now, page = None, None
        for batch in batches:
            out = []
            for bucket, chunk, words, two, wc, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, page, known, counts = bucket, None, np.empty(0, np.uint64), np.empty(0, np.int64)
                if chunk is None:
                    page, known = Page(np.frombuffer(two, np.uint8), size), spread(words, 8)
                    counts = large_counts(wc, len(known))
                    continue
                w, p = spread(words, 8), spread(two, 6)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                c = np.where(known[at] == w, counts[at], 0) if len(known) else np.zeros(len(w), np.int64)
                levels = page.levels(np.concatenate([w, ~p])) if page else np.zeros(len(w) + len(p), np.uint8)
                out.append((chunk, bucket, c.astype("<i8").tobytes(), levels[: len(w)].tobytes(), levels[len(w) :].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["chunk", "bucket", "counts", "word_levels", "pair_levels"])

    return met.mapInArrow(probe, "chunk long, bucket int, counts binary, word_levels binary, pair_levels binary")


@tidy
def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``,
    learning from the rows of ``train``."""
    spark = docs.sparkSession
    bits = max(1, (SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    with small_batches(spark):
        model = stored(build_model(train.select(F.col(text_col).alias("text")), bits), "lm-model")
    total, distinct = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    norm = total + 0.1 * (distinct + 1)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches):
        end = mix(np.array([END]))[0]
        for batch in batches:
            for docs, found in zip(*batch.columns, strict=True):
                docs, found = from_bytes(docs.as_py()), found.as_py()
                grams = Grams(docs.column(1))
                at, first = grams.at, grams.first
                lengths = np.diff(first)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                exact, word_level, pair_level = (np.frombuffer(b"".join(f[k] for f in found), t) for k, t in (("counts", "<i8"), ("word_levels", np.uint8), ("pair_levels", np.uint8)))
                of_word, of_pair = counts_of(word_level), counts_of(pair_level)
                p1 = (of_word + 0.1) / norm
                before = np.empty(len(at), np.float64)
                before[1:] = of_word[at][:-1]
                before[first[:-1]] = of_word[np.searchsorted(grams.words, end)]  # texts begin as often as they end
                both = np.minimum(of_pair[grams.pair_at], before)
                log_p = np.log10(np.minimum(1.0, (both + MU * p1[at]) / (before + MU)))
                base = np.log10((exact + 0.1) / norm)
                add = lambda x, doc=doc, n=len(lengths): np.bincount(doc, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [docs.column(0), pa.array(lengths, pa.int64()), pa.array(add(exact[at] > 0).astype(np.int64)), pa.array(np.full(len(lengths), total), pa.int64()), pa.array(add(base[at])), pa.array(add(log_p))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    chunks = stored(in_chunks(rows), "lm-chunks")
    with small_batches(spark):
        found = stored(answers(chunks, model, bits), "lm-answers")
        found = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "word_levels", "pair_levels"))).alias("found"))
        joined = chunks.join(found.hint("merge"), "chunk").select("docs", "found")
        scored = stored(joined.mapInArrow(score, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    return scored.withColumnRenamed("id", id_col)


def held_out(id_col, of: int, remainder: int):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % of == remainder, F.lit(False))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"), HELD_OUT_OF, 0)
    out = score_texts(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
