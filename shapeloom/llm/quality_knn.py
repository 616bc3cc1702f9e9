"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms: its words and their first and last three bytes, and in a
part of their own the shapes of its words (letters, capitals and digits as classes, other bytes
as they are, runs taken together), neighbouring shapes, and marks for a word that repeats the
one or two before it. Counts are damped, weighted by rarity and reduced by a truncated SVD,
which puts terms that occur in the same texts together. The labelled vectors are broadcast,
each document's cosine with every one of them is computed in blocks, and the ``NEIGHBOURS``
nearest vote with weights that grow with the similarity.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id: the bound on what is collected (``SAMPLE`` vectors of term counts, 16 MB) and
broadcast (``SAMPLE`` rows of ``RANK`` floats, 1 MB). All documents are scored on their whole
texts. Labels, language, source and ids are no inputs of a score.

Defined cases: null and empty texts, and texts without any known term, get the share of
label 1 in the sample; a document labelled several times counts with each label; of documents
with one id one is learnt from; without labelled rows every score is 0.5; null ids and repeated
rows are scored like others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.language_model import held_out
from shapeloom.llm.lean import lean
from shapeloom.llm.words import BLANK, Words, chunked, mix, owner, text_bytes

#: Terms of shapes, and of words and subwords; how much the latter weigh beside the former.
SHAPES, WORDS = 1024, 1024
TERMS = SHAPES + WORDS
WORD_WEIGHT = 0.5
#: Rows whose terms are held at once.
SLICE = 1024
RANK = 64
SAMPLE = 4000
NEIGHBOURS = 32
THRESHOLD = 0.7

#: Byte classes: a letter or any byte of a non-ASCII character, a capital, a digit.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B] = SHAPE[0x80:] = ord("x")
SHAPE[0x41:0x5B] = ord("X")
SHAPE[0x30:0x3A] = ord("9")
SHAPE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def features(text: pa.Array) -> np.ndarray:
    """(rows, TERMS) damped term shares, 32-bit floats: shapes, then words."""
    n = len(text)
    data, offsets = text_bytes(text)
    shapes = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shapes[1:] != shapes[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    short = Words((shapes[keep], kept[offsets]), BLANK)
    words = Words((data, offsets), BLANK, lower=True)
    doc = owner(np.arange(len(short)), short.first)
    n_words = np.maximum(np.diff(short.first), 1)[:, None].astype(np.float32)

    def damped(terms: list[np.ndarray], docs: list[np.ndarray], size: int) -> np.ndarray:
        at = (mix(np.concatenate(terms)) % np.uint64(size)).astype(np.int64)
        counts = np.bincount(np.concatenate(docs) * size + at, minlength=n * size).reshape(n, size).astype(np.float32)
        return np.log1p(100 * counts / n_words)

    s = short.hashes()
    same = doc[1:] == doc[:-1]
    terms, docs = [s, (s[1:] * np.uint64(3) + s[:-1] + np.uint64(7))[same]], [doc, doc[1:][same]]
    h, of = words.hashes(), owner(np.arange(len(words)), words.first)
    for back in (1, 2):
        again = of[back:][(h[back:] == h[:-back]) & (of[back:] == of[:-back])]
        for k in range(4):  # a mark is some terms, so that it weighs more than one shape
            terms.append(np.full(len(again), 1000 * back + k, np.uint64))
            docs.append(again)
    shown = damped(terms, docs, SHAPES)
    long = np.flatnonzero(words.ends - words.starts > 3)
    terms, docs = [h], [of]
    for edge, at in ((1, words.starts[long]), (2, words.ends[long] - 3)):
        part = words.data[at[:, None] + np.arange(3)].astype(np.uint64)
        terms.append(part @ np.array([1, 1 << 8, 1 << 16], np.uint64) + np.uint64(edge << 32))
        docs.append(of[long])
    return np.concatenate([shown, np.float32(WORD_WEIGHT) * damped(terms, docs, WORDS)], axis=1)


def leading(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a
    fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T


class NeighbourVote:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        if not len(y):
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = unit(x * self.idf)
        self.basis = leading(x, RANK)
        self.labelled = unit(x @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), self.prior)
        z = unit(unit(x * self.idf) @ self.basis)
        out = np.empty(len(z))
        k = min(NEIGHBOURS, len(self.y))
        for at in range(0, len(z), 256):  # blocks bound the products held at once
            sim = z[at : at + 256] @ self.labelled.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64) ** 8
            votes = (w * self.y[near]).sum(1)
            out[at : at + 256] = np.where(w.sum(1) > 1e-12, votes / np.maximum(w.sum(1), 1e-12), self.prior)
        out[~x.any(axis=1)] = self.prior
        return np.clip(out, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> NeighbourVote:
    """Learns from at most ``sample`` of the rows of ``labels``."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    chosen = chosen.orderBy(F.xxhash64(F.col("id").cast("string")), "id", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` rows at most
    kind = rows.schema["id"].dataType.simpleString()

    def vectors(batches):
        for batch in chunked(batches, rows=SLICE):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary()), batch.column(2)], ["id", "v", "y"])

    got = rows.select("id", "text", "y").mapInArrow(lean(vectors), f"id {kind}, v binary, y int").groupBy("id", "y").agg(F.min("v").alias("v")).orderBy("id", "y").toArrow()
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    return NeighbourVote(x, np.asarray(got["y"].to_pylist(), np.float32))


def score_quality(docs: DataFrame, model: NeighbourVote, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column: how likely label 1 is."""
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {score_col!r} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(score_col, F.lit(0.0))
    place = out.columns.index(score_col)

    def score(batches):
        for batch in chunked(batches, text_col, rows=SLICE):
            s = shared.value.score(features(batch.column(batch.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([pa.array(s) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return out.mapInArrow(lean(score), out.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
