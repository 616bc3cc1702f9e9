"""Queries against their SQL at the smallest size, and against brute force where there is none."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shapeloom.llm import registry
from tests.conftest import DATA

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same, name):
    same(registry.queries()[name], SQL[name])


@pytest.fixture(scope="module")
def docs(spark, duck):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from shapeloom.llm.token_files import op6_token_files

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in op6_token_files(spark, DATA).collect()}
    at = 0
    for doc, text in sorted(docs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    from shapeloom.llm.sentencepiece_fst import op10_sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in op10_sentencepiece(spark, DATA).collect()}
    for doc, text in docs:
        ids = np.array(lib.encode(text), "<u4")
        assert (got[doc].n_tokens, got[doc].ids_crc32, got[doc].lossless) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_lm_base_scores(spark, docs):
    from shapeloom.llm.language_model import held_out, score_texts

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)), None]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    counts = Counter(x for d, t in docs if not held[d] for x in tokens(t))
    total = sum(counts.values())
    norm = total + 0.1 * (len(counts) + 1)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    better = 0.0
    got = {r.doc_id: r for r in score_texts(table, table.where(~held_out(table.doc_id, 10, 0))).collect()}
    for d, t in docs:
        ts = tokens(t)
        assert got[d].n_tokens == len(ts) and got[d].train_tokens == total
        assert got[d].n_known == sum(counts[x] > 0 for x in ts)
        assert math.isclose(got[d].base_score, sum(math.log10((counts[x] + 0.1) / norm) for x in ts), rel_tol=1e-9)
        assert got[d].score <= 0
        better += (got[d].score - got[d].base_score) * held[d]
    assert better > 0  # the model of pairs is better on held-out texts


def test_quality_is_learnt(spark, duck):
    from shapeloom.llm.quality_knn import op7_quality

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op7_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert sum(p for p, q in held if q) / sum(q for _, q in held) > 0.97  # clean documents stay
