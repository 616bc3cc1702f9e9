"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.shared import shared_path

LONG = "alpha beta gamma " * 20_000
ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, LONG), (5, "one"), (5, "one"), (None, "no id"), (6, "One  two\x0bthree"), (7, "日本 語 😀 " * 30)]
CLASH = ("d", "id", "c", "n", "key", "w", "f", "t", "_g", "batch", "blob", "words", "prints", "_items", "_d", "_h")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def run(name, df, spark):
    """The operator's result rows as sorted texts."""
    import public_tokenizers

    from shapeloom.llm import chat_format, decontaminate, exact_dedup, jaccard_join, language_model, quality_knn, secret_scan, sentencepiece_fst, substring_dedup, token_files

    bench = spark.createDataFrame([(1, "alpha beta gamma alpha beta gamma alpha beta"), (2, "two three"), (3, None), (None, "x"), (2, "two three")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (4, 0), (7, 1), (None, 1), (2, None)], "doc_id long, quality int")
    if name == "secret_scan":
        out = secret_scan.secret_scan(df, secret_scan.BlobLedger(spark, shared_path(spark, "ledger")))
    elif name == "substring_dedup":
        out = substring_dedup.substring_dedup(df, substring_dedup.FingerprintIndex(spark, shared_path(spark, "w")))
    elif name == "chat_format":
        rows = df.withColumn("parts", chat_format.text_part(F.col("text"))).withColumns({"turn": F.col("doc_id"), "role": F.lit("assistant")})
        out = chat_format.read_back(chat_format.format_chats(rows, conv="doc_id"), "doc_id")
    elif name == "exact_dedup":
        out = exact_dedup.exact_dedup(df, exact_dedup.DigestIndex(spark, shared_path(spark, "i")))
    elif name == "decontaminate":
        out = decontaminate.decontaminate(df, bench)
    elif name == "token_files":
        root = shared_path(spark, "tokens")
        out = token_files.read_token_files(token_files.write_token_files(df, root, public_tokenizers.path("word_bpe_49k.json")), root)
    elif name == "quality_knn":
        out = quality_knn.score_quality(df, quality_knn.fit(df, labels)).select("doc_id", F.round("score", 6).alias("score"))
    elif name == "language_model":
        out = language_model.score_texts(df, df).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base"), F.round("score", 6).alias("score"))
    elif name == "jaccard_join":
        out = jaccard_join.similar_components(df)
    else:
        out = sentencepiece_fst.digests(df, public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(map(str, out.collect()))


NAMES = ("secret_scan", "substring_dedup", "chat_format", "exact_dedup", "decontaminate", "token_files", "quality_knn", "language_model", "jaccard_join", "sentencepiece")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, odd, name):
    rows = run(name, odd, spark)
    groups = len({d for d, _ in ODD}) if name == "chat_format" else len(ODD)
    assert len(rows) == groups
    extra = clashing(odd).withColumnRenamed("t", "T2") if name == "chat_format" else clashing(odd)
    assert run(name, extra, spark) == rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert run(name, empty, spark) == []


# Secret scans.


def test_spans(spark):
    from shapeloom.llm.secret_scan import BlobLedger, secret_scan

    texts = ["é password = 'abcdefghijkl' x", "token=short token: AAAABBBBCCCCD", "AKIA0123456789ABCD AKIA0", "0123456789abcdef0 deadbeef", "Api_Key:aaaaaaaaaaaa0123456789abcdef", "secret=token=abcdefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = BlobLedger(spark, shared_path(spark, "ledger"))
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secret_scan(df, ledger).collect()}
    for i, text in enumerate(texts):
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        assert got[i] == sorted(want, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
    # A second pass, over a ledger opened again, scans only blobs that are new.
    more = spark.createDataFrame([(10, texts[0]), (11, "new AKIA0123456789ABCD")], "doc_id long, text string")
    ledger = BlobLedger(spark, ledger.store.path)
    again = {r.doc_id: len(r.findings) for r in secret_scan(more, ledger).collect()}
    assert again == {10: 1, 11: 1}
    assert [r["rows"] for r in ledger.store.runs] == [len(texts), 1]


def test_a_changed_rule_scans_its_own_pairs_only(spark):
    from dataclasses import replace

    from shapeloom.llm.secret_scan import RULES, BlobLedger, secret_scan

    df = spark.createDataFrame([(1, "0123456789abcdef AKIA0123456789ABCD", "a.txt"), (2, "0123456789abcdef AKIA0123456789ABCD", "b.txt"), (3, "none", "c.txt")], "doc_id long, text string, file string")
    path = shared_path(spark, "ledger")
    first = {r.file: [f.kind for f in r.findings] for r in secret_scan(df, BlobLedger(spark, path), paths=("file",)).collect()}
    assert first == {"a.txt": ["hex", "access"], "b.txt": ["hex", "access"], "c.txt": []}
    changed = (*RULES[:2], replace(RULES[2], least=20, hint="[0-9a-f]{20}"))
    second = {r.doc_id: [f.kind for f in r.findings] for r in secret_scan(df, BlobLedger(spark, path), rules=changed).collect()}
    assert second == {1: ["access"], 2: ["access"], 3: []}
    ledger = BlobLedger(spark, path)
    rows = ledger.store.read().collect()
    assert sorted(len(r.rules) for r in rows) == [1, 1, 3, 3]
    secret_scan(df, ledger, rules=changed)
    assert BlobLedger(spark, path).store.read().count() == 4  # nothing was left to scan
    assert {r.doc_id: len(r.findings) for r in secret_scan(df, BlobLedger(spark, path)).collect()} == {1: 2, 2: 2, 3: 0}


def test_a_text_of_many_spans(spark):
    from shapeloom.llm.secret_scan import BlobLedger, secret_scan

    n = 600_000  # 10 MB
    df = spark.createDataFrame([(1, "0123456789abcdef " * n)], "doc_id long, text string")
    start = time.time()
    got = secret_scan(df, BlobLedger(spark, shared_path(spark, "ledger"))).select(F.size("findings").alias("n"), F.element_at("findings", -1).alias("last")).first()
    assert (got.n, got["last"].start, got["last"].end) == (n, 17 * (n - 1), 17 * n - 1)
    assert time.time() - start < 60


# Substring dedup.


def brute_windows(rows, size=50):
    first = {}
    for d, t in sorted(rows):
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    shared = [[word() for _ in range(rng.choice([40, 49, 50, 51, 80, 200]))] for _ in range(6)] + [["same"] * 120, ["a", "b"] * 60]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(60))]
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 3)
            w += p[a : len(p) - rng.randrange(len(p) // 3)]
        rows.append((d, " ".join(w)))
    rows += [(n + i, rows[i][1]) for i in range(5)]  # whole copies
    rng.shuffle(rows)
    return rows


def test_windows_against_brute_force(spark):
    from shapeloom.llm.substring_dedup import FingerprintIndex, substring_dedup

    rows = passages(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, FingerprintIndex(spark, shared_path(spark, "w"))).collect()}
    assert got == brute_windows(rows)
    assert sum(n for _, n, _ in got.values()) > 500


def test_windows_by_batches(spark):
    from shapeloom.llm.substring_dedup import FingerprintIndex, substring_dedup

    rows = sorted(passages(4))
    path = shared_path(spark, "w")
    got, seen, runs = {}, None, []
    for part in (rows[:40], rows[40:50], rows[50:]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        index = FingerprintIndex(spark, path)  # opened again for each batch
        if seen is not None:
            with pytest.raises(ValueError, match="older runs"):
                substring_dedup(df, index)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, index, seen).collect()}
        seen = df if seen is None else seen.unionByName(df)
        runs.append(len(index.runs))
    assert got == brute_windows(rows)
    assert runs == [1, 2, 2]  # the last two runs are of like size, so they were merged


def thue_morse():
    """Two words of 1,024 letters that every polynomial hash modulo 2^64 confuses."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_build(spark):
    from shapeloom.llm.jaccard_join import similar_components
    from shapeloom.llm.substring_dedup import FingerprintIndex, substring_dedup
    from shapeloom.llm.words import Words

    import pyarrow as pa

    one, other = thue_morse()
    for salt in range(4):
        a, b = Words(pa.array([f"{one} {other}"])).hashes(salt)
        assert a != b
    words = [f"w{i}" for i in range(49)]
    df = spark.createDataFrame([(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, one), (4, other), (5, " ".join([*words, one]))], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup(df, FingerprintIndex(spark, shared_path(spark, "w"))).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 50}
    found = {r.doc_id: r.component_id for r in similar_components(df).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}  # 45 of 47 shingles of documents 1 and 2 are shared


def test_ids_of_other_types(spark):
    from shapeloom.llm.jaccard_join import similar_components
    from shapeloom.llm.substring_dedup import FingerprintIndex, substring_dedup

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", text), ("a", text + " x"), (None, text), ("c", "y")], "doc_id string, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup(df, FingerprintIndex(spark, shared_path(spark, "w"), "string")).collect()}
    assert removed == {"a": 0, "b": 60, None: 60, "c": 0}
    assert {r.doc_id: r.component_id for r in similar_components(df).collect()} == {"a": "a", "b": "a", None: "a", "c": "c"}


def test_runs_are_merged_by_size(spark):
    from shapeloom.llm.runs import RunStore

    path = shared_path(spark, "runs")
    for n in (100, 10, 1):
        RunStore(spark, path, "k long, v string", "k", 3).append(spark.range(n).selectExpr("id AS k", "'x' AS v"))
    store = RunStore(spark, path, "k long, v string", "k")
    assert [r["rows"] for r in store.runs] == [100, 10, 1] and store.buckets == 3
    store.append(spark.range(6).selectExpr("id AS k", "'y' AS v"))
    store.settle()
    assert [r["rows"] for r in store.runs] == [100, 17]
    assert store.read().count() == 117
    plan = store.table(store.runs[0]).join(store.table(store.runs[1]).hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.drop()
    assert RunStore(spark, path, "k long, v string", "k").runs == []


# Chat formatting.


def test_parts_and_escapes(spark):
    from shapeloom.llm.chat_format import EXPANSION, PARTS, format_chats, read_back

    tricky = ["</s>", "<\\/s>", "<\\\\/s> [INST", "[\\/INST] <image>", "<", "[", "s>", "\\", "", "line\nbreak </s>[INST] ok [/INST]"]
    turns = [(1, i, role, [("text", t, None, 0)]) for i, (role, t) in enumerate(zip(["user", "assistant"] * 5, tricky, strict=True))]
    turns += [(2, 0, "user", [("text", "see <image> ", None, 0), ("image", None, "s3://a", 2), ("audio", None, "s3://b", None), ("text", " end", None, 0)]), (2, 1, "assistant", [("document", None, "s3://c", 3), ("text", "yes", None, 0)]), (3, 0, "[INST]</s>", None)]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {PARTS}")
    out = format_chats(df)
    rows = {r.conv_id: r for r in out.collect()}
    back = {r.conv_id: r for r in read_back(out).collect()}
    assert [t.text for t in back[1].turns] == tricky and [t.role for t in back[1].turns] == ["user", "assistant"] * 5
    assert back[1].loss_texts == tricky[1::2]
    two = rows[2]
    assert [(a.kind, a.uri, a.tokens) for a in two.attachments] == [("image", "s3://a", 2 * EXPANSION["image"]), ("audio", "s3://b", EXPANSION["audio"]), ("document", "s3://c", 3 * EXPANSION["document"])]
    assert all(two.formatted[a.at :].startswith(f"<{a.kind}>") for a in two.attachments)
    assert two.attachment_tokens == sum(a.tokens for a in two.attachments)
    assert [two.formatted[s.start : s.end] for s in two.loss] == ["<document>yes"]
    assert "<\\image>" in two.formatted  # the text's own placeholder is no attachment
    assert [(t.role, t.text) for t in back[3].turns] == [("[INST]</s>", "")]


# Exact dedup.


def test_index_over_batches(spark):
    from shapeloom.llm.exact_dedup import DigestIndex, exact_dedup

    path = shared_path(spark, "digests")
    one = spark.createDataFrame([(1, "a  b"), (2, "a\nb"), (3, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "a b"), (5, "d"), (6, "d")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for df in (one, two) for r in sorted(exact_dedup(df, DigestIndex(spark, path)).collect())]
    assert rows == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 1, 1, False), (5, 5, 2, True), (6, 5, 2, False)]
    assert DigestIndex(spark, path).read().count() == 3
    index = DigestIndex(spark, shared_path(spark, "digests"))
    both = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(exact_dedup([one, two], index).collect())]
    assert both == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 1, 3, False), (5, 5, 2, True), (6, 5, 2, False)]


# Decontamination.


def test_blocks_of_items_and_short_items(spark):
    from shapeloom.llm.decontaminate import decontaminate, keep_clean

    rng = random.Random(5)
    word = lambda: rng.choice(["red", "Blue", "green", "x1", "é", "日本"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 20])))) for i in range(40)]
    docs = [(i, " - ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 700])))) for i in range(60)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = {}
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for i, x in items:
            p = low(x)
            m = min(8, len(p))
            for k in range(len(p) - m + 1):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[k : k + m]:
                        hit |= set(range(j, j + m))
                        found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 30):
        got = {r.doc_id: (r.n_words, sum(s.e - s.s for s in r.spans), sorted(r["items"])) for r in decontaminate(df, bench, block_words=block).collect()}
        assert got == want
        assert sorted(r.doc_id for r in keep_clean(clashing(df), bench, block_words=block).collect()) == sorted(d for d in want if len(want[d][2]) < 2)


# Token files.


def test_random_access(spark):
    import public_tokenizers

    from shapeloom.llm.token_files import LENGTH, Encoder, TokenFile, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["word " * 400_000, "", "a b", "x " * 2000]
    root = shared_path(spark, "tokens")
    manifest = write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), root, path, shards=1).collect()
    import pyarrow as pa

    want = np.concatenate([np.append(x, 1) for x in Encoder(path).encode(pa.array(texts))])
    f = TokenFile(root, 0)
    assert manifest[0].n_tokens == len(want)
    for k in (0, 300, len(want) // LENGTH):
        ids, mask = f.sequence(k)
        assert ids[mask].tolist() == want[k * LENGTH : (k + 1) * LENGTH].tolist()
    assert f.tokens(399_990, 100).tolist() == want[399_990:400_090].tolist()


def test_encoder_equals_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from shapeloom.llm.token_files import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    alphabet = "abcDEF ¤\n\t'.,!?0123 éÉǺẞß😀日\x1d\x00ÿÀ×÷<|>_^Σσς"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|> a", "it's, don't.", "A.B, c"]) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(path)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    assert [x.tolist() for t in texts for x in encoder.encode(pa.array([t]))] == want


# Language model.


def test_filter_counts():
    from shapeloom.llm.language_model import Page, counts_of, levels_of, mix

    x = mix(np.arange(1, 20_001, dtype=np.uint64))
    c = np.random.default_rng(7).integers(1, 300, len(x))
    page = Page.of(x, c)
    level = levels_of(c)
    assert level.tolist() == [int(k).bit_length() for k in c]
    assert (page.levels(x) >= level).all()  # a Bloom filter errs upwards only
    assert (page.levels(x) == level).mean() > 0.9
    assert (counts_of(page.levels(mix(np.arange(10**6, 10**6 + 10_000, dtype=np.uint64)))) > 0).mean() < 0.1


def test_packs():
    from shapeloom.llm.language_model import large_counts, packed, small_counts, spread

    x = np.sort(np.random.default_rng(3).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (spread(packed(x, 8), 8) == x).all()
    y = np.sort(x >> np.uint64(16))
    assert (spread(packed(y, 6), 6) == y).all()
    for top in (1, 200, 70_000, 2**40):
        c = np.arange(5) + top
        assert (large_counts(small_counts(c), 5) == c).all()


def test_scores_against_plain_counts(spark):
    """The score is that of a dictionary with the same quantised counts, but for the filter's
    errors, which only raise a count; the number of buckets doesn't matter for the base."""
    import math
    from collections import Counter

    from shapeloom.llm.language_model import MU, score_texts

    rng = random.Random(5)
    rows = [(None if i == 7 else i, None if i == 9 else " ".join(f"W{int(rng.paretovariate(1)) % 500}" for _ in range(rng.randrange(200)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in score_texts(docs, docs).collect()}
    lists = {d: [*(t or "").lower().split(), None] for d, t in rows}
    one = Counter(x for ts in lists.values() for x in ts)
    two = Counter(p for ts in lists.values() for p in zip([0, *ts], ts, strict=False))
    norm = one.total() + 0.1 * (len(one) + 1)
    shown = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    errors = []
    for d, ts in lists.items():
        want = 0.0
        for h, w in zip([0, *ts], ts, strict=False):
            before = shown(one[None if h == 0 else h])
            want += math.log10(min(1.0, (min(shown(two[h, w]), before) + MU * (shown(one[w]) + 0.1) / norm) / (before + MU)))
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ts), len(ts), one.total())
        assert math.isclose(got[d].base_score, sum(math.log10((one[x] + 0.1) / norm) for x in ts), rel_tol=1e-9)
        errors.append((got[d].score - want) / len(ts))
    assert abs(sum(errors)) / len(errors) < 0.02 and max(map(abs, errors)) < 0.3
    assert sum(abs(e) < 1e-9 for e in errors) > 10


def test_pairs_seen_once_count(spark):
    from shapeloom.llm.language_model import score_texts

    train = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, "a d")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(docs, train).collect()}
    assert abs(got[1].base_score - got[2].base_score) < 1e-9  # the words are as frequent
    assert got[1].score > got[2].score  # the pairs are not


# Jaccard join.


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def noisy_copies(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(300)
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 10, 15, 20, 30, 60, 100, 200]))]
        for _ in range(rng.randrange(1, 7)):
            x = list(base)
            for _ in range(rng.randrange(max(2, len(x) // 12))):
                at = rng.randrange(len(x)) if x else 0
                if rng.random() < 0.4 and x:
                    x[at] = word()
                elif rng.random() < 0.6:
                    x.append(word())
                elif x:
                    x.pop(rng.choice([0, -1]))
            rows.append((len(rows), " ".join(x)))
    return rows


@pytest.mark.parametrize(("segments", "block", "light"), [(16, 10**6, 16), (96, 10**6, 16), (2, 10**6, 16), (4, 150, 1)])
def test_components_against_brute_force(spark, monkeypatch, segments, block, light):
    """Also with so few segments that many sets fall short of units, and small blocks."""
    from shapeloom.llm import jaccard_join
    from shapeloom.llm.jaccard_join import similar_components

    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    rows = noisy_copies(segments)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df, least_segments=segments, block_shingles=block).collect()}
    assert got == brute_components(rows)


def test_units_are_chosen_by_cost():
    """A set of six in three segments that needs three units: the segment that others share as
    a whole is left out, a cheap one gets its second unit."""
    from shapeloom.llm.jaccard_join import chosen

    entries = [  # kind, seg (number, two or more), full, near
        (0, 0 << 1 | 1, 50, 0),
        (0, 1 << 1 | 1, 2, 1),
        (1, 1 << 1 | 1, 1, 1),
        (0, 2 << 1 | 1, 3, 0),
        (1, 2 << 1 | 1, 90, 1),
    ]
    n = len(entries)
    x = {k: np.array([e[i] for e in entries]) for i, k in enumerate(("kind", "seg", "full", "near"))}
    x |= {"key": np.arange(n), "small": np.ones(n, bool), "below": np.zeros(n, int)} | {k: np.full(n, v) for k, v in (("held", 3), ("able", 6), ("need", 3), ("most", 2))}
    keep, probe = chosen(np.zeros(n, np.int64), x)
    assert keep.all() and probe.tolist() == [False, True, True, True, False]


def test_second_names_decide(spark):
    """Two different shingles of one hash don't make a link."""
    from shapeloom.llm.jaccard_join import verify

    sets = spark.createDataFrame([(1, 4, [1, 2, 3, 4], [11, 12, 13, 14]), (2, 4, [1, 2, 3, 4], [11, 12, 93, 94]), (3, 4, [1, 2, 3, 4], [11, 12, 13, 14])], "c long, n long, w array<long>, x array<long>").withColumn("counts", F.array(F.lit(4)))
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a long, b long")
    assert [tuple(r) for r in verify(pairs, sets).collect()] == [(3, 1)]


def test_components_of_long_chains(spark):
    from shapeloom.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7000, 7001), (7001, 7000)]
    random.Random(8).shuffle(edges)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {7000: 7000, 7001: 7000}


# SentencePiece.


def test_transducer_equals_the_library():
    import public_tokenizers
    import sentencepiece

    from shapeloom.llm.sentencepiece_fst import Transducer

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        fst = Transducer(f.read())
    rng = random.Random(9)
    pieces = list(fst.ids)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC   \n\n\t'.,;:-_0123456789éüñ日本語ゼ😀́▁\x00\x7f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) if k % 2 else "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))).replace("▁", " ") for k in range(6000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in fst.encode(texts)]
    assert got == lib.encode(texts)
    assert [fst.decode(x) for x in got] == lib.decode(got)


def test_units_are_composed_together():
    """Arrays of units give the path of each, in much less time than one by one."""
    import public_tokenizers

    from shapeloom.llm.sentencepiece_fst import Transducer

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    rng = random.Random(12)
    syllables = ["an", "the", "ro", "ñe", "sti", "Qu", "zz", "io", "k", "ö", "ent", "***", ".", "0", "日", "゛", "\u0378", "\U0001f9ff", "\x00"]
    words = [*{"".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(30_000)}, *("ab" * n for n in range(1, 300)), "\n" * 40, "  x"]
    together, alone = Transducer(model), Transducer(model)
    start = time.process_time()
    got = together.encode(words)
    middle = time.process_time()
    want = [[i for u in alone._split(w) for part in alone.unit.findall(u) for i in alone.path(part)] for w in words]
    end = time.process_time()
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert 1.5 * (middle - start) < end - middle


def test_pairs_without_merging():
    """Whether pieces stay beside each other, by their own merges and by those of the joined text."""
    import public_tokenizers

    from shapeloom.llm.sentencepiece_fst import Neighbours, Transducer

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        near = Transducer(f.read()).neighbours
    rng = random.Random(13)
    ids, score = [*near.ids.values()], {"a": 0.0, "b": 0.0, "c": 0.0, "aa": -1.0, "ab": -2.0, "bc": -2.0, "aab": -3.0, "aaaa": -3.0, "bca": -1.0, "cb": -4.0, "abab": -4.0, "bb": -5.0, "xyz": -1.0}
    small = Neighbours([*score], {p: i for i, p in enumerate(score)}, score)  # with equal ranks, and a piece that merging doesn't make
    pairs = [(near, rng.choice(ids), rng.choice(ids)) for _ in range(20_000)]
    for p, i in near.ids.items():  # those that are a piece together
        pairs += [(near, near.ids[p[:k]], near.ids[p[k:]]) for k in range(1, len(p)) if p[:k] in near.ids and p[k:] in near.ids][:2]
    pairs += [(small, i, j) for i in small.ids.values() for j in small.ids.values()]
    for which, i, j in pairs:
        x, y = which.pieces[i], which.pieces[j]
        assert (which.weight(i, j) == 0.0) == (which.merge(x + y) == [x, y]), (x, y)
    for which in (near, small):
        left, right = np.array([(i, j) for w, i, j in pairs if w is which], np.int32).T
        for _ in range(2):  # made, then remembered
            assert which.weights(left, right).tolist() == [which.weight(i, j) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
        assert not which.weights(left, np.full_like(left, -1)).any() and not which.weights(np.full_like(left, -1), right).any()


def test_unigram_paths():
    """The same machine with log probabilities as weights: the least sum wins."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    from shapeloom.llm.sentencepiece_fst import Transducer

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = False, False
    for piece, score in (("a", -3.0), ("b", -3.0), ("ab", -4.0), ("ba", -1.0), ("abab", -7.5)):
        m.pieces.add(piece=piece, score=score, type=1)
    for i in range(256):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    fst = Transducer(m.SerializeToString())
    name = lambda t: [fst.pieces[i] for i in np.frombuffer(fst.encode([t])[0], "<u4").tolist()]
    assert name("abab") == ["a", "ba", "b"]
    assert name("ababab") == ["a", "ba", "ba", "b"]
    assert name("aé") == ["a", "<0xC3>", "<0xA9>"]


def test_runs_of_blanks():
    import public_tokenizers
    import sentencepiece

    from shapeloom.llm.sentencepiece_fst import Transducer

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        fst = Transducer(f.read())
    texts = [" " * n + end for n in [*range(1, 150), 1000, 30_001] for end in ("foo", "", "\n", "x y", "日")]
    texts += ["a" + t for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in fst.encode(texts)] == lib.encode(texts)
    start = time.time()
    assert len(fst.encode([" " * 10_000_000 + "foo"])[0]) // 4 == 625_001
    assert time.time() - start < 20


@pytest.mark.parametrize("trim", [True, False])
def test_character_maps(trim):
    """The normaliser of another model, with a map of characters and blanks taken together."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from shapeloom.llm.sentencepiece_fst import Transducer

    m = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_normalizer_spec())
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, trim, True
    data = m.SerializeToString()
    rng = random.Random(4)
    alphabet = "abcXYZ  \n\t ÀÉéß①ﬁｆｕ\u3000\u200b\x7f½ǅ가각日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Transducer(data).encode(texts)]
    assert got == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)


# Quality.


def test_votes_against_plain_neighbours(spark):
    """Scores of the query's classifier against cosines computed one by one."""
    import pyarrow as pa

    from shapeloom.llm.quality_knn import NEIGHBOURS, NeighbourVote, features

    rng = random.Random(11)
    good = [" ".join(rng.choice(["the", "river", "Runs", "slowly,", "past", "old", "mills."]) for _ in range(30)) for _ in range(80)]
    junk = [" ".join(rng.choice(["the", "river", "buy", "cheap", "pills", "online", "now"]) for _ in range(30)) for _ in range(80)]
    x = features(pa.array(good + junk))
    y = np.array([1.0] * 80 + [0.0] * 80, np.float32)
    order = np.random.default_rng(1).permutation(160)
    train, test = order[:120], order[120:]
    model = NeighbourVote(x[train], y[train])
    got = model.score(x[test])
    unit = lambda v: v / np.linalg.norm(v)
    for i, row in enumerate(x[test]):
        z = unit(unit(row * model.idf) @ model.basis)
        near = sorted(((float(z @ unit(unit(t * model.idf) @ model.basis)), float(label)) for t, label in zip(x[train], y[train], strict=True)), reverse=True)[:NEIGHBOURS]
        weight = [max(c, 0.0) ** 8 for c, _ in near]
        assert abs(got[i] - sum(w * label for w, (_, label) in zip(weight, near, strict=True)) / sum(weight)) < 1e-3
    assert ((got > 0.5) == (y[test] == 1)).all()  # junk in ordinary letters is known by its words


# Chat formatting, order of ties.


def test_ties_are_ordered_by_text(spark):
    from shapeloom.llm.chat_format import format_chats, read_back, text_part

    texts = ["</s>", "<0", "<\\/s>", "<x", "[INST] a", "[0", None]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string").withColumn("parts", text_part(F.col("text")))
    got = read_back(format_chats(df)).first()
    assert [t.text for t in got.turns] == sorted(t or "" for t in texts)


def test_other_tokenizers_are_checked():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from shapeloom.llm.token_files import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  there, it's", "", "a\nb\t日本"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(path).encode(pa.array(texts))] == want
