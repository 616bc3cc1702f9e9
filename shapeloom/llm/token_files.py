"""Token-ID output: Arrow stream files of fixed-size-list batches.

Documents are dealt to shards by ranges of ``doc_id``, so shards in order hold ascending
ids. A shard is a folder of two Arrow stream files: ``tokens.arrows``, whose record batches
hold ``ROWS`` sequences of ``LENGTH`` ids (fixed_size_list<uint16>) and masks
(fixed_size_list<bool>, false over the padding at the shard's end), and ``docs.arrows``,
which holds the id, start and number of ids of each document. All batches of a token file
but the last have one size in bytes, so sequence k lies at a computed place, and a memory
map of it is read without a copy.

A text is encoded by the tokenizers library. Its pre-tokenizer never joins what blanks
separate, so ids are kept by blank-separated piece in a bounded memo.

Defined cases: null and empty texts have the end id only; null ids come first; repeated
rows are ordered by text; a piece of any length is encoded whole; other columns are ignored;
an empty table has shards without documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.memo import memo
from shapeloom.llm.words import chunked
from shapeloom.shared import TOGETHER, shared_path

LENGTH, ROWS = 1024, 256
END_ID = 1
#: Pieces that are one word to the tokenizer: letters, or marks. A mark after a letter and
#: before a blank begins a word of its own.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-/:-@\\[-`{-~"
SIMPLE = re.compile(f"[{LETTERS}]+|[{MARKS}]+")
MARK_AFTER_LETTER = f"([{LETTERS}])([{MARKS}]+)( |$)"
#: The strings that stand for special ids begin so; texts with it aren't touched beforehand.
SPECIAL = "<|"
TOKENS = pa.schema([("tokens", pa.list_(pa.uint16(), LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI of the shared folder."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class Encoder:
    """Texts to little-endian 16-bit ids."""

    #: A symbol whose one id stands between pieces that are encoded together.
    BETWEEN = "¤"
    #: What the vocabulary's last piece of each word ends in.
    WORD_END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids of more than 16 bits are not supported")
        self.by_word = self._splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.memo = memo(("ids", path))
        between = self._ids(self.BETWEEN)
        self.between = int(between[0]) if len(between) == 1 else None

    def _splits_at_blanks(self, spec: dict) -> bool:
        """Whether words are encoded each by itself and end in ``WORD_END``, blanks are dropped
        and capitals count as small letters. Whole texts are encoded otherwise."""
        kinds = str(spec.get("normalizer"))
        return spec["model"].get("end_of_word_suffix") == self.WORD_END and "Lowercase" in kinds and spec["pre_tokenizer"] is not None and not self._ids(" \n ").size

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _encode(self, pieces: list[str]) -> list[bytes]:
        simple = [SIMPLE.fullmatch(p) is not None for p in pieces]
        words = iter(self._encode_words([p for p, x in zip(pieces, simple, strict=True) if x]))
        others = iter(self._encode_others([p for p, x in zip(pieces, simple, strict=True) if not x]))
        return [next(words) if x else next(others) for x in simple]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Each piece ends where a word ends."""
        ids = self._ids(" ".join(words))
        cut = ((np.flatnonzero(self.ends[ids]) + 1) * 2).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def _encode_others(self, pieces: list[str]) -> list[bytes]:
        if self.between is None or any(self.BETWEEN in p for p in pieces):
            return [self._ids(p).tobytes() for p in pieces]
        ids = self._ids(f" {self.BETWEEN} ".join(pieces))
        cut = np.flatnonzero(ids == self.between) * 2
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *(cut + 2).tolist()], [*cut.tolist(), len(flat)], strict=True)] if pieces else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Small letters, which the tokenizer would make as well, and marks
        apart leave few distinct pieces; these are looked up, and gathered as arrays."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        spaced = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), MARK_AFTER_LETTER, r"\1 \2\3")
        split = pc.split_pattern(pc.if_else(pc.match_substring(texts, SPECIAL), pc.replace_substring(texts, "\n", " "), spaced), " ")
        pieces = split.flatten().dictionary_encode()
        values = self.memo.look_up([pieces.dictionary.to_pylist()], self._encode)[0]
        flat = np.frombuffer(b"".join(values), "<u2")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 2
        start, at = np.cumsum(size) - size, pieces.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        ids = flat[np.repeat(start[at] - (end - n), n) + np.arange(n.sum())]
        cut = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class ShardWriter:
    """Writes one shard below a name of its own attempt; ``close`` gives it its final name,
    so a repeated task replaces the shard as a whole."""

    def __init__(self, root: str, shard: int, id_type: pa.DataType):
        self.fs, base = filesystem(root)
        self.final, self.temp = f"{base}/shard-{shard:06d}", f"{base}/_attempt-{shard:06d}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.temp, recursive=True)
        self.sink = self.fs.open_output_stream(f"{self.temp}/tokens.arrows")
        self.out = pa.ipc.new_stream(self.sink, TOKENS)
        self.docs_sink = self.fs.open_output_stream(f"{self.temp}/docs.arrows")
        self.index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs = pa.ipc.new_stream(self.docs_sink, self.index)
        self.parts: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0

    def add(self, ids: pa.Array, tokens: list[np.ndarray]) -> None:
        n = np.array([len(t) for t in tokens], np.int64)
        starts = self.total + np.cumsum(n) - n
        self.docs.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n)], schema=self.index))
        self.total += int(n.sum())
        self.n_docs += len(tokens)
        self.parts += tokens
        self.held += int(n.sum())
        if self.held >= ROWS * LENGTH:
            flat, full = np.concatenate(self.parts), ROWS * LENGTH
            for at in range(0, len(flat) - full + 1, full):
                self._write(flat[at : at + full])
            rest = flat[len(flat) // full * full :].copy()
            self.parts, self.held = [rest], len(rest)

    def _write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // LENGTH)
        mask = np.arange(rows * LENGTH) < len(flat)
        padded = np.zeros(rows * LENGTH, np.uint16)
        padded[: len(flat)] = flat
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)], schema=TOKENS))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.parts))
        for x in (self.out, self.sink, self.docs, self.docs_sink):
            x.close()
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_dir(self.final)
        self.fs.move(self.temp, self.final)


class TokenFile:
    """Random access to a shard's sequences and documents."""

    def __init__(self, root: str, shard: int):
        self.fs, base = filesystem(root)
        path = f"{base}/shard-{shard:06d}"
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.file = pa.memory_map(f"{path}/tokens.arrows") if local else self.fs.open_input_file(f"{path}/tokens.arrows")
        with self.fs.open_input_stream(f"{path}/docs.arrows") as f:
            self.docs = pa.ipc.open_stream(f).read_all()
        pa.ipc.read_message(self.file)  # the schema
        self.first = self.file.tell()
        self.stride = 0
        if self.first < self.file.size():
            pa.ipc.read_message(self.file)
            self.stride = self.file.tell() - self.first
        self._last: tuple[int, pa.RecordBatch] | None = None

    def batch(self, k: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != k:
            self.file.seek(self.first + k * self.stride)
            self._last = k, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), TOKENS)
        return self._last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence k."""
        b, r = self.batch(k // ROWS), k % ROWS
        return b.column(0).values.to_numpy()[r * LENGTH : (r + 1) * LENGTH], b.column(1).values.slice(r * LENGTH, LENGTH).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from ``start`` on."""
        out, full = [], ROWS * LENGTH
        while n:
            view = self.batch(start // full).column(0).values.to_numpy()[start % full :][:n]
            out.append(view)
            start, n = start + len(view), n - len(view)
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_token_files(docs: DataFrame, root: str, tokenizer: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns the manifest (shard, start, n_docs, n_tokens), one row
    a shard. Only those few numbers of each shard come to the driver."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = pa.int64() if rows.schema["id"].dataType.simpleString() == "bigint" else pa.int32() if rows.schema["id"].dataType.simpleString() == "int" else pa.string()
    dealt = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    def write(batches):
        shard = TaskContext.get().partitionId()
        encoder, out = Encoder(tokenizer), ShardWriter(root, shard, id_type)
        end = np.array([END_ID], np.uint16)
        for batch in chunked(batches):
            out.add(batch.column(0).cast(id_type), [np.concatenate([ids, end]) for ids in encoder.encode(batch.column(1))])
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [out.n_docs], "n_tokens": [out.total]})

    found = sorted(dealt.mapInArrow(write, "shard long, n_docs long, n_tokens long").collect())
    at, manifest = 0, []
    for shard, n_docs, n_tokens in found:
        manifest.append((shard, at, n_docs, n_tokens))
        at += n_tokens
    # The index rows read back are small: a task goes through several shards.
    tasks = min(max(1, len(manifest)), max(len(manifest) // TOGETHER, 2 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(spark.sparkContext.parallelize(manifest, tasks), "shard long, start long, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame, root: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(root, row["shard"])
                for d in f.docs.to_batches(max_chunksize=4096):
                    crc = [zlib.crc32(f.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(np.asarray(d.column(1)) + row["start"]), d.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    import public_tokenizers

    root = shared_path(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, root)
