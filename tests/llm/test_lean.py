"""What Python workers hold between their batches and tasks."""

import re
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from shapeloom.llm import lean as module
from shapeloom.llm import sentencepiece_fst
from shapeloom.llm.lean import PIECE, lean


def held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def forget():
    forgotten.append(1)


forgotten: list[int] = []


def test_freed_memory_goes_back():
    pins = []

    def run(batches):
        for batch in batches:
            small = [np.ones(128) for _ in range(100_000)]
            pins.append(small[-1])  # behind all others, so that the heap can't shrink by itself
            del small
            yield batch

    before = held_mb()
    assert sum(b.num_rows for b in lean(run)(iter([pa.record_batch({"x": [1]})]))) == 1
    assert held_mb() - before < 60


def test_pieces():
    n = 3 * PIECE // 8
    batch = pa.record_batch({"x": np.arange(n), "y": pa.array([[i % 100] * (i % 3) for i in range(n)], pa.list_(pa.int8()))})
    out = list(lean(lambda batches: batches)(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(out) == pa.Table.from_batches([batch])
    assert len(out) > 3 and max(b.nbytes for b in out) < 2 * PIECE
    long = pa.record_batch({"x": ["a" * (2 * PIECE), "b"]})
    assert [b["x"].to_pylist() for b in lean(lambda batches: batches)(iter([long]))] == [["a" * (2 * PIECE)], ["b"]]


def test_idle_workers_forget(monkeypatch):
    monkeypatch.setattr(module, "IDLE_S", 0.3)
    task = lean(lambda batches: batches, forget)
    for _ in range(3):  # a task that comes in time keeps all
        list(task(iter([])))
        time.sleep(0.05)
    assert not forgotten
    time.sleep(1)
    assert forgotten == [1]


def test_idle_workers_drop_the_encoder(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    ids = lambda: sorted(sentencepiece_fst.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    first = ids()

    def kept(batches):
        for batch in batches:
            time.sleep(0.5)  # so that each task has a worker of its own
            yield pa.record_batch({"n": pa.array([len(sentencepiece_fst._machines)], pa.int32())})

    count = lambda: [r.n for r in spark.range(4).repartition(4).mapInArrow(kept, "n int").collect()]
    assert sum(count()) > 0
    time.sleep(module.IDLE_S + 2)
    assert sum(count()) == 0
    assert ids() == first
