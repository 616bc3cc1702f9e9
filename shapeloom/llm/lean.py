"""Memory of Python workers, given back to the system as soon as it isn't needed.

A worker outlives its task and lies beside its executor's JVM, whose memory limit it shares. The
allocators of C and of Arrow keep what is freed, so a worker would go on holding the most that
any of its tasks once needed, also through later steps that use no Python.
"""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of a batch that is sent to the JVM, which holds it outside its heap.
PIECE = 4 << 20
#: Seconds without a task after which a worker forgets what it keeps from task to task.
IDLE_S = 2.0

#: Of glibc; other systems' allocators do without.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_timers: dict[Callable[[], None], threading.Timer] = {}


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _stop(forget: Callable[[], None]) -> None:
    timer = _timers.pop(forget, None)
    if timer is not None:
        timer.cancel()


def _later(forget: Callable[[], None]) -> None:
    def idle():
        forget()
        gc.collect()
        give_back()

    _stop(forget)
    timer = _timers[forget] = threading.Timer(IDLE_S, idle)
    timer.daemon = True
    timer.start()


def lean(run: Run, forget: Callable[[], None] | None = None) -> Run:
    """``run``, a function for mapInArrow, with its batches sent in pieces of bounded size, giving
    back memory before each batch that it reads and at its end. ``forget``, a function of a
    module, drops what ``run`` keeps for the worker's next task; it is called when none has come
    for ``IDLE_S``. A task that begins meanwhile must hold what it uses."""

    def fed(batches):
        for batch in batches:
            give_back()
            yield batch
            del batch

    def out(batches):
        if forget is not None:
            _stop(forget)
        try:
            for batch in run(fed(batches)):
                rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)
        finally:
            give_back()
            if forget is not None:
                _later(forget)

    return out
