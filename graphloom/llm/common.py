"""Shared pieces of the training-data operators: the shared work folder, committed tables, bounded caches."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.sql import SparkSession, functions as F

from ..workspace import committed, discard, release_shuffles, work_root

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "TwoGenerations", "bounded_batches", "committed", "discard", "give_back", "mix64", "release_shuffles", "shrink_heaps", "take_over", "work_root"]

#: Rows and bytes of one Arrow batch handed to Python: long texts stay bounded in a worker.
BATCH_ROWS, BATCH_BYTES = 1024, "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches for Python workers small, so that very long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_holder: list = [None, None]


def take_over(name: str, forget=None) -> None:
    """Called where an operator's work in a Python worker begins: what another operator remembers there is let go (by the
    function it left) and the memory goes back to the system. Workers serve many stages; only one remembers at a time."""
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
        give_back()
    _holder[:] = [name, forget]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shrink_heaps(spark: SparkSession) -> None:
    """Let each executor's JVM collect all its garbage now and return the heap that earlier steps needed to the system. Otherwise
    a heap may keep it, beside Python workers that need the memory. One short task an executor (the driver, where there is none);
    without preferences Spark deals them one to each. An executor that gets none keeps its heap, no more."""
    executors = max(spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1, 1)
    spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


class TwoGenerations:
    """A bounded memo: when the young half is full it becomes the old half, whose entries survive only if used again."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def missing(self, keys) -> list:
        """Distinct keys not held; the held ones are now in the young half."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    young[k] = v
        return out

    def add(self, keys, values) -> None:
        self.young.update(zip(keys, values))

    def rotate(self) -> None:
        """Call between batches only, so that a batch finds all it has added."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
