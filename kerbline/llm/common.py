"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; a null text counts as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def per_worker(key: tuple, make: Callable):
    """One object per Python worker process, built on first use and shared by later tasks.

    The package travels by value, so module globals are fresh in each task; the cache hangs
    on a module object of the interpreter instead. Keys begin with the name of their operator:
    a worker that comes to another one drops the tables of the one before.
    """
    held = sys.modules.setdefault("kerbline_worker", types.ModuleType("kerbline_worker")).__dict__
    if key not in held:
        for other in [k for k in held if isinstance(k, tuple) and k[0] != key[0]]:
            del held[other]
        held[key] = make()
    return held[key]


def at_rest(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives its free memory back to the system when it ends.

    Workers are kept for later tasks and stages; what they only used in between would else stay
    with them beside the JVM of the executor.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to ask
            pass

    return wrapped


def cut_batches(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes; a longer text is a slice of its own.

    Bounds what a Python task holds whatever the number of rows Spark puts in one batch.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
