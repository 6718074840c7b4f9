"""Helpers that the operators share: reading tables, the shared folder, checkpoints, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.sources.shared import scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "checkpointed", "held", "let", "scratch", "shared_dir", "slices", "small", "table", "words"]

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a side that is broadcast on purpose; beyond it the operators shuffle instead.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row although body names it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; the caller's join shuffles otherwise. df is cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, one thing at a time: asking for another one lets the last one go.

    So a worker that turns from one operator to the next doesn't hold the models of both. What the last one leaves, and the batches that Arrow
    keeps for reuse, go back to the system first; else they would stay beside the next one for as long as the worker lives.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # glibc has it
        _held[key] = make()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a task turns only so many texts into Python objects at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
