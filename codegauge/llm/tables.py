"""Shared steps of the operators: columns, folds, Arrow batches, written tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.workspace import shared_folder

BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
PARTS = 16  # of a vector that is summed

_IN_WORKER: list = []


def once_in_worker(make: Callable) -> Callable:
    """Keeps what ``make`` returns in the worker process, one result per arguments, until ``forget``."""
    held = functools.cache(make)
    _IN_WORKER.append(held)
    return held


def forget(*but: Callable) -> None:
    """Frees what a reused worker process holds from an earlier step, except what ``but`` made.

    Models and their words go, and what the allocators keep of them is given back: they would
    hold it until the process ends.
    """
    for held in _IN_WORKER:
        if held not in but:
            held.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries lack it
    if trim:
        trim(0)


def key_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever else the table holds; a null text is an empty one."""
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds (a null id is written empty)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def flat(columns: list[pa.Array]) -> list[pa.Array]:
    """The columns, with the fields of structs in place of the structs."""
    out = []
    for c in columns:
        out += flat([c.field(k) for k in range(c.type.num_fields)]) if pa.types.is_struct(c.type) else [c]
    return out


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows and ``size`` bytes of text, or one row."""
    lengths = [pc.fill_null(pc.binary_length(c), 0) for c in flat(batch.columns) if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lengths)) if lengths else None
    start = 0
    while start < batch.num_rows or start == 0:
        stop = min(start + rows, batch.num_rows)
        if ends is not None and stop:
            before = ends[start - 1] if start else 0
            stop = min(stop, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(start, stop - start)
        start = max(stop, start + 1)


def in_batches(frame: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough that a worker holds a few MB of ordinary texts.

    Spark's batches are cut in the worker, by rows and by bytes, so no setting is changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for batch in batches for part in slices(batch))

    return frame.mapInArrow(run, schema)


def summed(frame: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """Sum of the ``length`` whole numbers that ``fn`` makes of the batches of each partition.

    The order of the partitions makes no difference, as whole numbers are summed.
    """
    schema = "part int, numbers binary"

    def rows(numbers: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in numbers.values()]
        return pa.RecordBatch.from_arrays([pa.array(numbers.keys(), pa.int32()), pa.array(packed, pa.binary())], ["part", "numbers"])

    def run(batches):
        yield rows(dict(enumerate(np.array_split(fn(batches), PARTS))))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), "<i8")
                held[k] = held[k] + got if k in held else got
        yield rows(held)

    parts = in_batches(frame, run, schema).repartition(PARTS, "part")
    got = {r["part"]: r["numbers"] for r in in_batches(parts, add, schema).collect()}  # PARTS rows
    if not got:
        return np.zeros(length, np.int64)
    return np.concatenate([np.frombuffer(zlib.decompress(got[k]), "<i8") for k in range(PARTS)])


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows written below spark.checkpoint.dir and read back: later steps start from files.

    A lost executor then costs its tasks, not the whole lineage. What was shuffled for the rows is
    no longer needed; Spark removes it from the disks when the driver collects its garbage,
    which by itself may be many steps later.
    """
    folder = shared_folder(frame.sparkSession, f"llm-{name}")
    frame.write.parquet(folder)
    frame.sparkSession._jvm.System.gc()
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def drop_written(frames: list[DataFrame]) -> None:
    """Removes folders made by ``written`` whose rows are no longer needed."""
    for frame in frames:
        spark: SparkSession = frame.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if "/codegauge/llm-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
