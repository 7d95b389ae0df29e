"""Small helpers that the text operators share: tables, shared storage and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What a function is given at once: texts may be long, so that few rows are worked on together.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="factgraph-")


#: The paths that the open shelves hold, innermost last.
_shelves: list[list[str]] = []
#: The path of each stored table, by the table's own id.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: the plan before it is cut and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if _shelves:
        _shelves[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = _paths.pop(df)
    for held in _shelves:
        if path in held:
            held.remove(path)
    _delete(df.sparkSession, path)


def kept_beyond(df: DataFrame) -> DataFrame:
    """A stored table that outlives the innermost shelf."""
    _shelves[-1].remove(_paths[df])
    if len(_shelves) > 1:
        _shelves[-2].append(_paths[df])
    return df


@contextmanager
def shelf(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored within it."""
    _shelves.append([])
    try:
        yield
    finally:
        for path in _shelves.pop():
            _delete(spark, path)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and bytes; a longer row is a part of its own."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one slice of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(fn, slices(b, rows, size))
        pa.default_memory_pool().release_unused()

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
