"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import prepare

#: Rows and bytes that one Arrow batch may hold; keeps a worker's memory independent of text length.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

#: Spark's setting that removes what a frame has shuffled when its action ends; a frame reads it when it is made.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Arrow types of Spark column types, for mapInArrow schemas.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}


def bounded(spark: SparkSession) -> SparkSession:
    """Prepare the session and bound the Arrow batches that Python workers get."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def arrow_schema(ddl: str) -> pa.Schema:
    """``"doc_id long, text string"`` as an Arrow schema."""
    return pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in ddl.split(","))])


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same batch function; what it held goes back to the system when it ends, as workers are used again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def map_rows(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """Arrow-batched map: ``make()`` runs once per task and gives the function of a batch.

    The function returns columns by name (lists or arrays) in the order of ``ddl``.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(freed(run), ddl)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Arrow-batched filter that keeps every column; ``make()`` gives the function from a batch to a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return df.mapInArrow(freed(run), df.schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id's decimal text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fold_hash(doc_id: Column, salt: int) -> Column:
    """A uniform value in [0, 1) of the id, for deterministic bounded samples."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of unsigned 64-bit values (the public SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage: a reliable checkpoint in the shared folder.

    Nothing reads the shuffles behind it again, so their files go at once; else they
    would stay until the driver happens to collect its garbage. The frame that is
    computed is a new one: ``df`` itself can still be used.
    """
    conf = df.sparkSession.conf
    was = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if was is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, was)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system, before the worker waits or is used again."""
    pa.default_memory_pool().release_unused()
    if trim := _libc():
        trim(0)


@cache
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column has, whatever the case."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
