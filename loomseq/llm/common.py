"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, settled  # noqa: F401  the operators' own way to these

#: A word of the contracts: a run of anything but space and \x09-\x0D.
#: Python's bytes.split() without arguments cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    return scratch_path(spark, what)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes what is there, if anything is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key(df: DataFrame, columns: list[str]) -> list[F.Column]:
    """Two numbers (k1, k2), never null, that are equal for rows equal in these columns, and differ for others."""
    parts = [F.lit(0)]
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        value = F.col(f"`{c}`")
        # a hash skips nulls, also those within, so their places go in too
        whole = F.to_json(F.struct(value), {"ignoreNullFields": "false"}) if "<" in kind else value
        parts += [value.isNull(), whole]
    return [F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (1, 2)]


def n_words(text) -> F.Column:
    """Words of a text column as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_rows(column) -> list:
    """An Arrow string or binary column as a list of bytes, null as None."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


#: Bytes of a batch that are turned to Python objects at once, if it has more than one row.
SLICE_BYTES = 1 << 20


def slices(batch, size: int = SLICE_BYTES):
    """A record batch in parts of about size bytes, one row at least, so that few Python objects live at once."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def trimmed(f):
    """f, a generator over a task's batches, after which the worker's free memory goes back to the system.

    Python workers live on from stage to stage, several to an executor, and
    what a past task leaves allocated is memory that other tasks lack.
    """

    @wraps(f)
    def run(batches, *args, **settings):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # the one that a trim reaches
        try:
            yield from f(batches, *args, **settings)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def freed(spark: SparkSession) -> None:
    """Gives the driver's free memory back, its Python's and its JVM's.

    Broadcasts, shuffles and checkpoints that no plan names any more go only
    when the JVM collects; many short jobs pile them up.
    """
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def held(make):
    """make() for the time of a task, for a trimmed function."""
    found = [make()]
    try:
        yield found[0]
    finally:
        found.clear()
        gc.collect()
