"""Places on the cluster's shared storage.

Everything an operator has to write and read back goes below ``spark.checkpoint.dir``, which the
driver and all executors share. Files are named by partition and replaced whole, so a task that is
run again writes the same file again.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: The setting that bounds an Arrow batch on its way to a worker.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set where none is configured and the master is local, elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ratingloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a folder that no other call uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to Python workers hold ``most`` bytes from now on, unless one row has more; a limit that the session already sets stays.

    Spark's own limit is 64 MB: the JVM builds such a batch outside its heap, in buffers that double, and the worker reads it whole.
    """
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(most))


def settled(spark: SparkSession) -> None:
    """Have the driver's JVM collect what earlier jobs have left; Spark's cleaner drops their broadcasts and shuffles only then. For between the steps of a long job."""
    gc.collect()
    spark._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept on shared storage (its lineage ends there)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df computed once and kept as compressed Parquet on shared storage; for what is too large for saved()."""
    folder = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[id(out)] = (weakref.ref(out, lambda _, k=id(out): _FOLDERS.pop(k, None)), folder)
    return out


#: Where the tables of stored() are, for as long as their DataFrames live.
_FOLDERS: dict[int, tuple[weakref.ref, str]] = {}


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored() table; only for one that nothing will read again."""
    _, folder = _FOLDERS.pop(id(df))
    erased(df.sparkSession, folder)


def erased(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{os.path.abspath(uri)}")


@contextlib.contextmanager
def new_file(uri: str):
    """A stream for a file that appears whole or not at all."""
    files, path = open_fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft, compression=None) as out:
        yield out
    files.move(draft, path)


def cuts(sizes: np.ndarray, rows: int, most: int) -> list[tuple[int, int]]:
    """(first, stop) of runs of at most ``rows`` rows and, unless one row has more, ``most`` in size."""
    ends, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        before = int(ends[i - 1]) if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + most, "right"))))
        out.append((i, j))
        i = j
    return out


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's strings and binary values."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column).cast(pa.int64()), 0))
    return size


def released() -> None:
    """Give what Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 2048, most: int = 32 << 20):
    """Record batches of at most ``rows`` rows and, unless one row has more, ``most`` bytes of text: what is made from a batch of texts is several times its size.

    A worker process outlives its tasks: what Arrow and the C library hold unused after the last batch goes back to the system.
    """
    for batch in batches:
        for i, j in cuts(_row_bytes(batch), rows, most):
            yield batch.slice(i, j - i)
    released()


def put(uri: str, chunks) -> int:
    """Write chunks of bytes to a file that appears whole or not at all; the number of bytes."""
    n = 0
    with new_file(uri) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return n
