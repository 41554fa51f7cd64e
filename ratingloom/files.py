"""Files on the cluster's shared storage, written whole or not at all: what a task that runs again writes again."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


@contextlib.contextmanager
def writer(uri: str, schema: pa.Schema) -> Iterator[pa.RecordBatchStreamWriter]:
    """A writer of Arrow batches to a file that appears when all is written."""
    files, path = located(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft, compression=None) as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as sink:
        yield sink
    files.move(draft, path)


def batches(uri: str) -> Iterator[pa.RecordBatch]:
    """The batches of such a file, one at a time."""
    files, path = located(uri)
    with files.open_input_stream(path) as source:
        yield from pa.ipc.open_stream(source)


def erased(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def note(spark: SparkSession, uri: str) -> str:
    """The text of a small file, also of one that Spark's readers pass over."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
