"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share.

    ``spark.checkpoint.dir`` names that folder on a cluster. Only a session
    without it (as in tests, where all runs on one machine) gets a local one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = getattr(spark, "_llm_folder", None)
        if kept is None:
            kept = spark._llm_folder = tempfile.mkdtemp(prefix="llm-")
        base = "file://" + kept
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _collecting:
        made.append(path)
    return path


_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that are made inside, for who knows when they are read no more."""
    made: list[str] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its
    lineage is cut, and the loss of an executor loses nothing of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders made by ``shared_folder``."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together hold about ``limit`` bytes, so
    that the arrays made from them stay small whatever the batch size is."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def arrow_path(uri: str):
    """(file system, path) of a URI for pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    if uri.startswith(("s3a://", "s3n://")):
        return fs.FileSystem.from_uri("s3" + unquote(uri[3:]))
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(unquote(uri))
