"""What the training-data operators share: ASCII case, row batches, scratch tables."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_BYTE_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Regular expression (Java and Python) of a word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only; every other character stays as it is."""
    if text.isascii():
        return text.lower()
    return text.encode().translate(_BYTE_TABLE).decode()


def lower_ascii_bytes(text: str) -> bytes:
    return text.encode().translate(_BYTE_TABLE)


def named(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text column as a string in which null counts as empty."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it in any case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A local master may leave it unset, as in tests: then it is a folder of this process's own.
    A cluster may not, since executors wouldn't see each other's local folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scanlattice-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to a Parquet table in the shared scratch folder and reads it back.

    This cuts the lineage without relying on executor-local blocks: a lost executor costs
    a re-read and nothing more.  The schema is handed to the reader, so that empty results
    read back as well.  Within ``scratch`` the table is removed at the end.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables from whatever store the scratch folder is in."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs.

    They stay on the executors' disks until the driver's JVM collects the plans that they
    belong to, which a small driver may not do for long.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A scope whose tables are removed at its end, but for what is handed to its ``last``,
    which writes like ``materialize`` and must not depend on the others when read."""
    outer, own = _SCOPE.get(), []
    token = _SCOPE.set(own)

    def last(df: DataFrame, name: str) -> DataFrame:
        inside = _SCOPE.set(outer)
        try:
            return materialize(df, name)
        finally:
            _SCOPE.reset(inside)

    try:
        yield last
    finally:
        _SCOPE.reset(token)
        _remove(spark, own)
        release(spark)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """About how many bytes each value holds: of texts, binaries and lists."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        n = pc.binary_length(column)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        n = pc.multiply(pc.list_value_length(column), 8)
    else:
        return np.zeros(len(column), np.int64)
    return pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 256, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` rows and, but for single longer rows, of at
    most ``most_bytes``, so that Python copies stay small."""
    for batch in batches:
        end = np.cumsum(sum((_bytes_of(c) for c in batch.columns), np.zeros(batch.num_rows, np.int64)))
        at = 0
        while at < batch.num_rows:
            before = end[at - 1] if at else 0
            n = int(np.searchsorted(end, before + most_bytes, side="right")) - at
            n = max(1, min(n, most, batch.num_rows - at))
            yield batch.slice(at, n)
            at += n
