"""HDF5 files, where the h5py library is installed; Parquet (``tables``) needs none.

Frames: dataset ``frames`` (n, h, w), optional ``scan_positions``, attribute
``scan_dimensions`` (width, height) or else the shape of ``stem/images``.  Counted: group
``electron_events`` with ``frames`` and ``scan_positions``, whose attributes hold the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseDataset
from .tables import from_nested

#: Frames that a task reads.
BLOCK = 32


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise ImportError("HDF5 files need the h5py library, which isn't installed; tables.py reads and writes Parquet") from error
    return h5py


def _ranges(spark: SparkSession, n: int, each: int) -> DataFrame:
    return spark.range(0, n, each, max(1, -(-n // each))).select(F.col("id").alias("start"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``frames`` of a file that all executors can open."""
    h5py = _h5py()
    with h5py.File(path, "r") as file:
        n, h, w = file["frames"].shape
        dimensions = file["frames"].attrs.get("scan_dimensions", file.attrs.get("scan_dimensions"))
        width, height = (int(x) for x in (dimensions if dimensions is not None else file["stem/images"].shape[2:0:-1]))
        placed = "scan_positions" in file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as file:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    data = np.asarray(file["frames"][start : start + BLOCK], "<u2")
                    number = np.arange(start, start + len(data))
                    place = np.asarray(file["scan_positions"][start : start + BLOCK]) if placed else number
                    yield pa.RecordBatch.from_pydict({"frame_num": pa.array(number, pa.int64()), "scan_pos": pa.array(place.astype("i4")), "data": pa.array([f.tobytes() for f in data], pa.binary())})

    rows = _ranges(spark, n, BLOCK).mapInArrow(run, "frame_num long, scan_pos int, data binary")
    fixed = {"scan_num": F.lit(0).cast("long"), "scan_w": F.lit(width), "scan_h": F.lit(height), "frame_h": F.lit(h), "frame_w": F.lit(w), "complete": F.lit(True)}
    return rows.withColumns(fixed).select("scan_num", "frame_num", "scan_pos", "scan_w", "scan_h", "frame_h", "frame_w", "complete", "data")


def read_counted(spark: SparkSession, path: str) -> SparseDataset:
    """A counted dataset of any of the three formats; later ones name their version."""
    h5py = _h5py()
    with h5py.File(path, "r") as file:
        group = file["electron_events"]
        version = int(group.attrs.get("version", 1))
        n = group["frames"].shape[0]
        per = int(group["frames"].shape[1]) if version == 3 else 1
        shape = tuple(int(group["scan_positions"].attrs[k]) for k in ("Ny", "Nx"))
        frame = tuple(int(group["frames"].attrs[k]) for k in ("Ny", "Nx"))
    index = "frame_id" if version == 2 else "frame_idx"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as file:
            group = file["electron_events"]
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    events = group["frames"][start : start + BLOCK]
                    place = np.asarray(group["scan_positions"][start : start + len(events)]).astype("i4")
                    rows = [(int(p), start + k if version == 2 else j, np.asarray(e, "i4")) for k, p in enumerate(place) for j, e in enumerate(events[k] if version == 3 else [events[k]])]
                    pos, idx, hits = zip(*rows) if rows else ((), (), ())
                    yield pa.RecordBatch.from_pydict({"scan_pos": pa.array(pos, pa.int32()), index: pa.array(idx, pa.int32()), "events": pa.array(hits, pa.list_(pa.int32()))})

    nested = _ranges(spark, n, BLOCK).mapInArrow(run, f"scan_pos int, {index} int, events array<int>")
    return from_nested(nested, shape, frame, per, {}, version)
