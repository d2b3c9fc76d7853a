"""Indexing of sparse datasets by the rules of numpy, as filters and small map joins.

A key is resolved against the scan shape and the frame shape apart.  Ints and slices become
a range of the flat key, which Parquet prunes files and row groups by, and arithmetic on it
for what the range doesn't say; integer arrays and masks become a map (old key, new key) that is joined, so repeated indices fan out.  The map has
one row per selected index; Spark broadcasts it only below its own size threshold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import col_of, row_of, whole
from ..model import SparseDataset


def _is_array(k) -> bool:
    return isinstance(k, (list, np.ndarray))


def _split(ds: SparseDataset, key) -> tuple[list, list]:
    """The key's parts for the scan axes and for the frame axes, padded with full slices."""
    key = list(key) if isinstance(key, tuple) else [key]
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("more than one ellipsis")
    parts = [np.asarray(k) if _is_array(k) else k for k in key]
    for p in parts:
        if isinstance(p, np.ndarray) and p.ndim > 1 and p.dtype != bool:
            raise IndexError("an index of more than one axis must be boolean")
    used = sum(p.ndim if isinstance(p, np.ndarray) and p.dtype == bool else 1 for p in parts if p is not Ellipsis)
    if used > ds.ndim:
        raise IndexError(f"{used} indices for {ds.ndim} axes")
    if Ellipsis not in [p for p in parts if p is Ellipsis]:
        parts.append(Ellipsis)
    at = next(i for i, p in enumerate(parts) if p is Ellipsis)
    parts[at : at + 1] = [slice(None)] * (ds.ndim - used)
    scan, frame, axis = [], [], 0
    for p in parts:
        width = p.ndim if isinstance(p, np.ndarray) and p.dtype == bool else 1
        n_scan = len(ds.scan_shape)
        if axis < n_scan < axis + width:
            raise IndexError("a mask spans scan and frame axes")
        (scan if axis < n_scan else frame).append(p)
        axis += width
    if any(isinstance(p, np.ndarray) for p in scan) and any(isinstance(p, np.ndarray) for p in frame):
        raise IndexError("arrays on both scan and frame axes")
    return scan, frame


def _map(df: DataFrame, column: str, old: np.ndarray) -> DataFrame:
    import pandas as pd

    table = pd.DataFrame({"_old": old.ravel().astype("int32"), "_new": np.arange(old.size, dtype="int32")})
    mapping = df.sparkSession.createDataFrame(table, "_old int, _new int")
    return df.join(mapping, df[column] == mapping["_old"]).withColumn(column, F.col("_new")).drop("_old", "_new")


def _select(df: DataFrame, column: str, shape: tuple[int, ...], parts: list) -> tuple[DataFrame, tuple[int, ...]]:
    """``df`` restricted to ``parts`` of ``column``, renumbered; and the new shape."""
    if all(isinstance(p, slice) and p == slice(None) for p in parts):
        return df, shape
    if len(parts) == len(shape) and not any(isinstance(p, np.ndarray) for p in parts):
        key, new, out, width = F.col(column), F.lit(0), [], shape[-1]
        coordinates = [key] if len(shape) == 1 else [row_of(key, width), col_of(key, width)]
        low = high = 0
        for c, n, p in zip(coordinates, shape, parts):
            if isinstance(p, slice):
                own = range(*p.indices(n))
                out.append(len(own))
                if not len(own):
                    df = df.where(F.lit(False))
                    continue
                lo, hi = min(own[0], own[-1]), max(own[0], own[-1])
                if len(own) < n:
                    df = df.where((c >= lo) & (c <= hi) & (((c - own.start) % own.step) == 0))
                new = new * F.lit(len(own)) + whole(c - own.start, own.step)
            else:
                if not -n <= p < n:
                    raise IndexError(f"index {p} is out of bounds for axis of {n}")
                lo = hi = p % n
                if n > 1:
                    df = df.where(c == lo)
            low, high = low * n + lo, high * n + hi
        if 0 in out:
            return df.withColumn(column, new.cast("int")), tuple(out)
        # What the scan can read off its statistics: the first and the last flat key.
        df = df.where(key == low) if low == high else df.where((key >= low) & (key <= high))
        return df.withColumn(column, new.cast("int")), tuple(out)
    old = np.arange(math.prod(shape), dtype=np.int64).reshape(shape)
    old = old[tuple(parts)]  # checks bounds and mask shapes as numpy does
    return _map(df, column, np.asarray(old)), np.shape(old)


def take(ds: SparseDataset, key) -> SparseDataset:
    """``ds[key]`` as a dataset; axes that an int removes are gone from its shape."""
    scan, frame = _split(ds, key)
    events, scan_shape = _select(ds.events, "scan_pos", ds.scan_shape, scan)
    events, frame_shape = _select(events, "px", ds.frame_shape, frame)
    return ds.with_(events=events, scan_shape=tuple(map(int, scan_shape)), frame_shape=tuple(map(int, frame_shape)))


def drop_flyback(ds: SparseDataset) -> SparseDataset:
    """Without the last scan column of each row."""
    return ds[:, :-1] if len(ds.scan_shape) == 2 else ds


def read_frame(ds: SparseDataset, scan_pos: int) -> DataFrame:
    """The dense frame of one position: px, value."""
    if not 0 <= scan_pos < ds.num_scans:
        raise IndexError(scan_pos)
    return ds.ravel_scans()[scan_pos].densify(force=True).select("px", "value")


def pixel(ds: SparseDataset, scan_pos: int, px: int) -> DataFrame:
    """In how many frames of a position one pixel is hit."""
    return ds.events.where((F.col("scan_pos") == scan_pos) & (F.col("px") == px)).agg(F.count(F.lit(1)).alias("value"))
