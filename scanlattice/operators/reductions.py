"""Sum, max, min and mean over any subset of the axes, zeros included but never stored.

One aggregation for sums, two for extremes (frames of a position are added up first).  What
no frame hits is zero: a group that has fewer hit cells than cells has a least of zero, and
groups without hits come from a spine of the kept axes.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import whole
from ..model import SparseDataset
from ..model import spine as filled

NAMES = ("scan_row", "scan_col", "frame_row", "frame_col")


def normalize_axis(axis, ndim: int, n_scan: int) -> tuple[int, ...]:
    """The axes that 'scan', 'frame', None, an int or a tuple of ints stand for."""
    if axis is None:
        return tuple(range(ndim))
    if axis == "scan":
        return tuple(range(n_scan))
    if axis == "frame":
        return tuple(range(n_scan, ndim))
    axes = [operator.index(a) for a in (axis if isinstance(axis, Iterable) else (axis,))]
    if any(not -ndim <= a < ndim for a in axes):
        raise IndexError(f"axis {axis} is out of bounds for {ndim} axes")
    out = sorted({a % ndim for a in axes})
    if len(out) != len(axes):
        raise ValueError(f"repeated axis in {axis}")
    return tuple(out)


def _unravel(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    out, step = [], math.prod(shape)
    for n in shape:
        step //= n
        out.append((whole(flat, step) % F.lit(n)).cast("int"))
    return out


def _names(ds: SparseDataset) -> list[str]:
    scan = ["scan_pos"] if len(ds.scan_shape) == 1 else list(NAMES[:2])
    frame = ["px"] if len(ds.frame_shape) == 1 else list(NAMES[2:])
    return scan + frame


def reduce_axes(ds: SparseDataset, how: str, axis=None) -> DataFrame:
    """A row per cell of the kept axes, with ``value``.

    Whole scan or frame axes stay flat (scan_pos, px); other kept axes are columns of their own.
    """
    reduced = normalize_axis(axis, ds.ndim, len(ds.scan_shape))
    kept = [a for a in range(ds.ndim) if a not in reduced]
    length = math.prod(ds.shape[a] for a in reduced)
    keys: dict[str, tuple[Column, int]] = {}
    if tuple(kept) == ds.frame_axes:
        keys["px"] = (F.col("px"), ds.num_pixels)
    elif tuple(kept) == ds.scan_axes:
        keys["scan_pos"] = (F.col("scan_pos"), ds.num_scans)
    else:
        every = _unravel(F.col("scan_pos"), ds.scan_shape) + _unravel(F.col("px"), ds.frame_shape)
        names = _names(ds)
        keys = {names[a]: (every[a], ds.shape[a]) for a in kept}
    group = [c.alias(n) for n, (c, _) in keys.items()]
    if how in ("sum", "mean"):
        found = ds.events.groupBy(*group).agg(F.count(F.lit(1)).alias("value"))
        if how == "mean":
            found = found.withColumn("value", F.col("value") / F.lit(float(length)))
    elif how == "max":
        found = ds.cells().groupBy(*group).agg(F.max("value").alias("value"))
    elif how == "min":
        found = ds.cells().groupBy(*group).agg(F.when(F.count(F.lit(1)) < length, F.lit(0)).otherwise(F.min("value")).cast("long").alias("value"))
    else:
        raise ValueError(how)
    zero = F.lit(0.0) if how == "mean" else F.lit(0).cast("long")
    if not keys:
        return found.select(F.coalesce("value", zero).alias("value"))
    n = math.prod(k for _, k in keys.values())
    spine = ds.events.sparkSession.range(n)
    spine = spine.select(*(c.alias(name) for name, c in zip(keys, _unravel(F.col("id"), tuple(k for _, k in keys.values())))))
    return spine.join(found, list(keys), "left").select(*keys, F.coalesce("value", zero).alias("value"))


def global_stats(ds: SparseDataset) -> DataFrame:
    """sum, min, max, mean over all cells in one pass."""
    total = ds.num_scans * ds.num_pixels
    got = ds.cells().agg(F.coalesce(F.sum("value"), F.lit(0)).alias("sum"), F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return got.select(
        "sum",
        F.when(F.col("n") < total, F.lit(0)).otherwise(F.col("least")).cast("long").alias("min"),
        F.coalesce("most", F.lit(0)).cast("long").alias("max"),
        (F.col("sum") / F.lit(float(total))).alias("mean"),
    )


def sum_sparse(ds: SparseDataset) -> DataFrame:
    """px, value: hits per pixel over all positions and frames, in one combined aggregation."""
    found = ds.events.groupBy("px").agg(F.count(F.lit(1)).alias("value"))
    return filled(found, ds.num_pixels, "px", {"value": 0})


def dose(ds: SparseDataset) -> DataFrame:
    """Mean number of hits per diffraction frame."""
    return ds.events.agg((F.count(F.lit(1)) / F.lit(float(ds.num_scans * ds.frames_per_scan))).alias("dose"))


def sum_scans(*scans: SparseDataset) -> SparseDataset:
    """Several scans of the same region: the frames of a position side by side."""
    if len({(s.scan_shape, s.frame_shape) for s in scans}) != 1:
        raise ValueError("scans differ in shape")
    before, parts = 0, []
    for s in scans:
        parts.append(s.events.withColumn("frame_idx", (F.col("frame_idx") + before).cast("int")))
        before += s.frames_per_scan
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return scans[0].with_(events=out, frames_per_scan=before)
