"""Binning of scan positions and of frames, and upgrades of older counted formats."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import col_of, flat_of, row_of, whole
from ..model import SparseDataset


def bin_scans(ds: SparseDataset, factor: int) -> SparseDataset:
    """factor x factor positions become one; their frames stand side by side.  No shuffle."""
    if len(ds.scan_shape) != 2 or any(n % factor for n in ds.scan_shape):
        raise ValueError(f"scan shape {ds.scan_shape} is not divisible by {factor}")
    cols = ds.scan_shape[1]
    r, c = row_of(F.col("scan_pos"), cols), col_of(F.col("scan_pos"), cols)
    inside = (r % factor) * factor + c % factor
    events = ds.events.select(
        flat_of(whole(r, factor), whole(c, factor), cols // factor).alias("scan_pos"),
        (inside * ds.frames_per_scan + F.col("frame_idx")).cast("int").alias("frame_idx"),
        "px",
    )
    return ds.with_(events=events, scan_shape=(ds.scan_shape[0] // factor, cols // factor), frames_per_scan=ds.frames_per_scan * factor**2)


def _unique_per_frame(events: DataFrame, frames: int) -> DataFrame:
    """Repeats of a pixel in a frame move to extra frames of their position.

    Extra frames follow the own ones, ordered by the frame and the copy they hold.  Both windows
    work on one exchange by position.
    """
    events = events.repartition("scan_pos")
    copy = F.row_number().over(Window.partitionBy("scan_pos", "frame_idx", "px").orderBy("px")) - 1
    copied = events.withColumn("copy", copy)
    extra = F.dense_rank().over(Window.partitionBy("scan_pos", F.col("copy") > 0).orderBy("frame_idx", "copy")) - 1 + frames
    return copied.select("scan_pos", F.when(F.col("copy") == 0, F.col("frame_idx")).otherwise(extra).cast("int").alias("frame_idx"), "px")


def bin_frames(ds: SparseDataset, factor: int) -> SparseDataset:
    """factor x factor pixels become one.  ``frames_per_scan`` counts the extra frames, once it is
    asked for."""
    if len(ds.frame_shape) != 2 or any(n % factor for n in ds.frame_shape):
        raise ValueError(f"frame shape {ds.frame_shape} is not divisible by {factor}")
    w = ds.width
    px = flat_of(whole(row_of(F.col("px"), w), factor), whole(col_of(F.col("px"), w), factor), w // factor)
    events = _unique_per_frame(ds.events.withColumn("px", px), ds.frames_per_scan)

    @functools.cache
    def frames() -> int:
        most = events.agg(F.max("frame_idx")).first()[0]
        return max(ds.frames_per_scan, (most if most is not None else -1) + 1)

    return ds.with_(events=events, frame_shape=(ds.frame_shape[0] // factor, w // factor), frames_per_scan=frames)


def upgrade_v1(events: DataFrame, frames_per_scan: int = 1) -> DataFrame:
    """The first format wrote intensity as repeats in a frame; now each frame holds a pixel once."""
    return _unique_per_frame(events, frames_per_scan)


def regroup_v2(frames: DataFrame) -> DataFrame:
    """The second format listed frames in any order: (scan_pos, frame_id, px) to frame_idx."""
    index = F.dense_rank().over(Window.partitionBy("scan_pos").orderBy("frame_id")) - 1
    return frames.select("scan_pos", index.cast("int").alias("frame_idx"), "px")
