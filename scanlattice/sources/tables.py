"""Counted datasets, frames and images as Parquet, with metadata in a JSON sidecar."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import col_of, row_of
from ..model import SparseDataset
from ..operators.binning import regroup_v2, upgrade_v1
from ..operators.indexing import drop_flyback

VERSION = 3
_ARRAY = "__array__"


def _plain(value):
    """Arrays and numpy's numbers as JSON that ``_restored`` turns back, type and shape included."""
    if isinstance(value, (np.ndarray, np.generic)):
        if value.dtype.hasobject:
            raise TypeError("metadata can't hold arrays of objects")
        return {_ARRAY: [value.dtype.str, list(value.shape), base64.b64encode(np.ascontiguousarray(value).tobytes()).decode()]}
    raise TypeError(f"metadata can't hold a {type(value).__name__}")


def _restored(value: dict):
    if set(value) != {_ARRAY}:
        return value
    kind, shape, data = value[_ARRAY]
    return np.frombuffer(base64.b64decode(data), kind).reshape(shape).copy()[()]


def save_counted(ds: SparseDataset, path: str) -> None:
    """Nested rows (scan_pos, frame_idx, events), range-partitioned by position so that
    slices of the scan prune files, and the shapes and metadata beside them."""
    spark = ds.events.sparkSession
    nested = ds.events.groupBy("scan_pos", "frame_idx").agg(F.sort_array(F.collect_list("px")).alias("events"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nested.repartitionByRange(parts, "scan_pos").sortWithinPartitions("scan_pos", "frame_idx").write.mode("overwrite").parquet(f"{path}/events")
    about = {"version": VERSION, "scan_shape": list(ds.scan_shape), "frame_shape": list(ds.frame_shape), "frames_per_scan": ds.frames_per_scan, "metadata": ds.metadata}
    spark.createDataFrame([(json.dumps(about, default=_plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_counted(spark: SparkSession, path: str, keep_flyback: bool = True, **changes) -> SparseDataset:
    about = json.loads(spark.read.text(f"{path}/about").first().value, object_hook=_restored)
    nested = spark.read.parquet(f"{path}/events")
    ds = from_nested(nested, tuple(about["scan_shape"]), tuple(about["frame_shape"]), about["frames_per_scan"], about["metadata"], about["version"])
    return (ds if keep_flyback else drop_flyback(ds)).with_(**changes)


def from_nested(nested: DataFrame, scan_shape, frame_shape, frames_per_scan: int = 1, metadata: dict | None = None, version: int = VERSION) -> SparseDataset:
    """A dataset from nested rows of format 1 (repeats are intensity), 2 (frame_id) or 3."""
    if version == 2:
        return SparseDataset(regroup_v2(nested.select("scan_pos", "frame_id", F.explode("events").alias("px"))), scan_shape, frame_shape, frames_per_scan, metadata or {})
    events = nested.select("scan_pos", "frame_idx", F.explode("events").alias("px"))
    return SparseDataset(upgrade_v1(events, frames_per_scan) if version == 1 else events, scan_shape, frame_shape, frames_per_scan, metadata or {})


def save_raw(frames: DataFrame, path: str, zip_data: bool = False) -> None:
    frames.write.mode("overwrite").option("compression", "gzip" if zip_data else "none").parquet(path)


def save_images(images: DataFrame, names: Sequence[str], path: str, width: int) -> None:
    """(name, row, col, value) of stacked images; one name per image_idx."""
    n = images.select("image_idx").distinct().count()
    if n != len(names):
        raise ValueError(f"{len(names)} names for {n} images")
    named = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("image_idx") + 1)
    images.select(named.alias("name"), row_of(F.col("scan_pos"), width).alias("row"), col_of(F.col("scan_pos"), width).alias("col"), "value").write.mode("overwrite").parquet(path)


def as_data_cube(frames: DataFrame) -> DataFrame:
    """Frames keyed by scan x, then y."""
    return frames.withColumns({"x": (F.col("scan_pos") % F.col("scan_w")).cast("int"), "y": F.floor(F.col("scan_pos") / F.col("scan_w")).cast("int")})


def write_frames(frames: DataFrame, path: str, layout: str = "frame") -> None:
    if layout not in ("frame", "datacube"):
        raise ValueError(layout)
    (frames if layout == "frame" else as_data_cube(frames)).write.mode("overwrite").parquet(path)
