"""Datasets: a long DataFrame of hits or pixels, and the shapes it lives in.

``SparseDataset.events`` has a row per hit: scan_pos INT, frame_idx INT, px INT.
``DenseDataset.pixels`` has a row per pixel: scan_pos INT, px INT, value and, where positions
hold several frames, frame_idx INT.
Both are immutable; every operation returns a new dataset and stays lazy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.pixels import col_of, row_of, whole

Shape = tuple[int, ...]


class FullExpansionDenied(Exception):
    """Raised when an operation would expand a whole dataset to dense form."""


@dataclass(frozen=True)
class SparseDataset:
    events: DataFrame
    scan_shape: Shape
    frame_shape: Shape
    #: Frames of a position: a number, or what counts them when they are asked for.
    frames: int | Callable[[], int] = 1
    metadata: dict = field(default_factory=dict, compare=False)
    allow_full_expand: bool = False
    #: Whether ``ds[key]`` is a dataset; else it is the dense cells of the selection.
    sparse_slicing: bool = True

    @property
    def num_scans(self) -> int:
        return math.prod(self.scan_shape)

    @property
    def num_pixels(self) -> int:
        return math.prod(self.frame_shape)

    @property
    def shape(self) -> Shape:
        return (*self.scan_shape, *self.frame_shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def scan_axes(self) -> Shape:
        return tuple(range(len(self.scan_shape)))

    @property
    def frame_axes(self) -> Shape:
        return tuple(range(len(self.scan_shape), self.ndim))

    @property
    def width(self) -> int:
        return self.frame_shape[-1]

    @property
    def frames_per_scan(self) -> int:
        """The most frames of any position; may run a job, once, after ``bin_frames``."""
        return self.frames() if callable(self.frames) else self.frames

    def with_(self, **changes) -> SparseDataset:
        if "frames_per_scan" in changes:
            changes["frames"] = changes.pop("frames_per_scan")
        return replace(self, **changes)

    def reshape(self, *shape) -> SparseDataset:
        """The same hits under another scan and frame shape; keys are flat and stay as they are."""
        shape = tuple(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else tuple(shape)
        if len(shape) not in (3, 4):
            raise ValueError(f"a shape has 3 or 4 axes, not {len(shape)}")
        scan, frame = shape[: len(shape) - 2], shape[-2:]
        if math.prod(scan) != self.num_scans or math.prod(frame) != self.num_pixels:
            raise ValueError(f"cannot reshape {self.shape} to {shape}")
        return self.with_(scan_shape=scan, frame_shape=frame)

    def ravel_scans(self) -> SparseDataset:
        return self.reshape(self.num_scans, *self.frame_shape)

    @property
    def scan_positions(self) -> DataFrame:
        """scan_pos of every position and its place on the scan axes; no hits are read."""
        keys = self.events.sparkSession.range(self.num_scans).select(F.col("id").cast("int").alias("scan_pos"))
        if len(self.scan_shape) == 1:
            return keys
        cols = self.scan_shape[1]
        return keys.select("scan_pos", row_of(F.col("scan_pos"), cols).alias("scan_row"), col_of(F.col("scan_pos"), cols).alias("scan_col"))

    def __getitem__(self, key) -> SparseDataset | DataFrame:
        """What numpy would select: as a dataset, or densely (scan_pos, px, value) without
        ``sparse_slicing``, which is denied for selections of whole frames of every position."""
        from .operators.indexing import take

        own = take(self, key)
        return own if self.sparse_slicing else own.densify(force=own.num_scans < self.num_scans or own.num_pixels < self.num_pixels)

    def sum(self, axis=None) -> DataFrame:
        from .operators.reductions import reduce_axes

        return reduce_axes(self, "sum", axis)

    def max(self, axis=None) -> DataFrame:
        from .operators.reductions import reduce_axes

        return reduce_axes(self, "max", axis)

    def min(self, axis=None) -> DataFrame:
        from .operators.reductions import reduce_axes

        return reduce_axes(self, "min", axis)

    def mean(self, axis=None) -> DataFrame:
        from .operators.reductions import reduce_axes

        return reduce_axes(self, "mean", axis)

    def bin_scans(self, factor: int) -> SparseDataset:
        from .operators.binning import bin_scans

        return bin_scans(self, factor)

    def bin_frames(self, factor: int) -> SparseDataset:
        from .operators.binning import bin_frames

        return bin_frames(self, factor)

    def cells(self) -> DataFrame:
        """scan_pos, px, value: how many frames of a position hold the pixel; hit cells only."""
        return self.events.groupBy("scan_pos", "px").agg(F.count(F.lit(1)).alias("value"))

    def densify(self, force: bool = False) -> DataFrame:
        """Every cell with its count, zeros included; denied for what isn't a selection."""
        if not (force or self.allow_full_expand):
            raise FullExpansionDenied(f"{self.num_scans * self.num_pixels} cells; select fewer or set allow_full_expand")
        n = self.num_pixels
        grid = self.events.sparkSession.range(self.num_scans * n).select(
            whole(F.col("id"), n).cast("int").alias("scan_pos"), (F.col("id") % n).cast("int").alias("px")
        )
        return grid.join(self.cells(), ["scan_pos", "px"], "left").select("scan_pos", "px", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    def to_dense(self) -> DataFrame:
        return self.densify(force=True)


@dataclass(frozen=True)
class DenseDataset:
    pixels: DataFrame
    scan_shape: Shape
    frame_shape: Shape

    @property
    def frame_keys(self) -> list[str]:
        """The columns that tell frames apart."""
        return ["scan_pos", "frame_idx"] if "frame_idx" in self.pixels.columns else ["scan_pos"]

    @property
    def num_scans(self) -> int:
        return math.prod(self.scan_shape)

    @property
    def num_pixels(self) -> int:
        return math.prod(self.frame_shape)

    @property
    def width(self) -> int:
        return self.frame_shape[-1]


def spine(df: DataFrame, n: int, key: str, fill: dict[str, object]) -> DataFrame:
    """``df``, one row per key, with the missing keys of 0..n-1 filled in."""
    keys = df.sparkSession.range(n).select(F.col("id").cast("int").alias(key))
    out = keys.join(df, key, "left")
    return out.select(*(F.coalesce(F.col(c), F.lit(fill[c])).cast(dict(df.dtypes)[c]).alias(c) if c in fill else F.col(c) for c in df.columns))
