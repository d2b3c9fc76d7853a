"""Centre of mass and differential phase contrast."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import col_of, row_of
from ..model import DenseDataset, SparseDataset


def _means(events: DataFrame, w: int) -> DataFrame:
    return events.groupBy("scan_pos").agg(
        (F.sum(col_of(F.col("px"), w)) / F.count(F.lit(1))).alias("com_x"), (F.sum(row_of(F.col("px"), w)) / F.count(F.lit(1))).alias("com_y")
    )


def com_sparse(ds: SparseDataset, crop_to: float | tuple | None = None, init_center: tuple[float, float] | None = None, replace_nans: bool = True) -> DataFrame:
    """scan_pos, com_x (column), com_y (row) of every scan position.

    With ``crop_to``, hits farther than that from the first centre (or from ``init_center``,
    as x and y) are left out.  Positions without hits are null, or the mean of the others.
    """
    events, w = ds.events, ds.width
    if crop_to is not None:
        most = max(crop_to) if isinstance(crop_to, (tuple, list)) else crop_to
        if init_center is not None:
            x, y = (F.lit(float(v)) for v in init_center)
        else:
            events = events.join(_means(events, w), "scan_pos")
            x, y = F.col("com_x"), F.col("com_y")
        dx, dy = col_of(F.col("px"), w) - x, row_of(F.col("px"), w) - y
        events = events.where(F.sqrt(dx * dx + dy * dy) <= F.lit(float(most)))
    found = _means(events.select("scan_pos", "px"), w)
    keys = found.sparkSession.range(ds.num_scans).select(F.col("id").cast("int").alias("scan_pos"))
    out = keys.join(found, "scan_pos", "left").select("scan_pos", "com_x", "com_y")
    if not replace_nans:
        return out
    mean = found.agg(F.avg("com_x").alias("mean_x"), F.avg("com_y").alias("mean_y"))  # one row
    return out.join(F.broadcast(mean)).select("scan_pos", F.coalesce("com_x", "mean_x").alias("com_x"), F.coalesce("com_y", "mean_y").alias("com_y"))


def com_dense(ds: DenseDataset) -> DataFrame:
    """scan_pos, com_x, com_y weighed by intensity; null where a frame sums to zero."""
    v, w = F.col("value"), ds.width
    total = F.sum(v)
    mean = lambda c: F.when(total != 0, F.sum(c * v) / total)
    return ds.pixels.groupBy("scan_pos").agg(mean(col_of(F.col("px"), w)).alias("com_x"), mean(row_of(F.col("px"), w)).alias("com_y"))


def rotate(com: DataFrame, theta: float, flip: bool = False) -> DataFrame:
    """The centres rotated by ``theta`` radians, the second component negated first if ``flip``."""
    x, y = F.col("com_x"), -F.col("com_y") if flip else F.col("com_y")
    c, s = math.cos(theta), math.sin(theta)
    return com.select("scan_pos", (x * F.lit(c) - y * F.lit(s)).alias("com_x"), (x * F.lit(s) + y * F.lit(c)).alias("com_y"))


def polar(com: DataFrame) -> DataFrame:
    """scan_pos, radius, angle of each centre about the mean centre."""
    mean = com.agg(F.avg("com_x").alias("mx"), F.avg("com_y").alias("my"))  # one row
    dx, dy = F.col("com_x") - F.col("mx"), F.col("com_y") - F.col("my")
    return com.join(F.broadcast(mean)).select("scan_pos", F.sqrt(dx * dx + dy * dy).alias("radius"), F.atan2(dy, dx).alias("angle"))


def outliers(com: DataFrame, low: float, high: float) -> DataFrame:
    """scan_pos, bad: whether the row component is outside [low, high]; nulls are not."""
    return com.select("scan_pos", F.coalesce((F.col("com_y") < low) | (F.col("com_y") > high), F.lit(False)).alias("bad"))


def _grid(pdf: pd.DataFrame, shape: tuple[int, int], columns: list[str]) -> list[np.ndarray]:
    out = []
    for c in columns:
        a = np.full(shape[0] * shape[1], np.nan)
        a[pdf["scan_pos"].to_numpy()] = pdf[c].to_numpy(dtype=float)
        out.append(a.reshape(shape))
    return out


def _on_image(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the whole image, one row per scan position: a result of the size of one
    scan, for what is sequential or needs every position at once."""

    def every(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(pdfs)
        if parts and sum(map(len, parts)):
            yield run(pd.concat(parts))

    return df.repartition(1).mapInPandas(every, schema)  # coalesce would drag what computes it into the one task


def repair_outliers(com: DataFrame, shape: tuple[int, int], low: float, high: float) -> DataFrame:
    """Outliers take the median of their 3x3 neighbourhood, one after the other in row order.

    In the first row and column the neighbourhood is empty and the result null.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _grid(pdf, shape, ["com_x", "com_y"])
        bad = (y < low) | (y > high)
        x[bad], y[bad] = np.nan, np.nan
        for r, c in np.argwhere(bad):
            for a in (x, y):
                near = a[r - 1 : r + 2, c - 1 : c + 2] if r and c else a[:0]
                near = near[~np.isnan(near)]
                a[r, c] = np.median(near) if near.size else np.nan
        return pd.DataFrame({"scan_pos": np.arange(x.size, dtype="int32"), "com_x": x.ravel(), "com_y": y.ravel()})

    return _on_image(com, run, "scan_pos int, com_x double, com_y double")


def phase(com: DataFrame, shape: tuple[int, int], theta: float = 0.0, flip: bool = False, reg: float = 1e-10) -> DataFrame:
    """scan_pos, phase: Fourier integration of the centres as a gradient field.

    The first component goes with the first scan axis; a null centre makes the phase NaN.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = map(np.fft.fft2, _grid(pdf, shape, ["com_x", "com_y"]))
        k0, k1 = np.fft.fftfreq(shape[0])[:, None], np.fft.fftfreq(shape[1])[None, :]
        spectrum = (k0 * first + k1 * second) / (2j * np.pi * (k0**2 + k1**2) + reg)
        spectrum[0, 0] = 0
        return pd.DataFrame({"scan_pos": np.arange(shape[0] * shape[1], dtype="int32"), "phase": np.fft.ifft2(spectrum).real.ravel()})

    return _on_image(rotate(com, theta, flip), run, "scan_pos int, phase double")


def median_filter(image: DataFrame, shape: tuple[int, int], size: int = 5) -> DataFrame:
    """scan_pos, value: the median of the size x size neighbourhood, edges repeated."""
    half = size // 2
    h, w = shape
    offsets = F.array(*(F.lit(i) for i in range(-half, half + 1)))
    # A value goes to every cell that looks at it; edge cells look at the clamped place.
    r, c = row_of(F.col("scan_pos"), w), col_of(F.col("scan_pos"), w)
    cells = image.select(r.alias("r"), c.alias("c")).select("r", "c", F.explode(offsets).alias("dr")).select("r", "c", "dr", F.explode(offsets).alias("dc"))
    looks = cells.select("r", "c", (F.greatest(F.lit(0), F.least(F.lit(h - 1), F.col("r") + F.col("dr"))) * w + F.greatest(F.lit(0), F.least(F.lit(w - 1), F.col("c") + F.col("dc")))).cast("int").alias("scan_pos"))
    return looks.join(image, "scan_pos").groupBy((F.col("r") * w + F.col("c")).cast("int").alias("scan_pos")).agg(F.median("value").alias("value"))


def plane_fit(image: DataFrame, width: int) -> DataFrame:
    """a, b, c of value = a * column + b * row + c by least squares, from ten sums."""
    x, y, v = col_of(F.col("scan_pos"), width).cast("double"), row_of(F.col("scan_pos"), width).cast("double"), F.col("value").cast("double")
    s = image.where("value is not null").agg(
        F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumns({"a": (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det, "b": (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det})
    return s.select("a", "b", (F.col("mv") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))
