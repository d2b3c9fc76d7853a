"""Electron counting: thresholds from sampled frames, then local maxima of every frame.

Relational form, for frames of any size that fit a table of pixels: dark and gain are an
equi-join on the pixel, thresholds a predicate, maxima two windows over one partitioning.
Kernel form, for frames stored as binary rows: the same steps in numpy, one frame at a time,
inside ``mapInArrow``; 576 x 576 frames are never exploded.

Frames are told apart by scan_pos and, where it is there, frame_idx.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import col_of, row_of, wrap_u16
from ..model import DenseDataset, SparseDataset


def _keys(pixels: DataFrame) -> list[str]:
    return [c for c in ("scan_pos", "frame_idx") if c in pixels.columns]


@dataclass(frozen=True)
class Thresholds:
    """What the fit found; ``xray`` and ``background`` bound a hit, both exclusive."""

    background: float
    xray: float
    minimum: float = 0.0
    maximum: float = 0.0
    mean: float = 0.0
    variance: float = 0.0
    std_dev: float = 0.0
    optimized_mean: float = 0.0
    optimized_std_dev: float = 0.0


def sample_frames(pixels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The pixels of ``n`` frames, chosen by a seeded hash: the same frames every time."""
    keys = _keys(pixels)
    chosen = pixels.select(*keys).distinct().orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
    return pixels.join(chosen, keys, "left_semi")


def corrected(pixels: DataFrame, dark: DataFrame | None = None, gain: DataFrame | None = None) -> DataFrame:
    """Value minus dark, divided by gain.  Without gain, values are unsigned 16-bit and wrap."""
    out = pixels
    if dark is not None:
        out = out.join(dark.select("px", "dark"), "px")
        out = out.withColumn("value", F.col("value") - F.col("dark") if gain is not None else wrap_u16(F.col("value") - F.col("dark").cast("long")))
    if gain is not None:
        out = out.join(gain.select("px", "gain"), "px").withColumn("value", F.col("value") / F.col("gain"))
    return out.select(*pixels.columns)


def thresholded(pixels: DataFrame, background: float, xray: float) -> DataFrame:
    """Values at or outside the bounds become zero."""
    inside = (F.col("value") > background) & (F.col("value") < xray)
    return pixels.withColumn("value", F.when(inside, F.col("value")).otherwise(F.lit(0)))


def statistics(pixels: DataFrame) -> DataFrame:
    """One row: minimum, maximum, mean, sample variance and deviation, n."""
    return pixels.agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("std_dev")
    )


def histogram(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """bin, count over unit bins low <= value < high, empty bins included."""
    found = pixels.where((F.col("value") >= low) & (F.col("value") < high)).groupBy(F.floor("value").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = pixels.sparkSession.range(low, high).select(F.col("id").cast("int").alias("bin"))
    return spine.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def gaussian_fit(x: np.ndarray, y: np.ndarray, mean: float, std: float, rounds: int = 200) -> tuple[float, float, float]:
    """(amplitude, mean, deviation) by damped least squares (Levenberg-Marquardt)."""
    p = np.array([float(y.max()), mean, std])
    residual = lambda p: p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2)) - y
    r, damping = residual(p), 1e-3
    for _ in range(rounds):
        e = np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))
        j = np.column_stack([e, p[0] * e * (x - p[1]) / p[2] ** 2, p[0] * e * (x - p[1]) ** 2 / p[2] ** 3])
        a, g = j.T @ j, j.T @ r
        try:
            step = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), -g)
        except np.linalg.LinAlgError as error:
            raise RuntimeError("the Gaussian fit did not converge") from error
        new = residual(p + step)
        if (new**2).sum() < (r**2).sum():
            small = np.abs(step).max() < 1e-10 * (1 + np.abs(p).max())
            p, r, damping = p + step, new, damping / 3
            if small:
                break
        else:
            damping *= 4
            if damping > 1e12:  # no step improves: a minimum if the residual is square to all slopes
                if (np.abs(g) > 1e-4 * np.sqrt(np.diag(a) * (r**2).sum())).any():
                    raise RuntimeError("the Gaussian fit did not converge")
                break
    if not np.isfinite(p).all():
        raise RuntimeError("the Gaussian fit did not converge")
    return float(p[0]), float(p[1]), abs(float(p[2]))


def bin_range(minimum: float, maximum: float, mean: float, std: float, xray: float) -> tuple[int, int]:
    """First unit bin and the one after the last.

    Fixed rule of the format: the x-ray *threshold* times the deviation about the mean, within
    the least and the greatest value.
    """
    low, high = max(int(minimum), int(mean - xray * std)), min(math.ceil(maximum), int(mean + xray * std))
    return low, max(low + 1, high)


def _fitted(bins: np.ndarray, counts: np.ndarray, minimum: float, maximum: float, mean: float, variance: float, background_sigma: float, xray_sigma: float) -> Thresholds:
    std = math.sqrt(variance)
    _, center, sigma = gaussian_fit(bins.astype(float), counts.astype(float), mean, max(std, 1e-6))
    return Thresholds(center + background_sigma * sigma, mean + xray_sigma * std, minimum, maximum, mean, variance, std, center, sigma)


def thresholds(sampled: DataFrame, background_sigma: float = 4, xray_sigma: float = 10) -> Thresholds:
    """Fits the noise peak of sampled, corrected pixels.  A histogram reaches the driver: one
    row per unit bin within the limits."""
    s = statistics(sampled).first()
    if not s.n:
        raise ValueError("no frames to take thresholds from")
    mean, variance = float(s["mean"]), float(s.variance or 0.0)
    std = math.sqrt(variance)
    low, high = bin_range(float(s.minimum), float(s.maximum), mean, std, mean + xray_sigma * std)
    rows = histogram(sampled, low, high).orderBy("bin").collect()
    x, y = np.array([r.bin for r in rows]), np.array([r["count"] for r in rows])
    return _fitted(x, y, float(s.minimum), float(s.maximum), mean, variance, background_sigma, xray_sigma)


def row_dark(pixels: DataFrame, width: int, mean: float, use_mean: bool = True, dark: DataFrame | None = None, gain: DataFrame | None = None) -> DataFrame:
    """Scales each half row of a frame so that the mean (or median) of its values as they were
    read is ``mean``; zero where that is zero.

    The dark reference is subtracted, and the gain applied, after the half row's own is taken.
    """
    keys = _keys(pixels)
    half = (col_of(F.col("px"), width) >= width // 2).cast("int")
    keyed = pixels.withColumns({"_row": row_of(F.col("px"), width), "_half": half})
    own = Window.partitionBy(*keys, "_row", "_half")
    met = keyed.withColumn("_stat", (F.avg("value") if use_mean else F.median("value")).over(own))
    met = corrected(met, dark, gain)
    return met.select(*keys, "px", F.when(F.col("_stat") != 0, F.col("value") * F.lit(float(mean)) / F.col("_stat")).otherwise(0.0).alias("value"))


def local_maxima(pixels: DataFrame, shape: tuple[int, int], floor: float | None = 0.0) -> DataFrame:
    """The frame's keys and px of the pixels that are greater than all neighbours in the frame.

    Each row's three-wide maximum is taken first, then compared up and down.  Both windows
    share the one partitioning by frame.
    """
    h, w = shape
    keys = _keys(pixels)
    keyed = pixels.select(*keys, "px", F.col("value").cast("double").alias("v"), row_of(F.col("px"), w).alias("r"), col_of(F.col("px"), w).alias("c"))
    least = F.lit(float("-inf"))
    keyed = keyed.repartition(*keys)
    along, down = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    keyed = keyed.withColumns({"left": F.coalesce(F.lag("v").over(along), least), "right": F.coalesce(F.lead("v").over(along), least)})
    keyed = keyed.withColumn("three", F.greatest("v", "left", "right"))
    keyed = keyed.withColumns({"up": F.coalesce(F.lag("three").over(down), least), "low": F.coalesce(F.lead("three").over(down), least)})
    top = (F.col("v") > F.col("left")) & (F.col("v") > F.col("right")) & (F.col("v") > F.col("up")) & (F.col("v") > F.col("low"))
    return keyed.where(top if floor is None else top & (F.col("v") > floor)).select(*keys, "px")


def electron_count(ds: DenseDataset, limits: Thresholds | None = None, dark: DataFrame | None = None, gain: DataFrame | None = None, samples: int = 40, seed: int = 0, background_sigma: float = 4, xray_sigma: float = 10, apply_row_dark: bool = False, use_mean: bool = True) -> SparseDataset:
    """Counts a table of pixels: correct, threshold, local maxima.

    Without gain, values are unsigned 16-bit at every step, so scaled ones lose their fraction.
    """
    if limits is None:
        limits = thresholds(corrected(sample_frames(ds.pixels, samples, seed), dark, gain), background_sigma, xray_sigma)
    if apply_row_dark:
        own = row_dark(ds.pixels, ds.width, limits.optimized_mean or limits.mean, use_mean, dark, gain)
        if gain is None:
            own = own.withColumn("value", wrap_u16(F.floor("value")))
    else:
        own = corrected(ds.pixels, dark, gain)
    hits = local_maxima(thresholded(own, limits.background, limits.xray), ds.frame_shape, 0.0 if limits.background >= 0 else None)
    index = F.col("frame_idx") if "frame_idx" in hits.columns else F.lit(0)
    events = hits.select("scan_pos", index.cast("int").alias("frame_idx"), "px")

    @functools.cache
    def frames() -> int:
        return int(ds.pixels.agg(F.max("frame_idx")).first()[0] or 0) + 1

    return SparseDataset(events, ds.scan_shape, ds.frame_shape, frames if "frame_idx" in ds.pixels.columns else 1, {"thresholds": limits.__dict__})


def peaks(frame: np.ndarray) -> np.ndarray:
    """Flat places of the strict local maxima of a frame."""
    padded = np.full((frame.shape[0] + 2, frame.shape[1] + 2), -np.inf)
    padded[1:-1, 1:-1] = frame
    around = [padded[1 + dr : 1 + dr + frame.shape[0], 1 + dc : 1 + dc + frame.shape[1]] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    return np.flatnonzero((frame > np.maximum.reduce(around)).ravel())


def corrected_frame(frame: np.ndarray, dark: np.ndarray | None = None, gain: np.ndarray | None = None) -> np.ndarray:
    """``corrected`` for one stored frame."""
    if gain is not None:
        return (frame.astype(np.float64) - (0 if dark is None else dark)) / gain
    return (frame if dark is None else (frame.astype(np.int64) - dark.astype(np.int64)) % 65536).astype(np.float64)


def count_frame(frame: np.ndarray, limits: Thresholds, dark: np.ndarray | None = None, gain: np.ndarray | None = None, row_dark_mean: bool | None = None) -> np.ndarray:
    """The hits of one frame of unsigned 16-bit values."""
    out = corrected_frame(frame, dark, gain)
    if row_dark_mean is not None:
        half = frame.shape[1] // 2
        for part in (slice(0, half), slice(half, None)):
            own = frame[:, part].astype(np.float64)
            stat = (own.mean(axis=1) if row_dark_mean else np.median(own, axis=1))[:, None]
            out[:, part] = np.divide(out[:, part] * (limits.optimized_mean or limits.mean), stat, out=np.zeros_like(out[:, part]), where=stat != 0)
        if gain is None:
            out = np.floor(out) % 65536
    out[(out <= limits.background) | (out >= limits.xray)] = 0
    found = peaks(out)
    return found[out.ravel()[found] > 0] if limits.background >= 0 else found


def count_frames(frames: DataFrame, limits: Thresholds, dark: np.ndarray | None = None, gain: np.ndarray | None = None, row_dark_mean: bool | None = None) -> DataFrame:
    """scan_pos, frame_num, events of binary frames (frame_h, frame_w, data), by the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, num, hits = [], [], []
            for i in range(batch.num_rows):
                h, w = batch.column("frame_h")[i].as_py(), batch.column("frame_w")[i].as_py()
                frame = np.frombuffer(batch.column("data")[i].as_buffer(), "<u2").reshape(h, w)
                pos.append(batch.column("scan_pos")[i].as_py())
                num.append(batch.column("frame_num")[i].as_py())
                hits.append(count_frame(frame, limits, dark, gain, row_dark_mean).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"scan_pos": pa.array(pos, pa.int32()), "frame_num": pa.array(num, pa.int64()), "events": pa.array(hits, pa.list_(pa.int32()))})

    return frames.select("scan_pos", "frame_num", "frame_h", "frame_w", "data").mapInArrow(run, "scan_pos int, frame_num long, events array<int>")


def number_frames(counted: DataFrame) -> DataFrame:
    """scan_pos, frame_idx, px: frames of a position numbered by frame_num, hits exploded."""
    index = F.row_number().over(Window.partitionBy("scan_pos").orderBy("frame_num")) - 1
    return counted.withColumn("frame_idx", index.cast("int")).select("scan_pos", "frame_idx", F.explode("events").alias("px"))


def _sampled(frames: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` stored frames, complete ones only, chosen by a seeded hash of their keys.

    The keys are chosen without the pixel data; at most ``n`` of them reach the driver, and go
    back to the scan as a predicate.
    """
    whole = frames.where("complete") if "complete" in frames.columns else frames
    keys = whole.select("scan_pos", "frame_num").orderBy(F.xxhash64("scan_pos", "frame_num", F.lit(seed)), "scan_pos", "frame_num").limit(n).collect()
    if not keys:
        raise ValueError("no complete frames to take thresholds from")
    either = functools.reduce(lambda a, b: a | b, ((F.col("scan_pos") == k.scan_pos) & (F.col("frame_num") == k.frame_num) for k in keys))
    return whole.where(F.col("frame_num").isin([k.frame_num for k in keys]) & either)


def thresholds_of_frames(frames: DataFrame, samples: int = 40, dark: np.ndarray | None = None, gain: np.ndarray | None = None, background_sigma: float = 4, xray_sigma: float = 10, seed: int = 0) -> Thresholds:
    """``thresholds`` of sampled stored frames.

    Each frame becomes a histogram of unit bins, with the sums that the statistics need, where
    it is read; the bins, as many as values fit 16 bits, are added up and reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column("frame_h")[i].as_py(), batch.column("frame_w")[i].as_py()
                v = corrected_frame(np.frombuffer(batch.column("data")[i].as_buffer(), "<u2").reshape(h, w), dark, gain).ravel()
                bins, at = np.unique(np.floor(v).astype(np.int64), return_inverse=True)
                least, most = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
                yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "n": pa.array(np.bincount(at)), "s": pa.array(np.bincount(at, v)), "ss": pa.array(np.bincount(at, v * v)), "least": pa.array(least), "most": pa.array(most)})

    found = _sampled(frames, samples, seed).select("frame_h", "frame_w", "data").mapInArrow(run, "bin long, n long, s double, ss double, least double, most double")
    rows = found.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("bin").toPandas()
    n, mean = int(rows.n.sum()), float(rows.s.sum() / rows.n.sum())
    variance = max(0.0, float((rows.ss.sum() - n * mean * mean) / max(1, n - 1)))
    minimum, maximum = float(rows.least.min()), float(rows.most.max())
    std = math.sqrt(variance)
    low, high = bin_range(minimum, maximum, mean, std, mean + xray_sigma * std)
    counts = dict(zip(rows["bin"], rows["n"]))
    bins = np.arange(low, high)
    return _fitted(bins, np.array([counts.get(b, 0) for b in bins.tolist()]), minimum, maximum, mean, variance, background_sigma, xray_sigma)


def electron_count_frames(frames: DataFrame, dark: np.ndarray | None = None, gain: np.ndarray | None = None, limits: Thresholds | None = None, scan_shape: tuple[int, int] | None = None, samples: int = 40, seed: int = 0, background_sigma: float = 4, xray_sigma: float = 10, row_dark_mean: bool | None = None) -> SparseDataset:
    """Stored frames to a counted dataset: sample, fit, count, number the frames of a position.

    ``frames``: what ``sources.raw.reader`` gives.  Thresholds come from complete frames; partial
    ones are counted as well.  ``row_dark_mean``: whether row darks are means (or medians); None
    for no row dark.  The scan's shape is taken from a header where it isn't given.
    """
    if limits is None:
        limits = thresholds_of_frames(frames, samples, dark, gain, background_sigma, xray_sigma, seed)
    head = frames.select("scan_h", "scan_w", "frame_h", "frame_w").first() if scan_shape is None else frames.select("frame_h", "frame_w").first()
    if head is None:
        raise ValueError("no frames to count")
    shape = scan_shape or (head.scan_h, head.scan_w)
    if not all(shape):
        raise ValueError("these frames don't say what shape their scan has; pass scan_shape")
    events = number_frames(count_frames(frames, limits, dark, gain, row_dark_mean))

    @functools.cache
    def most() -> int:
        return int(frames.groupBy("scan_pos").count().agg(F.max("count")).first()[0] or 0)

    about = {"samples": samples, "background_sigma": background_sigma, "xray_sigma": xray_sigma, **limits.__dict__}
    return SparseDataset(events, tuple(shape), (head.frame_h, head.frame_w), most, {"electron_counting": about})
