"""Virtual detectors: images over scan positions and profiles over the frame.

Masks are never built; an annulus is a predicate on the squared distance.  Several detectors
are conditional sums of one aggregation over the events, not joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import center_of, col_of, distance2, in_annulus, row_of
from ..model import DenseDataset, SparseDataset, spine

#: What one hit adds to a sparse image: the mask's value.
MASK = 65535


def _radii(inner, outer) -> list[tuple[float, float]]:
    as_list = lambda x: list(x) if isinstance(x, Sequence) else [x]
    inner, outer = as_list(inner), as_list(outer)
    if not inner or len(inner) != len(outer):
        raise ValueError("inner and outer radii must be of one length, and not empty")
    return list(zip(inner, outer))


def _stacked(df: DataFrame, n: int) -> DataFrame:
    """(scan_pos, v0, v1, ...) as (image_idx, scan_pos, value)."""
    images = F.posexplode(F.array(*(F.col(f"v{i}") for i in range(n)))).alias("image_idx", "value")
    return df.select("scan_pos", images).select(F.col("image_idx").cast("int").alias("image_idx"), "scan_pos", "value")


def stem_images(ds: SparseDataset, inner, outer, center=None, weight: int = MASK) -> DataFrame:
    """image_idx, scan_pos, value: ``weight`` per hit inside each annulus."""
    radii, c = _radii(inner, outer), center_of(ds.frame_shape, center)
    sums = [F.sum(F.when(in_annulus(F.col("px"), ds.width, c, i, o), weight).otherwise(0)).cast("long").alias(f"v{k}") for k, (i, o) in enumerate(radii)]
    found = ds.events.groupBy("scan_pos").agg(*sums)
    return _stacked(spine(found, ds.num_scans, "scan_pos", {f"v{k}": 0 for k in range(len(radii))}), len(radii))


def stem_images_dense(ds: DenseDataset, inner, outer, center=None) -> DataFrame:
    """image_idx, scan_pos, value: the sum of the pixels inside each annulus.

    Of several frames of a position the last one counts; positions without a frame are zero,
    if the dataset knows how many there are.
    """
    radii, c = _radii(inner, outer), center_of(ds.frame_shape, center)
    names = [f"v{k}" for k in range(len(radii))]
    sums = [F.sum(F.when(in_annulus(F.col("px"), ds.width, c, i, o), F.col("value")).otherwise(0)).cast("long").alias(v) for v, (i, o) in zip(names, radii)]
    found = ds.pixels.groupBy(*ds.frame_keys).agg(*sums)
    if "frame_idx" in ds.frame_keys:
        found = found.groupBy("scan_pos").agg(*(F.max_by(v, "frame_idx").alias(v) for v in names))
    return _stacked(spine(found, ds.num_scans, "scan_pos", dict.fromkeys(names, 0)) if ds.num_scans else found, len(radii))


def stem_histogram(images: DataFrame, bins: int) -> DataFrame:
    """image_idx, bin, lower, count: equal bins from the least to the greatest value.

    Bins hold their lower edge, the last one both; a constant image is all in the last bin.
    """
    edges = images.groupBy("image_idx").agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    guess = F.when(F.col("hi") == F.col("lo"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / step))).cast("int")
    edge = lambda k: F.col("lo") + k * step
    # Rounding can put a value next to an edge one bin off; the edges themselves decide.
    exact = F.when((F.col("value") < edge(F.col("g"))) & (F.col("g") > 0), F.col("g") - 1).when((F.col("g") < bins - 1) & (F.col("value") >= edge(F.col("g") + 1)), F.col("g") + 1).otherwise(F.col("g"))
    found = images.join(edges, "image_idx").withColumn("g", guess).groupBy("image_idx", exact.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = edges.select("image_idx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", step.alias("step"))
    return every.join(found, ["image_idx", "bin"], "left").select(
        "image_idx", "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("lower"), F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def average_frame(ds: DenseDataset, n_frames: int | None = None) -> DataFrame:
    """px, value: the mean frame."""
    return ds.pixels.groupBy("px").agg((F.sum("value") / (F.lit(float(n_frames)) if n_frames else F.count(F.lit(1)))).alias("value"))


def max_pattern(ds: DenseDataset, dark: DataFrame | None = None) -> DataFrame:
    """px, value: the greatest value of each pixel, then minus its dark value."""
    found = ds.pixels.groupBy("px").agg(F.max("value").cast("double").alias("value"))
    if dark is None:
        return found
    return found.join(dark.select("px", "dark"), "px").select("px", (F.col("value") - F.col("dark")).alias("value"))


def radial_dense(ds: DenseDataset, center=None) -> DataFrame:
    """scan_pos, radius, value: sums over rings of ceil(distance), hit rings only."""
    c = center_of(ds.frame_shape, center)
    ring = F.ceil(F.sqrt(distance2(F.col("px"), ds.width, c))).cast("int")
    return ds.pixels.groupBy("scan_pos", ring.alias("radius")).agg(F.sum("value").cast("long").alias("value"))


def radii_of(frame_shape: tuple[int, int], center=None) -> int:
    """How many rings ``radial_dense`` can fill: to the farthest corner of the frame."""
    h, w = frame_shape
    x, y = center_of(frame_shape, center)
    return math.ceil(max(math.hypot(x - a, y - b) for a in (0, w) for b in (0, h))) + 1


def radial_sparse(ds: SparseDataset, center=None) -> DataFrame:
    """scan_pos, radius, value: hits by floor(distance) up to half the frame; the last bin is
    closed, farther hits are left out.  ``center`` is (row, column)."""
    h, w = ds.frame_shape
    y, x = center if center is not None else (h / 2, w / 2)
    n = int(max(h, w) / 2)
    r = F.sqrt(F.pow(row_of(F.col("px"), w) - F.lit(float(y)), 2) + F.pow(col_of(F.col("px"), w) - F.lit(float(x)), 2))
    ring = F.when(F.col("r") == n, n - 1).otherwise(F.floor("r")).cast("int")
    return ds.events.withColumn("r", r).where(F.col("r") <= n).groupBy("scan_pos", ring.alias("radius")).agg(F.count(F.lit(1)).alias("value"))


def radial_band(radial: DataFrame, low: int, high: int, n_scans: int) -> DataFrame:
    """scan_pos, value: the image of the rings low <= radius < high."""
    found = radial.where((F.col("radius") >= low) & (F.col("radius") < high)).groupBy("scan_pos").agg(F.sum("value").cast("long").alias("value"))
    return spine(found, n_scans, "scan_pos", {"value": 0})


def virtual_darkfield(ds: SparseDataset, centers_x, centers_y, radii) -> DataFrame:
    """scan_pos, value: hits strictly inside each aperture, added up; overlaps count twice."""
    as_list = lambda x: list(x) if isinstance(x, Sequence) else [x]
    apertures = list(zip(as_list(centers_x), as_list(centers_y), as_list(radii), strict=True))
    inside = sum(((distance2(F.col("px"), ds.width, (x, y)) < F.lit(r * r)).cast("int") for x, y, r in apertures), F.lit(0))
    found = ds.events.groupBy("scan_pos").agg(F.sum(inside).cast("long").alias("value"))
    return spine(found, ds.num_scans, "scan_pos", {"value": 0})


def mask_real_space(ds: SparseDataset, positions: DataFrame) -> DataFrame:
    """px, value: the diffraction pattern of the given scan positions (a semi-join)."""
    found = ds.events.join(positions.select("scan_pos").distinct(), "scan_pos", "left_semi").groupBy("px").agg(F.count(F.lit(1)).alias("value"))
    return spine(found, ds.num_pixels, "px", {"value": 0})


def threshold_positions(image: DataFrame, above: float) -> DataFrame:
    """The scan positions at which an image is above a value."""
    return image.where(F.col("value") > above).select("scan_pos")


def shift_events(ds: SparseDataset, shifts: DataFrame) -> SparseDataset:
    """Moves the hits of each position by its (dx, dy); those that leave the frame are dropped."""
    h, w = ds.frame_shape
    moved = ds.events.join(shifts.select("scan_pos", "dx", "dy"), "scan_pos").withColumns({"r": row_of(F.col("px"), w) + F.col("dy"), "c": col_of(F.col("px"), w) + F.col("dx")})
    kept = moved.where((F.col("r") >= 0) & (F.col("r") < h) & (F.col("c") >= 0) & (F.col("c") < w))
    return ds.with_(events=kept.select("scan_pos", "frame_idx", (F.col("r") * w + F.col("c")).cast("int").alias("px")))


def aperture_geometry(spark, centers_x, centers_y, radii) -> DataFrame:
    """aperture, x, y, radius, and the corners of the box around each: what a plot draws."""
    as_list = lambda x: list(x) if isinstance(x, Sequence) else [x]
    rows = [(i, float(x), float(y), float(r), x - float(r), y - float(r), x + float(r), y + float(r)) for i, (x, y, r) in enumerate(zip(as_list(centers_x), as_list(centers_y), as_list(radii), strict=True))]
    return spark.createDataFrame(rows, "aperture int, x double, y double, radius double, left double, top double, right double, bottom double")


def resample_nearest(image: DataFrame, points: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """point, value: the image at the scan position nearest to (row, col), clamped to the scan."""
    h, w = shape
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) + 0.5)))
    at = points.select("point", (clamp("row", h) * w + clamp("col", w)).cast("int").alias("scan_pos"))
    return at.join(image, "scan_pos", "left").select("point", "value")
