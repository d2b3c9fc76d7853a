"""Every query of the scan operators, with the SQL it must agree with.

The driver's tables become scan data: ``lineitem`` a counted dataset (scan 32 x 32, two
frames a position, frame 64 x 64), ``embeddings`` dense frames of 8 x 8.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pixels as pixel_functions
from .functions.pixels import col_of, row_of
from .model import DenseDataset, SparseDataset
from .operators import binning, com, counting, detectors, indexing, reductions
from .plans import registry
from .sources import raw, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SCAN, FRAME, DENSE_FRAME = (32, 32), (64, 64), (8, 8)
_COUNTED = "counted AS (SELECT DISTINCT CAST(l_orderkey % 1024 AS INTEGER) AS scan_pos, CAST((l_linenumber - 1) % 2 AS INTEGER) AS frame_idx, CAST((l_partkey * 31 + l_suppkey * 17 + l_orderkey * 7) % 4096 AS INTEGER) AS px FROM lineitem)"
_SCANS = "scans AS (SELECT CAST(range AS INTEGER) AS scan_pos FROM range(1024))"
_PXS = "pxs AS (SELECT CAST(range AS INTEGER) AS px FROM range(4096))"
_CELLS = "cells AS (SELECT scan_pos, px, count(*) AS k FROM counted GROUP BY scan_pos, px)"
_PIXELS = "pixels AS (SELECT CAST(vec_id AS INTEGER) AS scan_pos, CAST(i AS INTEGER) AS px, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 1000) AS BIGINT) AS value FROM embeddings, range(64) t(i))"
_DARK = "dark AS (SELECT CAST(range AS INTEGER) AS px, CAST(range % 7 AS INTEGER) AS dark, CAST(1 + (range % 5) / 10.0 AS DOUBLE) AS gain FROM range(64))"


def counted(spark: SparkSession, sf_dir: str) -> SparseDataset:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    events = t.select(
        (F.col("l_orderkey") % 1024).cast("int").alias("scan_pos"),
        ((F.col("l_linenumber") - 1) % 2).cast("int").alias("frame_idx"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_orderkey") * 7) % 4096).cast("int").alias("px"),
    ).distinct()
    return SparseDataset(events, SCAN, FRAME, 2)


def dense(spark: SparkSession, sf_dir: str) -> DenseDataset:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pixels = t.select(F.col("vec_id").cast("int").alias("scan_pos"), F.posexplode("embedding").alias("px", "e")).select("scan_pos", "px", F.floor((F.col("e").cast("double") + 1) * 1000).cast("long").alias("value"))
    return DenseDataset(pixels, (0,), DENSE_FRAME)


def dense_pairs(spark: SparkSession, sf_dir: str) -> DenseDataset:
    """``dense`` with two frames a position."""
    own = dense(spark, sf_dir).pixels
    pixels = own.select((F.col("scan_pos") - F.col("scan_pos") % 2).alias("p"), (F.col("scan_pos") % 2).alias("frame_idx"), "px", "value")
    return DenseDataset(pixels.select((F.col("p") / 2).cast("int").alias("scan_pos"), "frame_idx", "px", "value"), (1100,), DENSE_FRAME)


def dark_and_gain(spark: SparkSession) -> DataFrame:
    """64 rows: one per pixel of a frame."""
    return spark.range(64).select(F.col("id").cast("int").alias("px"), (F.col("id") % 7).cast("int").alias("dark"), (1 + (F.col("id") % 5) / 10.0).cast("double").alias("gain"))


def _add(sql: str | None = None, ctes: str = ""):
    def mark(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return mark


def _c(*parts: str) -> str:
    return ", ".join((_COUNTED, *parts))


_ROUND = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


# Reductions


@_add("SELECT px, CAST(count(c.px) AS BIGINT) AS value FROM pxs LEFT JOIN counted c USING (px) GROUP BY px", _c(_PXS))
def sum_scan(s, d):
    return counted(s, d).sum("scan")


@_add("SELECT scan_pos, CAST(count(c.px) AS BIGINT) AS value FROM scans LEFT JOIN counted c USING (scan_pos) GROUP BY scan_pos", _c(_SCANS))
def sum_frame(s, d):
    return counted(s, d).sum("frame")


@_add("SELECT px, CAST(coalesce(max(k), 0) AS BIGINT) AS value FROM pxs LEFT JOIN cells USING (px) GROUP BY px", _c(_PXS, _CELLS))
def max_scan(s, d):
    return counted(s, d).max("scan")


@_add("SELECT scan_pos, CAST(coalesce(max(k), 0) AS BIGINT) AS value FROM scans LEFT JOIN cells USING (scan_pos) GROUP BY scan_pos", _c(_SCANS, _CELLS))
def max_frame(s, d):
    return counted(s, d).max("frame")


@_add("SELECT px, CAST(CASE WHEN count(k) < 1024 THEN 0 ELSE min(k) END AS BIGINT) AS value FROM pxs LEFT JOIN cells USING (px) GROUP BY px", _c(_PXS, _CELLS))
def min_scan(s, d):
    return counted(s, d).min("scan")


@_add("SELECT scan_pos, CAST(CASE WHEN count(k) < 4096 THEN 0 ELSE min(k) END AS BIGINT) AS value FROM scans LEFT JOIN cells USING (scan_pos) GROUP BY scan_pos", _c(_SCANS, _CELLS))
def min_frame(s, d):
    return counted(s, d).min("frame")


@_add("SELECT px, count(c.px) / 1024.0::DOUBLE AS value FROM pxs LEFT JOIN counted c USING (px) GROUP BY px", _c(_PXS))
def mean_scan(s, d):
    return counted(s, d).mean("scan")


@_add("SELECT scan_pos, count(c.px) / 4096.0::DOUBLE AS value FROM scans LEFT JOIN counted c USING (scan_pos) GROUP BY scan_pos", _c(_SCANS))
def mean_frame(s, d):
    return counted(s, d).mean("frame")


@_add(
    "SELECT scan_col, frame_row, frame_col, CAST(coalesce(n, 0) AS BIGINT) AS value FROM (SELECT CAST(a.range AS INTEGER) AS scan_col, CAST(b.range // 64 AS INTEGER) AS frame_row, CAST(b.range % 64 AS INTEGER) AS frame_col FROM range(32) a, range(4096) b) LEFT JOIN (SELECT scan_pos % 32 AS scan_col, px // 64 AS frame_row, px % 64 AS frame_col, count(*) AS n FROM counted GROUP BY ALL) USING (scan_col, frame_row, frame_col)",
    _c(),
)
def sum_axis_rows(s, d):
    return counted(s, d).sum(axis=0)


@_add(
    "SELECT scan_row, frame_col, CAST(coalesce(m, 0) AS BIGINT) AS value FROM (SELECT CAST(a.range AS INTEGER) AS scan_row, CAST(b.range AS INTEGER) AS frame_col FROM range(32) a, range(64) b) LEFT JOIN (SELECT scan_pos // 32 AS scan_row, px % 64 AS frame_col, max(k) AS m FROM cells GROUP BY ALL) USING (scan_row, frame_col)",
    _c(_CELLS),
)
def max_axes_mixed(s, d):
    return counted(s, d).max(axis=(1, 2))


@_add("SELECT CAST(sum(k) AS BIGINT) AS sum, CAST(CASE WHEN count(*) < 4194304 THEN 0 ELSE min(k) END AS BIGINT) AS min, CAST(max(k) AS BIGINT) AS max, CAST(sum(k) AS BIGINT) / 4194304.0::DOUBLE AS mean FROM cells", _c(_CELLS))
def global_stats(s, d):
    return reductions.global_stats(counted(s, d))


@_add("SELECT count(*) / 2048.0::DOUBLE AS dose FROM counted", _c())
def dose(s, d):
    return reductions.dose(counted(s, d))


@_add("SELECT px, CAST(count(c.px) AS BIGINT) AS value FROM pxs LEFT JOIN counted c USING (px) GROUP BY px", _c(_PXS))
def sum_sparse(s, d):
    return reductions.sum_sparse(counted(s, d))


@_add("SELECT scan_pos, frame_idx, px FROM counted UNION ALL SELECT scan_pos, frame_idx + 2 AS frame_idx, px FROM counted WHERE px % 2 = 0", _c())
def sum_scans(s, d):
    ds = counted(s, d)
    return reductions.sum_scans(ds, ds.with_(events=ds.events.where(F.col("px") % 2 == 0))).events


# Indexing


@_add("SELECT (scan_pos // 32 - 4) * 16 + scan_pos % 32 - 8 AS scan_pos, frame_idx, px FROM counted WHERE scan_pos // 32 BETWEEN 4 AND 11 AND scan_pos % 32 BETWEEN 8 AND 23", _c())
def slice_scan(s, d):
    return counted(s, d)[4:12, 8:24].events


@_add("SELECT (scan_pos // 32 - 1) // 3 * 16 + scan_pos % 32 // 2 AS scan_pos, frame_idx, px FROM counted WHERE scan_pos // 32 >= 1 AND (scan_pos // 32 - 1) % 3 = 0 AND scan_pos % 2 = 0", _c())
def slice_scan_step(s, d):
    return counted(s, d)[1::3, ::2].events


@_add("SELECT (31 - scan_pos // 32) * 32 + (31 - scan_pos % 32) AS scan_pos, frame_idx, px FROM counted", _c())
def slice_scan_reverse(s, d):
    return counted(s, d)[::-1, ::-1].events


@_add("SELECT scan_pos % 32 AS scan_pos, frame_idx, px FROM counted WHERE scan_pos // 32 = 31", _c())
def index_scan_row(s, d):
    return counted(s, d)[-1].events


@_add("SELECT scan_pos, frame_idx, (px // 64 - 16) * 32 + px % 64 - 16 AS px FROM counted WHERE px // 64 BETWEEN 16 AND 47 AND px % 64 BETWEEN 16 AND 47", _c())
def slice_frame(s, d):
    return counted(s, d)[:, :, 16:48, 16:48].events


@_add("SELECT CAST(m.n AS INTEGER) AS scan_pos, frame_idx, px FROM counted JOIN (VALUES (3 * 32 + 5, 0), (0 * 32 + 7, 1), (3 * 32 + 5, 2), (31 * 32 + 31, 3)) m(o, n) ON scan_pos = m.o", _c())
def index_fancy(s, d):
    return counted(s, d)[[3, 0, 3, -1], [5, 7, 5, -1]].events


@_add("SELECT CAST(n AS INTEGER) AS scan_pos, frame_idx, px FROM counted JOIN (SELECT scan_pos, row_number() OVER (ORDER BY scan_pos) - 1 AS n FROM scans WHERE (scan_pos * 7) % 5 < 2) USING (scan_pos)", _c(_SCANS))
def mask_scan_bool(s, d):
    return counted(s, d)[(np.arange(1024) * 7 % 5 < 2).reshape(SCAN)].events


@_add("SELECT scan_pos, frame_idx, CAST(n AS INTEGER) AS px FROM counted JOIN (SELECT px, row_number() OVER (ORDER BY px) - 1 AS n FROM pxs WHERE (px * 11) % 3 = 1) USING (px)", _c(_PXS))
def mask_frame_bool(s, d):
    return counted(s, d)[..., (np.arange(4096) * 11 % 3 == 1).reshape(FRAME)].events


@_add("SELECT px, CAST(count(c.px) AS BIGINT) AS value FROM pxs LEFT JOIN (SELECT px FROM counted WHERE scan_pos = 101) c USING (px) GROUP BY px", _c(_PXS))
def dense_frame(s, d):
    return indexing.read_frame(counted(s, d), 101)


@_add("SELECT scan_pos, px, CAST(coalesce(k, 0) AS BIGINT) AS value FROM (SELECT CAST(a.range * 2 + b.range AS INTEGER) AS scan_pos, CAST(c.range * 8 + e.range AS INTEGER) AS px FROM range(2) a, range(2) b, range(8) c, range(8) e) LEFT JOIN (SELECT (scan_pos // 32) * 2 + scan_pos % 32 AS scan_pos, (px // 64) * 8 + px % 64 AS px, k FROM cells WHERE scan_pos // 32 < 2 AND scan_pos % 32 < 2 AND px // 64 < 8 AND px % 64 < 8) USING (scan_pos, px)", _c(_CELLS))
def to_dense(s, d):
    return counted(s, d)[:2, :2, :8, :8].to_dense()


@_add("SELECT count(*) AS value FROM counted WHERE scan_pos = 5 AND px = (SELECT min(px) FROM counted WHERE scan_pos = 5)", _c())
def pixel_lookup(s, d):
    ds = counted(s, d)
    return indexing.pixel(ds, 5, ds.events.where("scan_pos = 5").agg(F.min("px")).first()[0])


@_add("SELECT scan_pos, frame_idx, px FROM counted WHERE scan_pos BETWEEN 64 AND 127", _c())
def reshape_ravel(s, d):
    part = counted(s, d).reshape(16, 64, 64, 64)[1:2].ravel_scans()
    return part.events.select((F.col("scan_pos") + 64).cast("int").alias("scan_pos"), "frame_idx", "px")


# Binning and formats


@_add("SELECT scan_pos // 32 // 2 * 16 + scan_pos % 32 // 2 AS scan_pos, ((scan_pos // 32) % 2 * 2 + scan_pos % 2) * 2 + frame_idx AS frame_idx, px FROM counted", _c())
def bin_scans(s, d):
    return counted(s, d).bin_scans(2).events


@_add(
    "SELECT scan_pos, CAST(CASE WHEN cp = 0 THEN frame_idx ELSE 1 + dense_rank() OVER (PARTITION BY scan_pos, cp > 0 ORDER BY frame_idx, cp) END AS INTEGER) AS frame_idx, px FROM (SELECT *, row_number() OVER (PARTITION BY scan_pos, frame_idx, px) - 1 AS cp FROM (SELECT scan_pos, frame_idx, px // 64 // 4 * 16 + px % 64 // 4 AS px FROM counted))",
    _c(),
)
def bin_frames(s, d):
    return counted(s, d).bin_frames(4).events


@_add("SELECT scan_pos // 32 * 31 + scan_pos % 32 AS scan_pos, frame_idx, px FROM counted WHERE scan_pos % 32 < 31", _c())
def drop_flyback(s, d):
    return indexing.drop_flyback(counted(s, d)).events


@_add(
    "SELECT scan_pos, CAST(CASE WHEN cp = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY scan_pos, cp > 0 ORDER BY cp) END AS INTEGER) AS frame_idx, px FROM (SELECT scan_pos, px, row_number() OVER (PARTITION BY scan_pos, px) - 1 AS cp FROM (SELECT scan_pos, px // 16 AS px FROM counted))",
    _c(),
)
def v1_to_v3(s, d):
    flat = counted(s, d).events.select("scan_pos", F.lit(0).alias("frame_idx"), F.floor(F.col("px") / 16).cast("int").alias("px"))
    return binning.upgrade_v1(flat)


@_add("SELECT scan_pos, CAST(dense_rank() OVER (PARTITION BY scan_pos ORDER BY f) - 1 AS INTEGER) AS frame_idx, px FROM (SELECT scan_pos, (scan_pos * 13 + frame_idx * 7) % 100 AS f, px FROM counted)", _c())
def v2_to_v3(s, d):
    return binning.regroup_v2(counted(s, d).events.select("scan_pos", ((F.col("scan_pos") * 13 + F.col("frame_idx") * 7) % 100).alias("frame_id"), "px"))


# Raw frames, with embeddings as stored frames


def _frames(s, d):
    return counted(s, d).events.select("scan_pos", (F.col("scan_pos") * 2 + 1 - F.col("frame_idx")).cast("long").alias("frame_num"), F.lit(32).alias("scan_w"), F.lit(32).alias("scan_h")).distinct()


_FRAMES = "frames AS (SELECT DISTINCT scan_pos, CAST(scan_pos * 2 + 1 - frame_idx AS BIGINT) AS frame_num FROM counted)"


@_add("SELECT max(n) AS frames_per_scan FROM (SELECT count(*) AS n FROM frames GROUP BY scan_pos)", _c(_FRAMES))
def frames_per_scan(s, d):
    return raw.frames_per_scan(_frames(s, d))


@_add("SELECT scan_pos, frame_num, CAST(row_number() OVER (ORDER BY frame_num) - 1 AS INTEGER) AS frame_idx FROM frames WHERE scan_pos = 70", _c(_FRAMES))
def read_frames(s, d):
    return raw.read_frames(_frames(s, d), (2, 6), SCAN).select("scan_pos", "frame_num", "frame_idx")


@_add("SELECT count(*) / 4096.0::DOUBLE AS fraction FROM frames", _c(_FRAMES))
def data_captured(s, d):
    return raw.data_captured(_frames(s, d))


_SECTORS = "SELECT scan_pos, CAST({} AS INTEGER) AS px, value FROM (SELECT scan_pos // 4 AS scan_pos, scan_pos % 4 AS sector, px AS i, value FROM pixels)"


def _stitched(s, d, version: int, shape):
    p = dense(s, d).pixels
    return p.select(F.floor(F.col("scan_pos") / 4).cast("int").alias("scan_pos"), raw.stitch_sector(F.col("px"), F.col("scan_pos") % 4, version, shape).alias("px"), "value")


@_add(_SECTORS.format("(i // 4) * 16 + sector * 4 + i % 4"), _PIXELS)
def sector_stitch_v4(s, d):
    return _stitched(s, d, 4, (16, 4))


@_add(_SECTORS.format("sector * 64 + i"), _PIXELS)
def sector_stitch_v5(s, d):
    return _stitched(s, d, 5, (4, 16))


@_add("SELECT scan_pos, frame_num, CAST(scan_pos % 32 AS INTEGER) AS x, CAST(scan_pos // 32 AS INTEGER) AS y FROM frames", _c(_FRAMES))
def datacube_axes(s, d):
    return tables.as_data_cube(_frames(s, d)).select("scan_pos", "frame_num", "x", "y")


# Virtual detectors

_D2 = "((px % 64 - 32) * (px % 64 - 32) + (px // 64 - 32) * (px // 64 - 32))"
_D2_8 = "((px % 8 - 4) * (px % 8 - 4) + (px // 8 - 4) * (px // 8 - 4))"
_RINGS = ((0, 8), (8, 20), (20, 40))
_RINGS_SQL = ", ".join(f"({k}, {i * i}, {o * o})" for k, (i, o) in enumerate(_RINGS))


@_add(f"SELECT CAST(0 AS INTEGER) AS image_idx, scan_pos, CAST(count(c.px) * 65535 AS BIGINT) AS value FROM scans LEFT JOIN (SELECT * FROM counted WHERE {_D2} < 256) c USING (scan_pos) GROUP BY scan_pos", _c(_SCANS))
def stem_bright_field(s, d):
    return detectors.stem_images(counted(s, d), 0, 16)


@_add(f"SELECT CAST(k AS INTEGER) AS image_idx, scan_pos, CAST(count(c.px) AS BIGINT) AS value FROM scans CROSS JOIN (VALUES {_RINGS_SQL}) r(k, i2, o2) LEFT JOIN counted c ON c.scan_pos = scans.scan_pos AND {_D2} >= i2 AND {_D2} < o2 GROUP BY k, scans.scan_pos".replace("image_idx, scan_pos,", "image_idx, scans.scan_pos AS scan_pos,"), _c(_SCANS))
def stem_annular_multi(s, d):
    return detectors.stem_images(counted(s, d), [i for i, _ in _RINGS], [o for _, o in _RINGS], weight=1)


@_add(f"SELECT CAST(0 AS INTEGER) AS image_idx, scan_pos, CAST(sum(CASE WHEN {_D2_8} >= 1 AND {_D2_8} < 9 THEN value ELSE 0 END) AS BIGINT) AS value FROM pixels GROUP BY scan_pos", _PIXELS)
def stem_dense(s, d):
    return detectors.stem_images_dense(dense(s, d), 1, 3)


@_add(f"SELECT CAST(0 AS INTEGER) AS image_idx, CAST(range AS INTEGER) AS scan_pos, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM range(1100) LEFT JOIN (SELECT scan_pos // 2 AS p, value FROM pixels JOIN (SELECT max(scan_pos) AS scan_pos FROM pixels GROUP BY scan_pos // 2) USING (scan_pos) WHERE {_D2_8} >= 1 AND {_D2_8} < 9) ON p = range GROUP BY range", _PIXELS)
def stem_dense_last_frame(s, d):
    return detectors.stem_images_dense(dense_pairs(s, d), 1, 3)


@_add("SELECT px, round(CAST(sum(value) AS BIGINT) / count(*)::DOUBLE, 6) AS value FROM pixels GROUP BY px", _PIXELS)
def average_frame(s, d):
    return _ROUND(detectors.average_frame(dense(s, d)), "value")


@_add("SELECT px, CAST(max(value) AS DOUBLE) AS value FROM pixels GROUP BY px", _PIXELS)
def max_pattern(s, d):
    return detectors.max_pattern(dense(s, d))


@_add("SELECT px, CAST(max(value) - any_value(dark) AS DOUBLE) AS value FROM pixels JOIN dark USING (px) GROUP BY px", f"{_PIXELS}, {_DARK}")
def max_pattern_dark(s, d):
    return detectors.max_pattern(dense(s, d), dark_and_gain(s))


@_add(f"SELECT scan_pos, CAST(ceil(sqrt({_D2_8})) AS INTEGER) AS radius, CAST(sum(value) AS BIGINT) AS value FROM pixels GROUP BY ALL", _PIXELS)
def radial_dense(s, d):
    return detectors.radial_dense(dense(s, d))


_RADIAL = f"radial AS (SELECT scan_pos, CAST(CASE WHEN {_D2} = 1024 THEN 31 ELSE floor(sqrt({_D2})) END AS INTEGER) AS radius, count(*) AS value FROM counted WHERE {_D2} <= 1024 GROUP BY ALL)"


@_add("SELECT * FROM radial", _c(_RADIAL))
def radial_sparse(s, d):
    return detectors.radial_sparse(counted(s, d), (32, 32))


@_add("SELECT scan_pos, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM scans LEFT JOIN (SELECT * FROM radial WHERE radius >= 5 AND radius < 12) USING (scan_pos) GROUP BY scan_pos", _c(_SCANS, _RADIAL))
def radial_band(s, d):
    ds = counted(s, d)
    return detectors.radial_band(detectors.radial_sparse(ds, (32, 32)), 5, 12, ds.num_scans)


@_add(
    f"SELECT CAST(0 AS INTEGER) AS image_idx, CAST(bin AS INTEGER) AS bin, lo + bin * step AS lower, CAST(count(v.value) AS BIGINT) AS count FROM (SELECT range AS bin, lo, step, hi FROM range(10), e) b LEFT JOIN v ON (hi > lo AND v.value >= lo + bin * step AND (v.value < lo + (bin + 1) * step OR bin = 9)) OR (hi = lo AND bin = 9) GROUP BY bin, lo, step",
    _c(_SCANS, f"v AS (SELECT scan_pos, count(c.px) * 65535 AS value FROM scans LEFT JOIN (SELECT * FROM counted WHERE {_D2} < 256) c USING (scan_pos) GROUP BY scan_pos)", "e AS (SELECT CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi, (CAST(max(value) AS DOUBLE) - CAST(min(value) AS DOUBLE)) / 10 AS step FROM v)"),
)
def stem_histogram(s, d):
    return detectors.stem_histogram(detectors.stem_images(counted(s, d), 0, 16), 10)


@_add("SELECT scan_pos, CAST(coalesce(sum(CAST((px % 64 - 20) * (px % 64 - 20) + (px // 64 - 30) * (px // 64 - 30) < 36 AS INTEGER) + CAST((px % 64 - 40) * (px % 64 - 40) + (px // 64 - 34) * (px // 64 - 34) < 100 AS INTEGER)), 0) AS BIGINT) AS value FROM scans LEFT JOIN counted USING (scan_pos) GROUP BY scan_pos", _c(_SCANS))
def virtual_darkfield(s, d):
    return detectors.virtual_darkfield(counted(s, d), [20, 40], [30, 34], [6, 10])


@_add("SELECT px, CAST(count(c.px) AS BIGINT) AS value FROM pxs LEFT JOIN (SELECT px FROM counted WHERE scan_pos % 3 = 0) c USING (px) GROUP BY px", _c(_PXS))
def mask_real_space(s, d):
    ds = counted(s, d)
    return detectors.mask_real_space(ds, s.range(0, ds.num_scans, 3).select(F.col("id").cast("int").alias("scan_pos")))


@_add("SELECT px, CAST(count(c.px) AS BIGINT) AS value FROM pxs LEFT JOIN (SELECT px FROM counted WHERE scan_pos IN (SELECT scan_pos FROM counted WHERE (px % 64 - 20) * (px % 64 - 20) + (px // 64 - 30) * (px // 64 - 30) < 36 GROUP BY scan_pos HAVING count(*) > 2)) c USING (px) GROUP BY px", _c(_PXS))
def threshold_mask_dp(s, d):
    ds = counted(s, d)
    return detectors.mask_real_space(ds, detectors.threshold_positions(detectors.virtual_darkfield(ds, 20, 30, 6), 2))


@_add("SELECT scan_pos, frame_idx, r * 64 + c AS px FROM (SELECT scan_pos, frame_idx, px // 64 + scan_pos % 3 - 1 AS r, px % 64 + scan_pos % 5 - 2 AS c FROM counted) WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63", _c())
def shift_events(s, d):
    ds = counted(s, d)
    shifts = s.range(ds.num_scans).select(F.col("id").cast("int").alias("scan_pos"), (F.col("id") % 5 - 2).cast("int").alias("dx"), (F.col("id") % 3 - 1).cast("int").alias("dy"))
    return detectors.shift_events(ds, shifts).events


# Centre of mass

_MEANS = "SELECT scan_pos, CAST(sum(px % 64) AS BIGINT) / count(*)::DOUBLE AS com_x, CAST(sum(px // 64) AS BIGINT) / count(*)::DOUBLE AS com_y FROM {} GROUP BY scan_pos"
_COM = f"com AS ({_MEANS.format('counted')})"
_CROP = "crop AS (SELECT counted.* FROM counted JOIN com USING (scan_pos) WHERE sqrt((px % 64 - com_x) * (px % 64 - com_x) + (px // 64 - com_y) * (px // 64 - com_y)) <= 20)"
_XY = "scan_pos, round(com_x, 6) AS com_x, round(com_y, 6) AS com_y"


@_add(f"SELECT {_XY} FROM scans LEFT JOIN com USING (scan_pos)", _c(_SCANS, _COM))
def com_plain(s, d):
    return _ROUND(com.com_sparse(counted(s, d), replace_nans=False), "com_x", "com_y")


@_add(f"SELECT {_XY} FROM scans LEFT JOIN ({_MEANS.format('crop')}) USING (scan_pos)", _c(_SCANS, _COM, _CROP))
def com_crop(s, d):
    return _ROUND(com.com_sparse(counted(s, d), crop_to=20, replace_nans=False), "com_x", "com_y")


@_add(f"SELECT {_XY} FROM scans LEFT JOIN ({_MEANS.format('(SELECT * FROM counted WHERE sqrt((px % 64 - 30) * (px % 64 - 30) + (px // 64 - 33) * (px // 64 - 33)) <= 12)')}) USING (scan_pos)", _c(_SCANS))
def com_init_center(s, d):
    return _ROUND(com.com_sparse(counted(s, d), crop_to=(12, 10), init_center=(30, 33), replace_nans=False), "com_x", "com_y")


@_add(f"SELECT {_XY} FROM (SELECT scan_pos, coalesce(com_x, (SELECT avg(com_x) FROM com)) AS com_x, coalesce(com_y, (SELECT avg(com_y) FROM com)) AS com_y FROM scans LEFT JOIN com USING (scan_pos))", _c(_SCANS, _COM))
def com_nan_fill(s, d):
    return _ROUND(com.com_sparse(counted(s, d)), "com_x", "com_y")


@_add("SELECT scan_pos, round(CAST(sum(px % 8 * value) AS BIGINT) / CAST(sum(value) AS DOUBLE), 6) AS com_x, round(CAST(sum(px // 8 * value) AS BIGINT) / CAST(sum(value) AS DOUBLE), 6) AS com_y FROM pixels GROUP BY scan_pos", _PIXELS)
def com_dense(s, d):
    return _ROUND(com.com_dense(dense(s, d)), "com_x", "com_y")


_COS, _SIN = repr(math.cos(0.3)), repr(math.sin(0.3))


@_add(f"SELECT scan_pos, round(com_x * {_COS}::DOUBLE + com_y * {_SIN}::DOUBLE, 6) AS com_x, round(com_x * {_SIN}::DOUBLE - com_y * {_COS}::DOUBLE, 6) AS com_y FROM scans LEFT JOIN com USING (scan_pos)", _c(_SCANS, _COM))
def com_rotate(s, d):
    return _ROUND(com.rotate(com.com_sparse(counted(s, d), replace_nans=False), 0.3, flip=True), "com_x", "com_y")


@_add("SELECT scan_pos, round(sqrt(dx * dx + dy * dy), 6) AS radius, round(atan2(dy, dx), 6) AS angle FROM (SELECT scan_pos, com_x - (SELECT avg(com_x) FROM com) AS dx, com_y - (SELECT avg(com_y) FROM com) AS dy FROM com)", _c(_COM))
def com_polar(s, d):
    return _ROUND(com.polar(com.com_sparse(counted(s, d), replace_nans=False).where("com_x is not null")), "radius", "angle")


@_add("SELECT scan_pos, coalesce(com_y < 31 OR com_y > 34, false) AS bad FROM scans LEFT JOIN com USING (scan_pos)", _c(_SCANS, _COM))
def bad_sector_mask(s, d):
    return com.outliers(com.com_sparse(counted(s, d), replace_nans=False), 31, 34)


@_add()
def bad_sector_repair(s, d):
    return com.repair_outliers(com.com_sparse(counted(s, d)), SCAN, 31, 34)


@_add()
def phase_from_com(s, d):
    return com.phase(com.com_sparse(counted(s, d)), SCAN, 0.3)


@_add(
    "SELECT CAST(r * 32 + c AS INTEGER) AS scan_pos, CAST(median(value) AS DOUBLE) AS value FROM (SELECT a.range // 32 AS r, a.range % 32 AS c, least(31, greatest(0, a.range // 32 + y.range - 2)) * 32 + least(31, greatest(0, a.range % 32 + x.range - 2)) AS scan_pos FROM range(1024) a, range(5) x, range(5) y) JOIN (SELECT scan_pos, count(c.px) AS value FROM scans LEFT JOIN counted c USING (scan_pos) GROUP BY scan_pos) USING (scan_pos) GROUP BY r, c",
    _c(_SCANS),
)
def median_filter(s, d):
    return com.median_filter(counted(s, d).sum("frame"), SCAN, 5)


@_add(
    "SELECT round((xv * yy - yv * xy) / (xx * yy - xy * xy), 6) AS a, round((yv * xx - xv * xy) / (xx * yy - xy * xy), 6) AS b, round(mv - (xv * yy - yv * xy) / (xx * yy - xy * xy) * mx - (yv * xx - xv * xy) / (xx * yy - xy * xy) * my, 6) AS c FROM (SELECT covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM (SELECT CAST(scan_pos % 32 AS DOUBLE) AS x, CAST(scan_pos // 32 AS DOUBLE) AS y, com_y AS v FROM com))",
    _c(_COM),
)
def plane_fit(s, d):
    image = com.com_sparse(counted(s, d), replace_nans=False).select("scan_pos", F.col("com_y").alias("value"))
    return _ROUND(com.plane_fit(image, 32), "a", "b", "c")


# Counting

_CORRECTED = f"{_PIXELS}, {_DARK}, own AS (SELECT scan_pos, px, (value - dark) / gain AS value FROM pixels JOIN dark USING (px))"
_NEAR = "n.scan_pos = a.scan_pos AND n.px <> a.px AND abs(n.px // 8 - a.px // 8) <= 1 AND abs(n.px % 8 - a.px % 8) <= 1"


@_add("SELECT count(*) AS n, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 6) AS std_dev FROM pixels", _PIXELS)
def threshold_stats(s, d):
    return counting.statistics(dense(s, d).pixels).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4), "std_dev": F.round("std_dev", 6)})


@_add("SELECT CAST(range AS INTEGER) AS bin, CAST(count(value) AS BIGINT) AS count FROM range(700, 1300) LEFT JOIN pixels ON value = range GROUP BY range", _PIXELS)
def sample_histogram(s, d):
    return counting.histogram(dense(s, d).pixels, 700, 1300)


@_add("SELECT scan_pos, px, round(CASE WHEN value > 900 AND value < 1100 THEN value ELSE 0 END, 6) AS value FROM own", _CORRECTED)
def dark_gain_threshold(s, d):
    dark = dark_and_gain(s)
    return counting.thresholded(counting.corrected(dense(s, d).pixels, dark, dark), 900, 1100).select("scan_pos", "px", F.round("value", 6).alias("value"))


@_add("SELECT scan_pos, px, ((value - 1000 - dark) % 65536 + 65536) % 65536 AS value FROM pixels JOIN dark USING (px)", f"{_PIXELS}, {_DARK}")
def dark_wraps(s, d):
    low = dense(s, d).pixels.withColumn("value", F.col("value") - 1000)
    return counting.corrected(low, dark_and_gain(s))


_ROW_DARK = "SELECT scan_pos, px, round(value * 999.5::DOUBLE / st, 6) AS value FROM pixels JOIN (SELECT scan_pos, px // 8 AS r, px % 8 >= 4 AS h, {}(value) AS st FROM pixels GROUP BY ALL) s USING (scan_pos) WHERE r = px // 8 AND h = (px % 8 >= 4)"


@_add(_ROW_DARK.format("avg"), _PIXELS)
def row_dark_mean(s, d):
    return _ROUND(counting.row_dark(dense(s, d).pixels, 8, 999.5), "value")


@_add(_ROW_DARK.format("median"), _PIXELS)
def row_dark_median(s, d):
    return _ROUND(counting.row_dark(dense(s, d).pixels, 8, 999.5, use_mean=False), "value")


_STAT = "st AS (SELECT scan_pos, px // 8 AS r, px % 8 >= 4 AS h, avg(value) AS st FROM pixels GROUP BY ALL)"
_DARKENED = "darkened AS (SELECT pixels.scan_pos, px, ((value - dark) % 65536 + 65536) % 65536 AS v, st FROM pixels JOIN dark USING (px) JOIN st ON st.scan_pos = pixels.scan_pos AND r = px // 8 AND h = (px % 8 >= 4))"


@_add("SELECT scan_pos, px, round(v * 999.5::DOUBLE / st, 6) AS value FROM darkened", f"{_PIXELS}, {_DARK}, {_STAT}, {_DARKENED}")
def row_dark_with_dark(s, d):
    return _ROUND(counting.row_dark(dense(s, d).pixels, 8, 999.5, dark=dark_and_gain(s)), "value")


@_add("SELECT scan_pos, px, round((value - dark) / gain * 999.5::DOUBLE / st, 6) AS value FROM pixels JOIN dark USING (px) JOIN st USING (scan_pos) WHERE r = px // 8 AND h = (px % 8 >= 4)", f"{_PIXELS}, {_DARK}, {_STAT}")
def row_dark_with_gain(s, d):
    dark = dark_and_gain(s)
    return _ROUND(counting.row_dark(dense(s, d).pixels, 8, 999.5, dark=dark, gain=dark), "value")


_CUT = "cut AS (SELECT scan_pos, px, CASE WHEN value > 1150 AND value < 1450 THEN value ELSE 0 END AS value FROM pixels)"


@_add(f"SELECT scan_pos, px FROM pixels a WHERE NOT EXISTS (SELECT 1 FROM pixels n WHERE {_NEAR} AND n.value >= a.value)", _PIXELS)
def local_maxima(s, d):
    return counting.local_maxima(dense(s, d).pixels, DENSE_FRAME)


@_add(f"SELECT scan_pos, CAST(0 AS INTEGER) AS frame_idx, px FROM cut a WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM cut n WHERE {_NEAR} AND n.value >= a.value)", f"{_PIXELS}, {_CUT}")
def electron_count_fixed(s, d):
    return counting.electron_count(dense(s, d), counting.Thresholds(1150, 1450)).events


_SCALED = "cut AS (SELECT scan_pos, px, CASE WHEN v > 1010 AND v < 1450 THEN v ELSE 0 END AS value FROM (SELECT pixels.scan_pos, px, floor((value - dark) * 1000.0::DOUBLE / st) AS v FROM pixels JOIN dark USING (px) JOIN st ON st.scan_pos = pixels.scan_pos AND r = px // 8 AND h = (px % 8 >= 4)))"


@_add(f"SELECT scan_pos, CAST(0 AS INTEGER) AS frame_idx, px FROM cut a WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM cut n WHERE {_NEAR} AND n.value >= a.value)", f"{_PIXELS.replace('pixels AS (SELECT', 'every AS (SELECT')}, pixels AS (SELECT * REPLACE (value + 10 AS value) FROM every), {_DARK}, {_STAT}, {_SCALED}")
def electron_count_row_dark(s, d):
    ds = dense(s, d)
    ds = DenseDataset(ds.pixels.withColumn("value", F.col("value") + 10), ds.scan_shape, ds.frame_shape)
    return counting.electron_count(ds, counting.Thresholds(1010, 1450, optimized_mean=1000.0), dark_and_gain(s), apply_row_dark=True).events


@_add(f"SELECT CAST(scan_pos // 2 AS INTEGER) AS scan_pos, CAST(scan_pos % 2 AS INTEGER) AS frame_idx, px FROM cut a WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM cut n WHERE {_NEAR} AND n.value >= a.value)", f"{_PIXELS}, {_CUT}")
def electron_count_frames_apart(s, d):
    return counting.electron_count(dense_pairs(s, d), counting.Thresholds(1150, 1450)).events


def _stored(s, d):
    """The dense frames as binary rows."""
    own = dense(s, d).pixels.groupBy("scan_pos").agg(F.sort_array(F.collect_list(F.struct("px", "value"))).alias("p"))
    word = lambda x: F.concat(F.unhex(F.lpad(F.hex(x["value"] % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(x["value"] / 256)), 2, "0")))
    data = F.aggregate(F.transform("p", word), F.lit(b""), lambda a, b: F.concat(a, b))
    return own.select("scan_pos", F.col("scan_pos").cast("long").alias("frame_num"), F.lit(8).alias("frame_h"), F.lit(8).alias("frame_w"), data.alias("data"))


@_add(f"SELECT scan_pos, CAST(0 AS INTEGER) AS frame_idx, px FROM cut a WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM cut n WHERE {_NEAR} AND n.value >= a.value)", f"{_PIXELS}, {_CUT}")
def electron_count_kernel(s, d):
    return counting.number_frames(counting.count_frames(_stored(s, d), counting.Thresholds(1150, 1450)))


@_add(f"SELECT CAST(scan_pos // 2 AS INTEGER) AS scan_pos, CAST(scan_pos % 2 AS INTEGER) AS frame_idx, px FROM cut a WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM cut n WHERE {_NEAR} AND n.value >= a.value)", f"{_PIXELS}, {_CUT}")
def electron_count_raw(s, d):
    frames = _stored(s, d).withColumn("scan_pos", (F.col("frame_num") / 2).cast("int"))
    return counting.electron_count_frames(frames, limits=counting.Thresholds(1150, 1450), scan_shape=(1000, 1)).events


@_add()
def gaussian_threshold(s, d):
    t = counting.thresholds(counting.sample_frames(dense(s, d).pixels, 40))
    return s.createDataFrame([(t.background, t.xray, t.mean, t.std_dev, t.optimized_mean, t.optimized_std_dev)], "background double, xray double, mean double, std_dev double, optimized_mean double, optimized_std_dev double")


@registry.parameter("limit", "float", "Limit", "values above count", default=1000.0)
def _above(frame, limit):
    return np.where(frame > limit, frame - limit, 0)


ABOVE = registry.pipeline("above", "what exceeds a limit", aggregation="sum")(_above)


@_add("SELECT px, CAST(sum(CASE WHEN value > 1000 THEN value - 1000 ELSE 0 END) AS DOUBLE) AS value FROM pixels GROUP BY px", _PIXELS)
def pipeline_above(s, d):
    return registry.execute("above", _stored(s, d))


@_add("SELECT px // 64 AS frame_row, px % 64 AS frame_col, count(*) AS n FROM counted WHERE frame_idx = 1 GROUP BY ALL", _c())
def decoded_pixels(s, d):
    return counted(s, d).events.where("frame_idx = 1").groupBy(row_of(F.col("px"), 64).alias("frame_row"), col_of(F.col("px"), 64).alias("frame_col")).agg(F.count(F.lit(1)).alias("n"))


@_add(
    "SELECT CAST(p.range AS INTEGER) AS point, v.value FROM range(200) p JOIN (SELECT scan_pos, count(c.px) AS value FROM scans LEFT JOIN counted c USING (scan_pos) GROUP BY scan_pos) v ON v.scan_pos = least(31, greatest(0, CAST(floor(p.range * 0.17::DOUBLE - 1 + 0.5) AS BIGINT))) * 32 + least(31, greatest(0, CAST(floor(33 - p.range * 0.21::DOUBLE + 0.5) AS BIGINT)))",
    _c(_SCANS),
)
def resample_nearest(s, d):
    points = s.range(200).select(F.col("id").cast("int").alias("point"), (F.col("id") * F.lit(0.17) - 1).alias("row"), (33 - F.col("id") * F.lit(0.21)).alias("col"))
    return detectors.resample_nearest(counted(s, d).sum("frame"), points, SCAN)


@_add("SELECT * FROM (VALUES (CAST(0 AS INTEGER), 20.0::DOUBLE, 30.0::DOUBLE, 6.0::DOUBLE, 14.0::DOUBLE, 24.0::DOUBLE, 26.0::DOUBLE, 36.0::DOUBLE), (1, 40.0, 34.0, 10.0, 30.0, 24.0, 50.0, 44.0)) t(aperture, x, y, radius, \"left\", top, \"right\", bottom)")
def aperture_geometry(s, d):
    return detectors.aperture_geometry(s, [20, 40], [30, 34], [6, 10])


@_add("SELECT scan_pos, px, CAST(value AS INTEGER) AS value FROM pixels", _PIXELS)
def lossless_cast(s, d):
    return pixel_functions.lossless_cast(dense(s, d).pixels, "value", "int")
