"""Scan operators against dense numpy, hand-computed values and written raw files."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlattice.model import DenseDataset, FullExpansionDenied, SparseDataset
from scanlattice.operators import binning, com, counting, detectors, indexing, reductions
from scanlattice.plans import registry
from scanlattice.sources import catalog, hdf5, raw, tables
from scanlattice.streaming import sectors

SHAPE = (4, 6, 8, 10)  # not square, on purpose


def hits(frames=2, seed=0, shape=SHAPE):
    rng = np.random.default_rng(seed)
    out = rng.random((shape[0] * shape[1], frames, shape[2] * shape[3])) < 0.2
    out[3] = False  # an empty position
    out[7, :, :] = True
    return out


def dataset(spark, seed=0):
    h = hits(seed=seed)
    rows = [(int(p), int(f), int(x)) for p, f, x in np.argwhere(h)]
    return SparseDataset(spark.createDataFrame(rows, "scan_pos int, frame_idx int, px int"), SHAPE[:2], SHAPE[2:], 2), h.sum(axis=1).reshape(SHAPE)


def grid(df, shape, key):
    out = np.zeros(shape, float).ravel()
    for r in df.collect():
        out[r[key]] = r.value
    return out.reshape(shape)


def cells(ds):
    out = np.zeros((ds.num_scans, ds.num_pixels), int)
    for r in ds.cells().collect():
        out[r.scan_pos, r.px] = r.value
    return out.reshape(ds.shape)


@pytest.fixture(scope="module")
def sparse(spark):
    ds, full = dataset(spark)
    return ds.with_(events=ds.events.cache()), full


@pytest.mark.parametrize("how", ["sum", "max", "min", "mean"])
def test_reductions(sparse, how):
    ds, full = sparse
    for axis, key, kept in (("scan", "px", SHAPE[2:]), ((2, 3), "scan_pos", SHAPE[:2])):
        expected = getattr(full, how)(axis=(0, 1) if axis == "scan" else (2, 3))
        assert np.allclose(grid(getattr(ds, how)(axis), kept, key), expected)
    got = {(r.scan_row, r.frame_col): r.value for r in getattr(ds, how)(axis=(1, -2)).collect()}
    assert np.allclose([[got[a, b] for b in range(10)] for a in range(4)], getattr(full, how)(axis=(1, 2)))
    assert np.isclose(getattr(ds, how)().first().value, getattr(full, how)())


def test_global_stats_and_dose(sparse):
    ds, full = sparse
    r = reductions.global_stats(ds).first()
    assert (r.sum, r.min, r.max) == (full.sum(), full.min(), full.max()) and np.isclose(r["mean"], full.mean())
    assert np.isclose(reductions.dose(ds).first().dose, full.sum() / 48)


KEYS = [
    (slice(1, 3), slice(None, None, 2)),
    (slice(None, None, -1), slice(4, None, -2)),
    (2,),
    (-1, slice(1, 4)),
    (slice(None), slice(None), slice(2, 6), slice(1, 9, 3)),
    (..., slice(0, 4), slice(None, None, -1)),
    ([0, 3, 0], [1, -1, 1]),
    ([2, 0],),
    (slice(None), [1, 1, 5]),
    (slice(3, 3),),
    (..., [7, 0, 0], [9, 1, 1]),
    (np.arange(24).reshape(4, 6) % 3 == 0,),
    (np.array([True, False, True, True]),),
    (..., np.arange(80).reshape(8, 10) % 7 == 1),
]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_indexing_is_numpy(sparse, key):
    ds, full = sparse
    got, expected = ds[key], full[key]
    assert got.shape == expected.shape
    assert (cells(got) == expected).all()


def test_indexing_errors(sparse):
    ds, _ = sparse
    for key in [(9,), (0, 0, 0, 0, 0), ([0], slice(None), [1], slice(None)), (np.zeros((3, 6), bool),), (np.zeros((2, 2), int),), (-5,), ([9],)]:
        with pytest.raises(IndexError):
            ds[key]
    with pytest.raises(FullExpansionDenied):
        ds.densify()
    with pytest.raises(IndexError):
        indexing.read_frame(ds, 24)


def test_dense_frame_and_pixel(sparse):
    ds, full = sparse
    assert (grid(indexing.read_frame(ds, 10), SHAPE[2:], "px") == full[1, 4]).all()
    assert indexing.pixel(ds, 7, 33).first().value == 2 and indexing.pixel(ds, 3, 0).first().value == 0
    assert ds[:2, :2].to_dense().agg(F.sum("value")).first()[0] == full[:2, :2].sum()


def test_reshape(sparse):
    ds, full = sparse
    assert (cells(ds.reshape(3, 8, 8, 10)) == full.reshape(3, 8, 8, 10)).all()
    assert ds.ravel_scans().shape == (24, 8, 10)
    with pytest.raises(ValueError):
        ds.reshape(5, 5, 8, 10)


def test_binning(sparse):
    ds, full = sparse
    got = ds.bin_scans(2)
    assert (cells(got) == full.reshape(2, 2, 3, 2, 8, 10).sum(axis=(1, 3))).all() and got.frames_per_scan == 8
    got = ds.bin_frames(2)
    assert (cells(got) == full.reshape(4, 6, 4, 2, 5, 2).sum(axis=(3, 5))).all()
    assert got.events.count() == got.events.distinct().count()
    assert got.events.agg(F.max("frame_idx")).first()[0] + 1 == got.frames_per_scan
    for f, k in ((ds.bin_scans, 5), (ds.bin_frames, 3)):
        with pytest.raises(ValueError):
            f(k)


def test_formats(spark):
    v1 = spark.createDataFrame([(0, 0, [5, 5, 2]), (1, 0, [5, 5, 5])], "scan_pos int, frame_idx int, events array<int>")
    ds = tables.from_nested(v1, (1, 2), (2, 4), version=1)
    assert sorted(map(tuple, ds.events.collect())) == [(0, 0, 2), (0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5), (1, 2, 5)]
    v2 = spark.createDataFrame([(0, 9, [1]), (0, 4, [2]), (1, 2, [3])], "scan_pos int, frame_id int, events array<int>")
    assert sorted(map(tuple, tables.from_nested(v2, (1, 2), (2, 4), version=2).events.collect())) == [(0, 0, 2), (0, 1, 1), (1, 0, 3)]


def test_counted_round_trip(sparse, tmp_path):
    ds, full = sparse
    tables.save_counted(ds.with_(metadata={"a": {"b": [1, 2], "c": "x"}}), str(tmp_path / "c"))
    back = tables.load_counted(ds.events.sparkSession, str(tmp_path / "c"))
    assert back.metadata == {"a": {"b": [1, 2], "c": "x"}} and back.shape == SHAPE and (cells(back) == full).all()
    assert (cells(tables.load_counted(ds.events.sparkSession, str(tmp_path / "c"), keep_flyback=False)) == full[:, :-1]).all()


def test_com_golden(spark):
    ds = SparseDataset(spark.createDataFrame([(0, 0, 0), (0, 1, 3), (1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2)], "scan_pos int, frame_idx int, px int"), (1, 2), (2, 2), 2)
    assert [(r.com_x, r.com_y) for r in com.com_sparse(ds).orderBy("scan_pos").collect()] == [(0.5, 0.5), (0.25, 0.25)]


def test_radial_golden(spark):
    rows = [(0, f, p) for f in range(3) for p in (0, 48, 72, 65)]
    ds = SparseDataset(spark.createDataFrame(rows, "scan_pos int, frame_idx int, px int"), (1, 1), (11, 11), 3)
    got = {r.radius: r.value for r in detectors.radial_sparse(ds, (5, 5)).collect()}
    assert [got.get(i, 0) for i in range(5)] == [0, 6, 0, 0, 3]


def test_com_crop_and_fill(sparse):
    ds, full = sparse
    y, x = np.mgrid[:8, :10]
    for params in ({}, {"crop_to": 3}, {"crop_to": (3, 2), "init_center": (4, 3)}):
        expected = np.full((24, 2), np.nan)
        for p, f in enumerate(full.reshape(24, 8, 10)):
            if f.sum():
                if "crop_to" in params:
                    cx, cy = params.get("init_center", ((x * f).sum() / f.sum(), (y * f).sum() / f.sum()))
                    f = f * (np.hypot(x - cx, y - cy) <= 3)
                expected[p] = (x * f).sum() / f.sum(), (y * f).sum() / f.sum()
        got = np.array([(r.com_x, r.com_y) for r in com.com_sparse(ds, **params, replace_nans=False).orderBy("scan_pos").collect()], float)
        assert np.allclose(got, expected, equal_nan=True)
        filled = np.array([(r.com_x, r.com_y) for r in com.com_sparse(ds, **params).orderBy("scan_pos").collect()], float)
        assert np.allclose(filled, np.where(np.isnan(expected), np.nanmean(expected, axis=0), expected))


def test_repair_and_phase(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(5, 1, (6, 7)), rng.normal(5, 1, (6, 7))
    y[2, 3], y[2, 4], y[0, 2] = 90, 95, 99
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x.ravel(), y.ravel()))], "scan_pos int, com_x double, com_y double")
    ex, ey = x.copy(), y.copy()
    bad = ey > 50
    ex[bad] = ey[bad] = np.nan
    for r, c in [(2, 3), (2, 4)]:
        for a in (ex, ey):
            a[r, c] = np.nanmedian(a[r - 1 : r + 2, c - 1 : c + 2])
    got = com.repair_outliers(df, (6, 7), 0, 50).orderBy("scan_pos").toPandas()
    assert np.allclose(got.com_x.to_numpy().reshape(6, 7), ex, equal_nan=True) and np.allclose(got.com_y.to_numpy().reshape(6, 7), ey, equal_nan=True)
    field = np.cos(2 * np.pi * np.arange(6) / 6)[:, None] + np.sin(2 * np.pi * np.arange(7) / 7)[None, :]
    spectrum, k0, k1 = np.fft.fft2(field), np.fft.fftfreq(6)[:, None], np.fft.fftfreq(7)[None, :]
    gx, gy = (np.fft.ifft2(2j * np.pi * k * spectrum).real for k in (k0, k1))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(gx.ravel(), gy.ravel()))], "scan_pos int, com_x double, com_y double")
    got = com.phase(df, (6, 7)).orderBy("scan_pos").toPandas().phase.to_numpy().reshape(6, 7)
    assert np.allclose(got, field - field.mean(), atol=1e-6)


def frames_array(n=12, h=8, w=12, seed=3):
    rng = np.random.default_rng(seed)
    out = rng.normal(100, 6, (n, h, w))
    for f in out:
        f[rng.integers(0, h, 4), rng.integers(0, w, 4)] += 200
    return out.round().astype("<u2")


def dense_of(spark, a):
    n, h, w = a.shape
    rows = [(p, i, int(v)) for p in range(n) for i, v in enumerate(a[p].ravel())]
    return DenseDataset(spark.createDataFrame(rows, "scan_pos int, px int, value long"), (n,), (h, w))


def test_dense_detectors(spark):
    a = frames_array()
    ds = dense_of(spark, a)
    y, x = np.mgrid[:8, :12]
    d2 = (x - 6) ** 2 + (y - 4) ** 2
    got = {(r.image_idx, r.scan_pos): r.value for r in detectors.stem_images_dense(ds, [0, 2], [3, 5]).collect()}
    for k, (i, o) in enumerate([(0, 3), (2, 5)]):
        assert [got[k, p] for p in range(12)] == [int(f[(d2 >= i * i) & (d2 < o * o)].sum()) for f in a]
    ring = np.ceil(np.sqrt(d2)).astype(int)
    radial = {(r.scan_pos, r.radius): r.value for r in detectors.radial_dense(ds).collect()}
    assert all(radial[p, r] == a[p][ring == r].sum() for p in range(12) for r in np.unique(ring))
    assert ring.max() < detectors.radii_of((8, 12))
    assert np.allclose(grid(detectors.average_frame(ds), (8, 12), "px"), a.mean(axis=0))
    assert (grid(detectors.max_pattern(ds), (8, 12), "px") == a.max(axis=0)).all()
    with pytest.raises(ValueError):
        detectors.stem_images_dense(ds, [1, 2], [3])


def test_histogram_edges(spark):
    images = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])] + [(1, 0, 4), (1, 1, 4)], "image_idx int, scan_pos int, value long")
    got = {(r.image_idx, r.bin): r["count"] for r in detectors.stem_histogram(images, 5).collect()}
    assert [got[0, k] for k in range(5)] == [2, 2, 2, 2, 3] and [got[1, k] for k in range(5)] == [0, 0, 0, 0, 2]


def plain_peaks(f, bg, xr):
    f = np.where((f > bg) & (f < xr), f, 0).astype(float)
    out = []
    for r, c in itertools.product(*map(range, f.shape)):
        near = [f[i, j] for i in range(max(0, r - 1), min(f.shape[0], r + 2)) for j in range(max(0, c - 1), min(f.shape[1], c + 2)) if (i, j) != (r, c)]
        if f[r, c] > 0 and f[r, c] > max(near):
            out.append(r * f.shape[1] + c)
    return out


def test_counting_relational_and_kernel(spark):
    a = frames_array()
    limits = counting.Thresholds(150, 400, optimized_mean=100)
    expected = {(p, x) for p, f in enumerate(a) for x in plain_peaks(f, 150, 400)}
    assert {(r.scan_pos, r.px) for r in counting.electron_count(dense_of(spark, a), limits).events.collect()} == expected
    frames = raw.from_numpy(spark, a, (4, 3))
    assert {(r.scan_pos, r.px) for r in counting.number_frames(counting.count_frames(frames, limits)).collect()} == expected
    dark = np.arange(96).reshape(8, 12) % 5 + 98
    table = spark.createDataFrame([(i, int(v)) for i, v in enumerate(dark.ravel())], "px int, dark int")
    wrapped = (a.astype(int) - dark) % 65536
    expected = {(p, x) for p, f in enumerate(wrapped) for x in plain_peaks(f, 40, 400)}
    assert {(r.scan_pos, r.px) for r in counting.electron_count(dense_of(spark, a), counting.Thresholds(40, 400), table).events.collect()} == expected
    assert {(r.scan_pos, r.px) for r in counting.number_frames(counting.count_frames(frames, counting.Thresholds(40, 400), dark)).collect()} == expected
    for use_mean in (True, False):
        own = counting.electron_count(dense_of(spark, a), limits, apply_row_dark=True, use_mean=use_mean)
        kernel = counting.number_frames(counting.count_frames(frames, limits, row_dark_mean=use_mean))
        assert {(r.scan_pos, r.px) for r in own.events.collect()} == {(r.scan_pos, r.px) for r in kernel.collect()}


def test_gaussian_thresholds(spark):
    x = np.arange(60, 140.0)
    amplitude, mean, sigma = counting.gaussian_fit(x, 50 * np.exp(-((x - 97.3) ** 2) / (2 * 4.2**2)), 100, 8)
    assert np.allclose([amplitude, mean, sigma], [50, 97.3, 4.2])
    t = counting.thresholds(counting.sample_frames(dense_of(spark, frames_array()).pixels, 8))
    assert abs(t.optimized_mean - 100) < 2 and 110 < t.background < 150 and t.xray > t.background
    with pytest.raises(ValueError):
        counting.thresholds(dense_of(spark, frames_array()).pixels.where("false"))


HEAD = raw.RECORD_HEADER


def record(scan, frame, w, h, pos, data):
    return np.array([(scan, frame, w, h, pos % w, pos // w)], HEAD).tobytes() + data.astype("<u2").tobytes()


def test_block_formats(spark, tmp_path):
    a = frames_array(5)
    head = np.zeros(1024, "<u4")
    head[:5], head[10:15] = [5, 8, 12, 1, 7], [3, 1, 2, 5, 4]
    (tmp_path / "v1.data").write_bytes(head.tobytes() + a.tobytes())
    got = {r.scan_pos: bytes(r.data) for r in raw.reader(spark, str(tmp_path / "v1.data")).collect()}
    assert got == {p: f.tobytes() for p, f in zip([2, 0, 1, 4, 3], a)}
    b = np.arange(1600 * 4, dtype="<u2").reshape(1600, 2, 2)
    (tmp_path / "v2.data").write_bytes(np.array([77], "<u4").tobytes() + b.tobytes())
    got = {r.scan_pos: bytes(r.data) for r in raw.reader(spark, str(tmp_path / "v2.data"), 2, frame=(2, 2)).collect()}
    assert got == {p: f.tobytes() for p, f in enumerate(b)}
    (tmp_path / "cut.data").write_bytes(head.tobytes() + a.tobytes()[:-3])
    with pytest.raises(Exception, match="Unexpected EOF"):
        raw.reader(spark, str(tmp_path / "cut.data")).collect()
    (tmp_path / "v3.data").write_bytes(b"".join(record(1, i, 3, 2, p, a[i]) for i, p in enumerate([4, 0, 5])))
    rows = raw.reader(spark, str(tmp_path / "v3.data"), 3, frame=(8, 12)).collect()
    assert {(r.scan_pos, r.frame_num): bytes(r.data) for r in rows} == {(p, i): a[i].tobytes() for i, p in enumerate([4, 0, 5])}
    assert raw.scan_shape(raw.reader(spark, str(tmp_path / "v3.data"), 3, frame=(8, 12))) == (2, 3)
    with pytest.raises(ValueError):
        raw.reader(spark, [], 3)


@pytest.mark.parametrize("version", [4, 5])
def test_sector_formats(spark, tmp_path, version):
    a = frames_array(6, 8, 12)
    shape = (8, 3) if version == 4 else (2, 12)
    paths = []
    for k in range(4):
        part = (lambda f: f[:, 3 * k : 3 * k + 3]) if version == 4 else (lambda f: f[2 * k : 2 * k + 2])
        kept = [i for i in range(6) if not (k == 2 and i == 4)]
        np.random.default_rng(k).shuffle(kept)
        paths.append(str(tmp_path / f"module{k}.data"))
        open(paths[-1], "wb").write(b"".join(record(1, i, 3, 1, i // 2, part(a[i])) for i in kept))
    rows = {r.frame_num: r for r in raw.reader(spark, paths, version, shape=shape).collect()}
    assert all(bytes(rows[i].data) == a[i].tobytes() and rows[i].complete for i in range(6) if i != 4)
    partial = a[4].copy()
    partial[(slice(None), slice(6, 9)) if version == 4 else slice(4, 6)] = 0
    assert not rows[4].complete and bytes(rows[4].data) == partial.tobytes()
    frames = raw.reader(spark, paths, version, backend="thread", shape=shape)
    assert sorted(r.frame_num for r in frames.select("frame_num").collect()) == [0, 1, 2, 3, 5]
    heads = raw.read_headers(spark, paths, version, shape)
    assert np.isclose(raw.data_captured(heads).first().fraction, 23 / 12)
    assert raw.frames_per_scan(frames).first()[0] == 2
    assert [r.frame_num for r in raw.read_frames(frames, (0, 1), (1, 3), 1).collect()] == [3]
    for bad in ((0, 3), (-1, 0)):
        with pytest.raises(IndexError):
            raw.read_frames(frames, bad, (1, 3))
    with pytest.raises(IndexError):
        raw.read_frames(frames, 2, (1, 3), [1])
    with pytest.raises(ValueError):
        raw.reader(spark, paths, version, backend="other")


def test_sector_stream(spark, tmp_path):
    a = frames_array(3, 8, 12)
    rows = [(1, i, i, k, bytearray(a[i][2 * k : 2 * k + 2].tobytes())) for i in range(3) for k in range(4) if (i, k) != (2, 3)]
    schema = "scan_num long, frame_num long, scan_pos int, sector int, data binary"
    for n, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sectors.assemble_stream(stream, 5, (2, 12), timeout_ms=None).writeStream.format("memory").queryName("assembled").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = {r.frame_num: bytes(r.data) for r in spark.table("assembled").collect()}
    assert got == {i: a[i].tobytes() for i in range(2)}


def test_registry(spark):
    @registry.pipeline("double", "twice the frame", aggregation="max")
    @registry.parameter("factor", "float", default=2.0)
    def double(frame, factor):
        return frame.astype(float) * factor

    a = frames_array(4)
    frames = raw.from_numpy(spark, a, (2, 2))
    assert (grid(registry.execute("double", frames), (8, 12), "px") == 2 * a.max(axis=0)).all()
    assert (grid(registry.execute("double", frames, factor=3.0), (8, 12), "px") == 3 * a.max(axis=0)).all()
    assert (double(a[0]) == 2.0 * a[0]).all()


def test_catalog(tmp_path):
    for name in ("FOURD_230124_1525_20132_00714.h5", "FOURD_230124_1525_20132_00714_offsets.emd", "data_scan7_th4_electrons.h5", "data_scan8_th4_electrons.h5", "data_scan8_th5_electrons.h5"):
        (tmp_path / name).touch()
    assert catalog.find_scan(str(tmp_path), scan_num=714)[1] == {"scan_id": 20132, "scan_num": 714}
    assert catalog.find_scan(str(tmp_path), scan_id=20132, suffix="offsets")[0].suffix == ".emd"
    assert catalog.find_scan(str(tmp_path), scan_num=7)[1] == {"scan_num": 7, "th": 4}
    assert catalog.find_scan(str(tmp_path), scan_num=8, th=5)[1]["th"] == 5
    with pytest.raises(ValueError):
        catalog.find_scan(str(tmp_path), scan_num=8)
    with pytest.raises(FileNotFoundError):
        catalog.find_scan(str(tmp_path), scan_num=9)
    with pytest.raises(TypeError):
        catalog.find_scan(str(tmp_path), th=4)


def test_images_and_cubes(spark, tmp_path, sparse):
    ds, full = sparse
    images = detectors.stem_images(ds, [0, 1], [3, 4], weight=1)
    tables.save_images(images, ["bf", "adf"], str(tmp_path / "i"), 6)
    assert spark.read.parquet(str(tmp_path / "i")).where("name = 'bf'").count() == 24
    with pytest.raises(ValueError):
        tables.save_images(images, ["bf"], str(tmp_path / "j"), 6)
    frames = raw.from_numpy(spark, frames_array(6), (3, 2))
    tables.write_frames(frames, str(tmp_path / "c"), "datacube")
    assert {(r.x, r.y) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {(x, y) for x in range(3) for y in range(2)}
    tables.save_raw(frames, str(tmp_path / "r"), zip_data=True)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
    assert raw.pixels_of(frames).agg(F.sum("value")).first()[0] == frames_array(6).sum()


def test_shift_and_masks(spark, sparse):
    ds, full = sparse
    shifts = spark.createDataFrame([(p, 1 if p % 2 else 0, -2 if p % 3 else 0) for p in range(24)], "scan_pos int, dx int, dy int")
    expected = np.zeros_like(full).reshape(24, 8, 10)
    for p, f in enumerate(full.reshape(24, 8, 10)):
        dx, dy = 1 if p % 2 else 0, -2 if p % 3 else 0
        for r, c in np.argwhere(f):
            if 0 <= r + dy < 8 and 0 <= c + dx < 10:
                expected[p, r + dy, c + dx] = f[r, c]
    assert (cells(detectors.shift_events(ds, shifts)) == expected.reshape(SHAPE)).all()
    chosen = spark.createDataFrame([(2,), (2,), (9,)], "scan_pos int")
    assert (grid(detectors.mask_real_space(ds, chosen), (8, 10), "px") == full.reshape(24, 8, 10)[[2, 9]].sum(axis=0)).all()
    y, x = np.mgrid[:8, :10]
    inside = ((x - 3) ** 2 + (y - 2) ** 2 < 4).astype(int) + ((x - 4) ** 2 + (y - 3) ** 2 < 9)
    assert (grid(detectors.virtual_darkfield(ds, [3, 4], [2, 3], [2, 3]), (4, 6), "scan_pos") == (full * inside).sum(axis=(2, 3))).all()


def test_lossless_cast(spark):
    from scanlattice.functions.pixels import lossless_cast

    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert [r.v for r in lossless_cast(df, "v", "int").collect()] == [1, 2, None]
    for bad, to in ((1.5, "int"), (300.0, "tinyint")):
        with pytest.raises(ValueError):
            lossless_cast(spark.createDataFrame([(bad,)], "v double"), "v", to)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key,expected", [((slice(1, 3), slice(2, 5)), ["GreaterThanOrEqual(scan_pos,8)", "LessThanOrEqual(scan_pos,16)"]), ((-1,), ["GreaterThanOrEqual(scan_pos,18)", "LessThanOrEqual(scan_pos,23)"]), ((2, 3), ["EqualTo(scan_pos,15)"])], ids=str)
def test_slices_reach_the_scan(sparse, tmp_path, key, expected):
    ds, full = sparse
    ds.events.write.parquet(str(tmp_path / "e"))
    stored = ds.with_(events=ds.events.sparkSession.read.parquet(str(tmp_path / "e")))
    plan = plan_of(stored[key].events)
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(e in pushed for e in expected), pushed
    assert (cells(stored[key]) == full[key]).all()


def test_dense_slicing_and_positions(sparse):
    ds, full = sparse
    dense = ds.with_(sparse_slicing=False)
    got = {(r.scan_pos, r.px): r.value for r in dense[1:3, 2].collect()}
    assert [[got[p, x] for x in range(80)] for p in range(2)] == full[1:3, 2].reshape(2, 80).tolist()
    with pytest.raises(FullExpansionDenied):
        dense[:]
    assert [(r.scan_row, r.scan_col) for r in ds.scan_positions.orderBy("scan_pos").collect()] == [divmod(p, 6) for p in range(24)]
    assert ds.ravel_scans().scan_positions.count() == 24


def test_bin_frames_plans_without_a_job(spark, sparse):
    ds, _ = sparse
    spark.sparkContext.setJobGroup("lazy", "plans only")
    got = ds.bin_frames(2)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    assert got.frames_per_scan >= 2
    spark.sparkContext.setJobGroup("rest", "")


def test_row_dark_with_dark_and_gain(spark):
    a = frames_array()
    rng = np.random.default_rng(12)
    dark, gain = rng.integers(0, 90, (8, 12)), rng.uniform(0.8, 1.2, (8, 12))
    table = spark.createDataFrame([(i, int(d), float(g)) for i, (d, g) in enumerate(zip(dark.ravel(), gain.ravel()))], "px int, dark int, gain double")
    frames = raw.from_numpy(spark, a, (4, 3))
    limits = counting.Thresholds(60, 900, optimized_mean=100.0)
    for use_mean, with_gain in itertools.product((True, False), (True, False)):
        expected = set()
        for p, f in enumerate(a.astype(float)):
            out = np.zeros_like(f)
            for part in (slice(0, 6), slice(6, 12)):
                stat = (f[:, part].mean(axis=1) if use_mean else np.median(f[:, part], axis=1))[:, None]
                own = (f - dark)[:, part] / gain[:, part] if with_gain else (f - dark)[:, part] % 65536
                out[:, part] = own * 100.0 / stat if with_gain else np.floor(own * 100.0 / stat) % 65536
            expected |= {(p, x) for x in plain_peaks(out, 60, 900)}
        own = counting.electron_count(dense_of(spark, a), limits, table, table if with_gain else None, apply_row_dark=True, use_mean=use_mean)
        kernel = counting.count_frames(frames, limits, dark, gain if with_gain else None, use_mean)
        assert expected and {(r.scan_pos, r.px) for r in own.events.collect()} == expected
        assert {(r.scan_pos, r.px) for r in counting.number_frames(kernel).collect()} == expected


def test_frames_of_a_position_are_apart(spark):
    a = frames_array()
    rows = [(p // 3, p % 3, i, int(v)) for p in range(12) for i, v in enumerate(a[p].ravel())]
    ds = DenseDataset(spark.createDataFrame(rows, "scan_pos int, frame_idx int, px int, value long"), (5,), (8, 12))
    limits = counting.Thresholds(150, 400, optimized_mean=100.0)
    expected = {(p // 3, p % 3, x) for p, f in enumerate(a) for x in plain_peaks(f, 150, 400)}
    got = counting.electron_count(ds, limits)
    assert {tuple(r) for r in got.events.collect()} == expected and got.frames_per_scan == 3
    assert counting.sample_frames(ds.pixels, 5).select("scan_pos", "frame_idx").distinct().count() == 5
    images = {r.scan_pos: r.value for r in detectors.stem_images_dense(ds, 0, 100).collect()}
    assert images == {p: int(a[3 * p + 2].sum()) if p < 4 else 0 for p in range(5)}
    assert counting.row_dark(ds.pixels, 12, 100.0).count() == 12 * 96


def test_raw_frames_to_a_counted_dataset(spark, tmp_path):
    a = frames_array(24, 8, 12)
    limits = counting.Thresholds(150, 400)
    data = b"".join(record(1, 100 - i, 4, 3, i // 2, a[i]) for i in range(24))
    (tmp_path / "v3.data").write_bytes(data)
    frames = raw.reader(spark, str(tmp_path / "v3.data"), 3, frame=(8, 12))
    ds = counting.electron_count_frames(frames, limits=limits)
    assert ds.shape == (3, 4, 8, 12) and ds.frames_per_scan == 2
    expected = {(i // 2, 1 - i % 2, x) for i, f in enumerate(a) for x in plain_peaks(f, 150, 400)}
    assert {tuple(r) for r in ds.events.collect()} == expected
    fitted = counting.electron_count_frames(frames, samples=24).metadata["electron_counting"]
    values = a.astype(float)
    assert np.isclose(fitted["mean"], values.mean()) and np.isclose(fitted["std_dev"], values.std(ddof=1)) and (fitted["minimum"], fitted["maximum"]) == (values.min(), values.max())
    plain = counting.thresholds(dense_of(spark, a).pixels)
    assert np.isclose(fitted["background"], plain.background) and np.isclose(fitted["xray"], plain.xray)
    dark = np.full((8, 12), 3)
    assert np.isclose(counting.thresholds_of_frames(frames, 24, dark).mean, values.mean() - 3)
    assert np.isclose(counting.thresholds_of_frames(frames, 24, dark, np.full((8, 12), 2.0)).mean, (values.mean() - 3) / 2)
    with pytest.raises(ValueError):
        counting.thresholds_of_frames(frames.where("false"))
    with pytest.raises(ValueError):
        counting.electron_count_frames(raw.from_numpy(spark, a, (0, 0)), limits=limits)


def test_sector_index(spark, tmp_path):
    a = frames_array(6, 8, 12)
    paths = []
    for k in range(4):
        paths.append(str(tmp_path / f"module{k}.data"))
        open(paths[-1], "wb").write(b"".join(record(1, i, 3, 1, i // 2, a[i][2 * k : 2 * k + 2]) for i in reversed(range(6))))
    index = raw.read_headers(spark, paths, 5, (2, 12))
    size = 16 + 2 * 24
    assert {(r.frame_num, r.sector, r.offset) for r in index.collect()} == {(i, k, (5 - i) * size) for i in range(6) for k in range(4)}
    frames = raw.assemble(raw.read_indexed(index.where("scan_pos = 1"), 5, (2, 12)), 5, (2, 12))
    assert {r.frame_num: bytes(r.data) for r in frames.collect()} == {i: a[i].tobytes() for i in (2, 3)}
    split = raw._records(spark, paths, 24, True, split_bytes=2 * size)
    assert split.count() == 24 and split.select("path", "offset").distinct().count() == 24
    plan = plan_of(raw.assemble(raw.read_sectors(spark, paths, 5, (2, 12)), 5, (2, 12)))
    assert plan.count("Exchange hashpartitioning") == 1
    open(paths[0], "ab").write(b"cut")
    with pytest.raises(Exception, match="Unexpected EOF"):
        raw.read_sectors(spark, paths, 5, (2, 12)).collect()
    open(str(tmp_path / "other.data"), "wb").write(record(1, 0, 3, 1, 0, a[0][:2]))
    with pytest.raises(Exception, match="module<number>"):
        raw.read_headers(spark, str(tmp_path / "other.data"), 5, (2, 12)).collect()


def test_blocks_start_over(spark):
    a = frames_array(7)
    frames = raw.from_numpy(spark, a, (7, 1)).orderBy("frame_num")
    for _ in range(2):
        got = list(raw.blocks(frames, 3))
        assert [len(heads) for heads, _ in got] == [3, 3, 1] and (np.concatenate([x for _, x in got]) == a).all()
        assert got[1][0][0]["scan_pos"] == 3
    assert list(raw.blocks(frames.where("false"))) == []


def test_metadata_holds_arrays(sparse, tmp_path):
    ds, _ = sparse
    about = {"a": {"one": np.arange(5), "two": np.ones((2, 3), np.float32)}, "x": np.float64(7.21), "n": [1, {"deep": np.array([True, False])}], "s": "text"}
    tables.save_counted(ds.with_(metadata=about), str(tmp_path / "c"))
    back = tables.load_counted(ds.events.sparkSession, str(tmp_path / "c")).metadata
    assert (back["a"]["one"] == np.arange(5)).all() and back["a"]["one"].dtype == about["a"]["one"].dtype
    assert back["a"]["two"].dtype == np.float32 and back["a"]["two"].shape == (2, 3) and back["x"] == 7.21
    assert back["n"][1]["deep"].tolist() == [True, False] and back["s"] == "text"
    with pytest.raises(TypeError):
        tables.save_counted(ds.with_(metadata={"a": np.array([object()])}), str(tmp_path / "d"))


def test_image_pipelines(spark):
    a = frames_array(6)
    bright = registry.pipeline("bright", input="frame", output="image", aggregation="max")(lambda frame: frame.sum())
    frames = raw.from_numpy(spark, a, (3, 1), [0, 0, 1, 1, 2, 2])
    got = registry.execute(bright, frames)
    assert {r.scan_pos: r.value for r in got.collect()} == {p: max(a[2 * p].sum(), a[2 * p + 1].sum()) for p in range(3)}
    turned = registry.pipeline("turned", input="image", output="image")(lambda image, by=1: image[:, ::-1] * by)
    got = registry.execute(turned, got, (1, 3), by=2)
    assert [r.value for r in got.orderBy("scan_pos").collect()] == [2 * max(a[2 * p].sum(), a[2 * p + 1].sum()) for p in (2, 1, 0)]
    with pytest.raises(ValueError):
        registry.execute(turned, got)
    with pytest.raises(ValueError):
        registry.execute(registry.pipeline("no", input="image", output="frame")(lambda x: x), got, (1, 3))


def test_hdf5_says_what_is_missing(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        for read in (hdf5.read_frames, hdf5.read_counted):
            with pytest.raises(ImportError, match="h5py"):
                read(spark, "/nowhere.h5")


def test_running_pattern(spark, tmp_path):
    events = spark.createDataFrame([(0, 0, 5), (1, 0, 5), (1, 1, 7)], "scan_pos int, frame_idx int, px int")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sectors.running_pattern(stream).writeStream.format("memory").queryName("pattern").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {r.px: r.value for r in spark.table("pattern").collect()} == {5: 2, 7: 1}
