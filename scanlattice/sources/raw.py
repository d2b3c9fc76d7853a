"""Raw detector files as ``frames``: one row per image.

scan_num, frame_num, scan_pos, scan_w, scan_h, frame_h, frame_w, complete, data (BINARY,
little-endian unsigned 16-bit).  Files are listed by Spark and read by range where the rows
are made.  Formats 3 to 5 are fixed-length records, so files are split at record boundaries;
formats 1 and 2 are read block by block, a file a task.  Headers can be read without the pixel
data, with the place of every record, and single records by their place.  Sectors of formats 4
and 5 meet in one aggregation by frame.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import whole

#: Fixed values of the detector and its file formats.
FRAME = (576, 576)
SECTORS = 4
SECTOR_SHAPE = {4: (576, 144), 5: (144, 576)}  # (rows, columns) of a sector
V1_HEADER_WORDS = 1024
V2_IMAGES = 1600
RECORD_HEADER = np.dtype([("scan", "<u4"), ("frame", "<u4"), ("scan_w", "<u2"), ("scan_h", "<u2"), ("x", "<u2"), ("y", "<u2")])

_FRAMES = "scan_num long, frame_num long, scan_pos int, scan_w int, scan_h int, frame_h int, frame_w int, complete boolean, data binary"
_HEADERS = "scan_num long, frame_num long, scan_pos int, scan_w int, scan_h int"
_PLACE = "path string, offset long, "
#: Bytes of a file that a task reads, of pixel data in a batch, and the most tasks.
SPLIT, BATCH, MOST_SPLITS = 128 << 20, 16 << 20, 100_000


def _paths(paths: str | Sequence[str]) -> list[str]:
    out = [paths] if isinstance(paths, str) else list(paths)
    if not out:
        raise ValueError("no files to read")
    return out


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, length: as Spark lists them; no content is read."""
    return spark.read.format("binaryFile").load(_paths(paths)).select("path", "length")


def _open(path: str):
    """A file for reading by range, in any store that the path names."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _exactly(file, n: int) -> bytes:
    got = file.read(n)
    if len(got) < n:
        raise ValueError("Unexpected EOF")
    return got


def _heads(raw: list[bytes]) -> dict[str, pa.Array]:
    head = np.frombuffer(b"".join(raw), RECORD_HEADER)
    return {
        "scan_num": pa.array(head["scan"].astype("i8")),
        "frame_num": pa.array(head["frame"].astype("i8")),
        "scan_pos": pa.array((head["y"].astype("i4") * head["scan_w"] + head["x"]).astype("i4")),
        "scan_w": pa.array(head["scan_w"].astype("i4")),
        "scan_h": pa.array(head["scan_h"].astype("i4")),
    }


def _records(spark: SparkSession, paths: str | Sequence[str], pixels: int, with_data: bool, split_bytes: int = SPLIT) -> DataFrame:
    """path, offset, the header's fields and, if asked for, data of every record of the files."""
    length = RECORD_HEADER.itemsize + 2 * pixels
    each = max(1, split_bytes // length)
    files = _files(spark, paths)
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), whole(F.greatest(F.col("length") - 1, F.lit(0)), each * length))).alias("k"))
    n = files.agg(F.sum(whole(F.col("length"), each * length) + 1)).first()[0] or 1
    splits = splits.select("path", "length", (F.col("k") * each * length).alias("start")).repartition(int(min(n, MOST_SPLITS)))
    batch_rows = max(1, min(256, BATCH // length)) if with_data else 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                if size % length:
                    raise ValueError(f"Unexpected EOF: {path} ends inside a record")
                with _open(path) as file:
                    end = min(size, start + each * length)
                    for at in range(start, end, batch_rows * length):
                        offsets = range(at, min(end, at + batch_rows * length), length)
                        heads, data = [], []
                        for offset in offsets:
                            file.seek(offset)
                            heads.append(_exactly(file, RECORD_HEADER.itemsize))
                            if with_data:
                                data.append(_exactly(file, 2 * pixels))
                        out = {"path": pa.array([path] * len(offsets)), "offset": pa.array(offsets, pa.int64()), **_heads(heads)}
                        yield pa.RecordBatch.from_pydict(out | ({"data": pa.array(data, pa.binary())} if with_data else {}))

    return splits.mapInArrow(run, _PLACE + _HEADERS + ", data binary" * with_data)


def _blocks(version: int, frame: tuple[int, int]):
    """Formats 1 and 2: paths to frames, a few at a time."""

    def images(file, size: int) -> Iterator[tuple]:
        at = 0
        while at < size:
            if version == 1:
                head = np.frombuffer(_exactly(file, 4 * V1_HEADER_WORDS), "<u4")
                n, h, w = (int(x) for x in head[:3])
                numbers, at = head[10 : 10 + n].astype("i8") - 1, at + 4 * V1_HEADER_WORDS
            else:
                _exactly(file, 4)  # the file's first number is not used
                n, (h, w), at = V2_IMAGES, frame, at + 4
                numbers = np.arange(n)
            for i in range(n):
                yield 0, i, int(numbers[i]), 0, 0, h, w, True, _exactly(file, 2 * h * w)
            at += n * 2 * h * w

    names = [f.split()[0] for f in _FRAMES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as file:
                    every = images(file, size)
                    while rows := list(itertools.islice(every, 16)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_blocks(spark: SparkSession, paths: str | Sequence[str], version: int, frame: tuple[int, int] = FRAME) -> DataFrame:
    """Formats 1 and 2."""
    files = _files(spark, paths)
    return files.repartition(max(1, min(files.count(), MOST_SPLITS))).mapInArrow(_blocks(version, frame), _FRAMES)


def read_frames_v3(spark: SparkSession, paths: str | Sequence[str], frame: tuple[int, int] = FRAME) -> DataFrame:
    """Format 3: whole frames with their position."""
    h, w = frame
    found = _records(spark, paths, h * w, True)
    return found.select("scan_num", "frame_num", "scan_pos", "scan_w", "scan_h", F.lit(h).alias("frame_h"), F.lit(w).alias("frame_w"), F.lit(True).alias("complete"), "data")


def sector_of(path: str) -> int:
    """The number in a file name's ``module<number>``."""
    found = re.search(r"module(\d+)", path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no module<number> in the file name {path}")
    return int(found[1])


def _sector() -> Column:
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"module(\d+)", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("no module<number> in the file name "), "path"))).otherwise(number).cast("int")


def read_sectors(spark: SparkSession, paths: str | Sequence[str], version: int = 5, shape: tuple[int, int] | None = None) -> DataFrame:
    """Formats 4 and 5: scan_num, frame_num, scan_pos, scan_w, scan_h, sector, data."""
    h, w = shape or SECTOR_SHAPE[version]
    return _records(spark, paths, h * w, True).select("scan_num", "frame_num", "scan_pos", "scan_w", "scan_h", _sector().alias("sector"), "data")


def read_headers(spark: SparkSession, paths: str | Sequence[str], version: int = 5, shape: tuple[int, int] | None = None) -> DataFrame:
    """The index of sectors: scan_num, frame_num, scan_pos, scan_w, scan_h, sector, path, offset.

    Only headers are read.  Write it to look up (scan_pos, frame_num) without a pass over the
    files, and hand what is found to ``read_indexed``.
    """
    h, w = shape or SECTOR_SHAPE[version]
    return _records(spark, paths, h * w, False).select("scan_num", "frame_num", "scan_pos", "scan_w", "scan_h", _sector().alias("sector"), "path", "offset")


def read_indexed(index: DataFrame, version: int = 5, shape: tuple[int, int] | None = None) -> DataFrame:
    """The sectors of some rows of ``read_headers``: only their bytes are read."""
    h, w = shape or SECTOR_SHAPE[version]
    fields = ["scan_num", "frame_num", "scan_pos", "scan_w", "scan_h", "sector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, data = batch.slice(start, 64), []
                order = sorted(zip(part.column("path").to_pylist(), part.column("offset").to_pylist(), range(part.num_rows)))
                for path, own in itertools.groupby(order, lambda x: x[0]):
                    with _open(path) as file:
                        for _, offset, row in own:
                            file.seek(offset + RECORD_HEADER.itemsize)
                            data.append((row, _exactly(file, 2 * h * w)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in fields), pa.array([d for _, d in sorted(data)], pa.binary())], names=[*fields, "data"])

    return index.select(*fields, "path", "offset").mapInArrow(run, _HEADERS + ", sector int, data binary")


def stitch_sector(i, sector, version: int, sector_shape: tuple[int, int]):
    """The frame's pixel of pixel ``i`` of a sector: columns side by side in format 4, rows
    one below the other in format 5."""
    h, w = sector_shape
    if version == 4:
        return (whole(i, w) * F.lit(w * SECTORS) + sector * F.lit(w) + i % F.lit(w)).cast("int")
    return (sector * F.lit(h * w) + i).cast("int")


def assemble(sectors: DataFrame, version: int = 5, shape: tuple[int, int] | None = None, partial: bool = True) -> DataFrame:
    """``frames`` from sectors, keyed by frame number; missing sectors are zero.

    One exchange: a frame's sectors are gathered, four at most but for repeats.  ``partial``: whether frames with fewer than four sectors are kept (complete = false).
    """
    h, w = shape or SECTOR_SHAPE[version]
    frame = (h, w * SECTORS) if version == 4 else (h * SECTORS, w)
    grouped = sectors.groupBy("scan_num", "frame_num").agg(
        F.first("scan_pos").alias("scan_pos"), F.first("scan_w").alias("scan_w"), F.first("scan_h").alias("scan_h"), F.collect_list(F.struct("sector", "data")).alias("parts")
    ).withColumn("n", F.size(F.array_distinct(F.transform("parts", lambda p: p["sector"]))))
    if not partial:
        grouped = grouped.where(F.col("n") == SECTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for parts in batch.column("parts").to_pylist():
                out = np.zeros(frame, "<u2")
                for p in parts:
                    own, k = np.frombuffer(p["data"], "<u2").reshape(h, w), p["sector"]
                    if version == 4:
                        out[:, k * w : (k + 1) * w] = own
                    else:
                        out[k * h : (k + 1) * h] = own
                data.append(out.tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("scan_num", "frame_num", "scan_pos", "scan_w", "scan_h")), pa.array([frame[0]] * n, pa.int32()), pa.array([frame[1]] * n, pa.int32()), pa.array([k == SECTORS for k in batch.column("n").to_pylist()]), pa.array(data, pa.binary())],
                names=[f.split()[0] for f in _FRAMES.split(", ")],
            )

    return grouped.mapInArrow(run, _FRAMES)


def reader(spark: SparkSession, paths: str | Sequence[str], version: int = 1, backend: str | None = None, **options) -> DataFrame:
    """``frames`` of raw files of any format.

    ``backend`` for formats 4 and 5: None and 'multi-pass' keep partial frames, 'thread'
    drops them.  'multi-pass' is for format 5 only.
    """
    if version in (4, 5):
        if backend not in (None, "thread", "multi-pass"):
            raise ValueError(f"unknown backend: {backend}")
        if backend == "multi-pass" and version != 5:
            raise ValueError("the multi-pass backend reads format 5 only")
        return assemble(read_sectors(spark, _paths(paths), version, options.get("shape")), version, options.get("shape"), partial=backend != "thread")
    if version == 3:
        return read_frames_v3(spark, paths, options.get("frame", FRAME))
    if version in (1, 2):
        return read_blocks(spark, paths, version, options.get("frame", FRAME))
    raise ValueError(f"unknown version: {version}")


def blocks(frames: DataFrame, size: int = 32) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of at most ``size`` frames for a loop on the driver: (rows without data, array of
    (n, h, w)).  One partition is held at a time; calling it again starts over."""
    rows: list = []

    def block() -> tuple[list, np.ndarray]:
        shape = (len(rows), rows[0].frame_h, rows[0].frame_w)
        heads = [{k: v for k, v in r.asDict().items() if k != "data"} for r in rows]
        return heads, np.frombuffer(b"".join(bytes(r.data) for r in rows), "<u2").reshape(shape)

    for row in frames.toLocalIterator(prefetchPartitions=False):
        if rows and (len(rows) == size or (row.frame_h, row.frame_w) != (rows[0].frame_h, rows[0].frame_w)):
            yield block()
            rows = []
        rows.append(row)
    if rows:
        yield block()


def frames_per_scan(frames: DataFrame) -> DataFrame:
    """One row, ``frames_per_scan``: the most frames of any position."""
    return frames.groupBy("scan_pos").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("frames_per_scan"))


def scan_shape(frames: DataFrame) -> tuple[int, int]:
    """(rows, columns) of the scan, from any one header."""
    r = frames.select("scan_h", "scan_w").first()
    return r.scan_h, r.scan_w


def data_captured(headers: DataFrame) -> DataFrame:
    """One row, ``fraction``: sectors present of those that the scan needs."""
    return headers.agg((F.count(F.lit(1)) / (F.max("scan_w") * F.max("scan_h") * F.lit(float(SECTORS)))).alias("fraction"))


def read_frames(frames: DataFrame, scan_position: int | tuple[int, int], shape: tuple[int, int], frames_slice=None) -> DataFrame:
    """The frames of one position in order of frame number, with frame_idx; the filter on
    scan_pos reaches the source."""
    from pyspark.sql import Window

    if isinstance(scan_position, tuple):
        r, c = scan_position
        if not (0 <= r < shape[0] and 0 <= c < shape[1]):
            raise IndexError(f"scan position {scan_position} is outside {shape}")
        scan_position = r * shape[1] + c
    if not 0 <= scan_position < shape[0] * shape[1]:
        raise IndexError(f"scan position {scan_position} is outside {shape}")
    own = frames.where(F.col("scan_pos") == scan_position)
    own = own.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("scan_pos").orderBy("frame_num")) - 1).cast("int"))
    if frames_slice is None:
        return own
    if isinstance(frames_slice, bool) or not isinstance(frames_slice, (int, slice, list)):
        raise IndexError(f"bad frame selection: {frames_slice!r}")
    n = frames.where(F.col("scan_pos") == scan_position).count()
    wanted = [frames_slice] if isinstance(frames_slice, int) else list(range(*frames_slice.indices(n))) if isinstance(frames_slice, slice) else frames_slice
    if any(not -n <= k < n for k in wanted):
        raise IndexError(f"frame index out of bounds: position {scan_position} has {n} frames")
    return own.where(F.col("frame_idx").isin([k % n for k in wanted]))


def from_numpy(spark: SparkSession, data: np.ndarray, scan_dimensions: tuple[int, int], scan_positions=None) -> DataFrame:
    """``frames`` from an array (n, h, w); scan_dimensions is (width, height)."""
    import pandas as pd

    n, h, w = data.shape
    pos = np.arange(n) if scan_positions is None else np.asarray(scan_positions)
    pdf = pd.DataFrame({"scan_num": 0, "frame_num": np.arange(n), "scan_pos": pos.astype("i4"), "scan_w": scan_dimensions[0], "scan_h": scan_dimensions[1], "frame_h": h, "frame_w": w, "complete": True, "data": [np.ascontiguousarray(f, "<u2").tobytes() for f in data]})
    return spark.createDataFrame(pdf, _FRAMES)


def pixels_of(frames: DataFrame) -> DataFrame:
    """scan_pos, frame_num, px, value of small frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("data")[i].as_buffer(), "<u2").astype("i8")
                n = len(v)
                yield pa.RecordBatch.from_pydict({"scan_pos": pa.array([batch.column("scan_pos")[i].as_py()] * n, pa.int32()), "frame_num": pa.array([batch.column("frame_num")[i].as_py()] * n, pa.int64()), "px": pa.array(np.arange(n, dtype="i4")), "value": pa.array(v)})

    return frames.select("scan_pos", "frame_num", "data").mapInArrow(run, "scan_pos int, frame_num long, px int, value long")
