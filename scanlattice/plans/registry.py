"""A registry of frame and image pipelines, and the plan that runs one.

``@pipeline`` names a numpy function and says what it takes, what it gives and how frames
are aggregated; ``@parameter`` documents an argument and its default.  A frame is what the
camera saw at one position; an image has a value per scan position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kind(str, Enum):
    FRAME = "frame"
    IMAGE = "image"


class Aggregation(str, Enum):
    SUM = "sum"
    MAX = "max"
    MIN = "min"
    MEAN = "mean"
    MEDIAN = "median"


@dataclass
class Pipeline:
    function: Callable
    name: str
    description: str = ""
    input: Kind = Kind.FRAME
    output: Kind = Kind.FRAME
    aggregation: Aggregation | None = None
    parameters: dict[str, dict] = field(default_factory=dict)

    def __call__(self, *args, **kwargs):
        defaults = {k: p["default"] for k, p in self.parameters.items() if p["default"] is not None}
        return self.function(*args, **(defaults | kwargs))


REGISTRY: dict[str, Pipeline] = {}


def parameter(name: str, type: str = "float", label: str = "", description: str = "", default=None):  # noqa: A002
    def mark(function):
        own = {name: {"type": type, "label": label or name, "description": description, "default": default}}
        if isinstance(function, Pipeline):
            function.parameters = own | function.parameters
            return function
        function.__dict__.setdefault("_parameters", {}).update(own)
        return function

    return mark


def pipeline(name: str, description: str = "", input: Kind = Kind.FRAME, output: Kind = Kind.FRAME, aggregation: Aggregation | None = None):  # noqa: A002
    def mark(function) -> Pipeline:
        REGISTRY[name] = Pipeline(function, name, description, Kind(input), Kind(output), aggregation and Aggregation(aggregation), dict(getattr(function, "_parameters", {})))
        return REGISTRY[name]

    return mark


_AGGREGATE = {Aggregation.SUM: F.sum, Aggregation.MAX: F.max, Aggregation.MIN: F.min, Aggregation.MEAN: F.avg, Aggregation.MEDIAN: F.median}


def execute(which: str | Pipeline, data: DataFrame, shape: tuple[int, int] | None = None, **parameters) -> DataFrame:
    """Runs a pipeline by what it takes and gives.

    * frame to frame, over ``frames``: scan_pos, px, value; or px, value if it aggregates.
    * frame to image, over ``frames``: the function gives a number per frame; scan_pos, value,
      the frames of a position aggregated (added up unless said otherwise).
    * image to image, over (scan_pos, value) and the scan's ``shape``: scan_pos, value.  A scan's
      image is handed to the function whole, in one task.
    """
    p = REGISTRY[which] if isinstance(which, str) else which
    function, defaults = p.function, {k: v["default"] for k, v in p.parameters.items() if v["default"] is not None} | parameters
    if p.input is Kind.IMAGE:
        if p.output is not Kind.IMAGE:
            raise ValueError(f"{p.name}: an image can't become frames")
        if shape is None:
            raise ValueError(f"{p.name} takes an image; pass the scan's shape")
        return _on_image(data, shape, lambda image: function(image, **defaults))
    to_image = p.output is Kind.IMAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column("frame_h")[i].as_py(), batch.column("frame_w")[i].as_py()
                out = np.asarray(function(np.frombuffer(batch.column("data")[i].as_buffer(), "<u2").reshape(h, w), **defaults), np.float64).ravel()
                if to_image and len(out) != 1:
                    raise ValueError(f"a pipeline that gives an image returned {len(out)} values for a frame")
                yield pa.RecordBatch.from_pydict({"scan_pos": pa.array(np.full(len(out), batch.column("scan_pos")[i].as_py(), np.int32)), "px": pa.array(np.arange(len(out), dtype=np.int32)), "value": pa.array(out)})

    done = data.select("scan_pos", "frame_h", "frame_w", "data").mapInArrow(run, "scan_pos int, px int, value double")
    if to_image:
        return done.groupBy("scan_pos").agg(_AGGREGATE[p.aggregation or Aggregation.SUM]("value").alias("value"))
    return done if p.aggregation is None else done.groupBy("px").agg(_AGGREGATE[p.aggregation]("value").alias("value"))


def _on_image(image: DataFrame, shape: tuple[int, int], function: Callable) -> DataFrame:
    n = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(n)
        for batch in batches:
            whole[batch.column(0).to_numpy()] = batch.column(1).to_numpy(zero_copy_only=False)
        out = np.asarray(function(whole.reshape(shape)), np.float64).ravel()
        yield pa.RecordBatch.from_pydict({"scan_pos": pa.array(np.arange(len(out), dtype=np.int32)), "value": pa.array(out)})

    rows = image.select(F.col("scan_pos").cast("int"), F.col("value").cast("double")).repartition(1)
    return rows.mapInArrow(run, "scan_pos int, value double")
