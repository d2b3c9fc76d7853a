"""Sector streams: frames put together as their four sectors arrive, in any order.

State is kept per (scan_num, frame_num).  A frame leaves when its fourth sector arrives, or
incomplete when ``timeout_ms`` passes without news; without a timeout it waits.  A sector that
is sent again after its frame has left is taken for a new frame, which a timeout ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.raw import SECTORS, SECTOR_SHAPE

OUT = "scan_num long, frame_num long, scan_pos int, frame_h int, frame_w int, complete boolean, data binary"
STATE = "scan_pos int, sectors array<int>, data array<binary>"


def assemble_stream(sectors: DataFrame, version: int = 5, shape: tuple[int, int] | None = None, timeout_ms: int | None = 60_000) -> DataFrame:
    """``frames`` from a stream of (scan_num, frame_num, scan_pos, sector, data)."""
    h, w = shape or SECTOR_SHAPE[version]
    frame = (h, w * SECTORS) if version == 4 else (h * SECTORS, w)

    def stitched(key: tuple, pos: int, parts: dict[int, bytes]) -> pd.DataFrame:
        out = np.zeros(frame, "<u2")
        for k, data in parts.items():
            own = np.frombuffer(data, "<u2").reshape(h, w)
            if version == 4:
                out[:, k * w : (k + 1) * w] = own
            else:
                out[k * h : (k + 1) * h] = own
        return pd.DataFrame({"scan_num": [key[0]], "frame_num": [key[1]], "scan_pos": [pos], "frame_h": [frame[0]], "frame_w": [frame[1]], "complete": [len(parts) == SECTORS], "data": [out.tobytes()]})

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, parts = -1, {}
        if state.exists:
            pos, ids, data = state.get
            parts = dict(zip(ids, map(bytes, data)))
        if state.hasTimedOut:
            state.remove()
            yield stitched(key, pos, parts)
            return
        for pdf in rows:
            for r in pdf.itertuples():
                pos, parts[int(r.sector)] = int(r.scan_pos), bytes(r.data)
        if len(parts) == SECTORS:
            if state.exists:
                state.remove()
            yield stitched(key, pos, parts)
        else:
            state.update((pos, list(parts), list(parts.values())))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    return sectors.groupBy("scan_num", "frame_num").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def running_pattern(events: DataFrame) -> DataFrame:
    """px, value: the diffraction pattern of a stream of counted events so far."""
    from pyspark.sql import functions as F

    return events.groupBy("px").agg(F.count(F.lit(1)).alias("value"))
