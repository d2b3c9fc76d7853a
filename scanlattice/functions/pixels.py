"""Column expressions on flat pixels and scan positions (C order, x fastest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column, by: int) -> Column:
    """Integer division; a division in doubles would be slower and is exact to 2^53 only."""
    return F.call_function("div", value, F.lit(by))


def row_of(flat: Column, width: int) -> Column:
    return whole(flat, width).cast("int")


def col_of(flat: Column, width: int) -> Column:
    return (flat % F.lit(width)).cast("int")


def flat_of(row: Column, col: Column, width: int) -> Column:
    return (row * F.lit(width) + col).cast("int")


def half_up(x: float) -> int:
    """Rounded half away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def center_of(frame_shape: tuple[int, int], center: tuple[float, float] | None) -> tuple[float, float]:
    """(x, y); a missing or negative coordinate is the rounded middle of the frame."""
    h, w = frame_shape
    x, y = center if center is not None else (-1, -1)
    return (half_up(w / 2) if x < 0 else x, half_up(h / 2) if y < 0 else y)


def distance2(px: Column, width: int, center: tuple[float, float]) -> Column:
    x, y = center
    dx, dy = col_of(px, width) - F.lit(x), row_of(px, width) - F.lit(y)
    return dx * dx + dy * dy


def in_annulus(px: Column, width: int, center: tuple[float, float], inner: float, outer: float) -> Column:
    d2 = distance2(px, width, center)
    return (d2 >= F.lit(inner * inner)) & (d2 < F.lit(outer * outer))


def wrap_u16(value: Column) -> Column:
    """What an unsigned 16-bit cell holds after storing ``value``."""
    return F.pmod(value.cast("long"), F.lit(65536))


def lossless_cast(df, column: str, to: str):
    """``df`` with ``column`` cast; ValueError if any value would change.  One pass to check."""
    own = F.col(column)
    before = dict(df.dtypes)[column]
    back = F.expr(f"try_cast(try_cast(`{column}` AS {to}) AS {before})")
    if df.where(own.isNotNull() & ~back.eqNullSafe(own)).limit(1).count():
        raise ValueError(f"{column} can't be cast to {to} without loss")
    return df.withColumn(column, own.cast(to))
