"""Foot points, sides of a line, crossings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CounterConfig, Line


def foot_x(left: Column, width: Column, config: CounterConfig) -> Column:
    return (left + width / F.lit(2.0)) / F.lit(float(config.width))


def foot_y(top: Column, height: Column, config: CounterConfig) -> Column:
    return (top + height) / F.lit(float(config.height))


def line_columns(line: Line | str) -> dict[str, Column]:
    """The four numbers of a constant line, or of a struct column by name."""
    if isinstance(line, Line):
        return {k: F.lit(float(getattr(line, k))) for k in ("x1", "y1", "x2", "y2")}
    return {k: F.col(f"{line}.{k}") for k in ("x1", "y1", "x2", "y2")}


def side(line: Line | str, px: Column, py: Column) -> Column:
    """Sign tells the side of the infinite line; 0 is on it."""
    c = line_columns(line)
    return (c["x2"] - c["x1"]) * (py - c["y1"]) - (c["y2"] - c["y1"]) * (px - c["x1"])


def crosses(before: Column, after: Column) -> Column:
    """Touching counts, direction does not matter."""
    return (before == 0) | (after == 0) | ((before < 0) != (after < 0))


def crossed_line(line1: Column, line2: Column) -> Column:
    """1 or 2, null for neither; where both are crossed in one step line 1 hides line 2."""
    return F.when(line1, F.lit(1)).when(line2, F.lit(2)).cast("int")


def click_to_point(client: Column, origin: Column, extent: Column) -> Column:
    """A pointer position as a share of the canvas, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (client - origin) / extent))


def point_to_pixel(share: Column, extent: Column) -> Column:
    return share * extent


def letterbox(left: Column, top: Column, width: Column, height: Column, frame: tuple[float, float], model: tuple[float, float]) -> dict[str, Column]:
    """A box in model input coordinates: aspect kept, padded alike on both sides."""
    scale = min(model[0] / frame[0], model[1] / frame[1])
    pad_x, pad_y = (model[0] - frame[0] * scale) / 2, (model[1] - frame[1] * scale) / 2
    s = F.lit(scale)
    return {"left": left * s + F.lit(pad_x), "top": top * s + F.lit(pad_y), "width": width * s, "height": height * s}


def tiler(n: Column, width: Column, height: Column) -> dict[str, Column]:
    """Rows, columns and total size of the tiled view of ``n`` sources; more than six do not fit it."""
    rows = F.when(n <= 2, 1).otherwise(2)
    columns = F.when(n == 1, 1).when(n == 2, 2).otherwise(3)
    return {"rows": rows, "columns": columns, "total_width": width * columns, "total_height": height * rows}


def percent_encoded(text: Column) -> Column:
    """URL quoting that keeps only letters, digits, ``_.-~``; form encoding differs in three characters."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def fixed_tenths(x):
    """A number as text with one decimal, as a web page writes it: the binary value is rounded, exact ties go up.

    A product with 10 can round to a tie that the exact one is below, so the part it lost is worked out too.
    """
    ten, wide = x * 10.0, x * 134217729.0
    high = wide - (wide - x)
    lost = (high * 10.0 - ten) + (x - high) * 10.0
    part = ten - F.floor(ten)
    up = (part > 0.5) | ((part == 0.5) & (lost >= 0))
    return F.format_string("%.1f", (F.floor(ten) + F.when(up, 1).otherwise(0)) / F.lit(10.0))
