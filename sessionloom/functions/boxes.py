"""Box algebra on columns or structs with x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b["w"], F.lit(0.0)) * F.greatest(b["h"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def clamp(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """The part of a box that lies in a frame, as a struct."""
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    x1, y1 = F.least(x + w, F.lit(float(width))), F.least(y + h, F.lit(float(height)))
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(x1 - x0, F.lit(0.0)).alias("w"), F.greatest(y1 - y0, F.lit(0.0)).alias("h"))


def contains(b: Column, px: Column, py: Column) -> Column:
    return (px >= b["x"]) & (px <= b["x"] + b["w"]) & (py >= b["y"]) & (py <= b["y"] + b["h"])
