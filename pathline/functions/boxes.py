"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iou(a, b) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2 each); 1e-12 keeps empty boxes from dividing by 0."""
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda p: (p[2] - p[0]) * (p[3] - p[1])
    return w * h / (area(a) + area(b) - w * h + F.lit(1e-12))


def to_centre(x1, y1, x2, y2) -> Column:
    """Corners to a struct of centre x and y, area s and ratio r; r is 0 for a box without height."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    w, h = x2 - x1, y2 - y1
    return F.struct((x1 + w / 2).alias("x"), (y1 + h / 2).alias("y"), (w * h).alias("s"), F.when(h != 0, w / h).otherwise(0.0).alias("r"))


def to_corners(z) -> Column:
    """The inverse of `to_centre`; a box without width has no height either."""
    z = _c(z)
    w = F.sqrt(F.greatest(z["s"] * z["r"], F.lit(0.0)))
    h = F.when(w != 0, z["s"] / w).otherwise(0.0)
    return F.struct((z["x"] - w / 2).alias("x1"), (z["y"] - h / 2).alias("y1"), (z["x"] + w / 2).alias("x2"), (z["y"] + h / 2).alias("y2"))
