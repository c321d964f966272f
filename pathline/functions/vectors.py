"""Vectors as arrays: column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(total(F.transform(_c(v), lambda x: x * x)))


def unit(v, add: bool = False) -> Column:
    """Divided by the length, or 1e-12 if it is smaller; E2 (add): divided by the length plus 1e-12."""
    n = norm(v) + F.lit(1e-12) if add else F.greatest(norm(v), F.lit(1e-12))
    return F.transform(_c(v), lambda x: x / n)


def softmax(v, scale: float = 1.0) -> Column:
    top = F.array_max(_c(v))
    e = F.transform(_c(v), lambda x: F.exp((x - top) / scale))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def log_softmax(v, scale: float = 1.0) -> Column:
    top = F.array_max(_c(v))
    s = F.log(total(F.transform(_c(v), lambda x: F.exp((x - top) / scale))))
    return F.transform(_c(v), lambda x: (x - top) / scale - s)
