"""Vector column expressions over array<float>, summed in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import col


def literal(vector) -> Column:
    return F.expr(f"array({', '.join(number(x) for x in vector)})")


def number(x) -> str:
    """A double as SQL."""
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)}')"


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a) -> Column:
    length = norm(a)
    return F.transform(col(a), lambda x: F.when(length > 0, x / length).otherwise(x).cast("float"))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance) -> Column:
    """Score of a squared distance between unit vectors: the cosine, not below 0."""
    return F.greatest(F.lit(0.0), 1 - col(distance) / 2)
