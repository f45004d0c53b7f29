"""Vector text codec and distance as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_from_text(c: Column) -> Column:
    """``[0.1,0.2]`` to an array of floats."""
    return F.from_json(c, "array<float>")


def vector_to_text(c: Column) -> Column:
    """Array of floats to ``[0.1,0.2]``."""
    return F.to_json(c)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(c: Column) -> Column:
    return F.sqrt(_dot(c, c))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of two vectors; NULL if either has no length."""
    return F.lit(1.0) - _dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance_to(a: Column, wanted: Sequence[float]) -> Column:
    """The same for one given vector, whose length is taken out beforehand."""
    length = math.sqrt(sum(x * x for x in wanted))
    if not length:
        return F.lit(None).cast("double")
    unit = F.lit([x / length for x in wanted])
    return F.lit(1.0) - _dot(a, unit) / F.nullif(norm(a), F.lit(0.0))
