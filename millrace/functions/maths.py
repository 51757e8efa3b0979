"""Mathematical functions; null for null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["abs_", "round_", "truncate", "constrain", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sqrt", "square", "degrees", "radians", "power", "log10", "rand"]

abs_, sin, cos, tan, asin, acos, atan, atan2, sqrt, degrees, radians, log10 = F.abs, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2, F.sqrt, F.degrees, F.radians, F.log10


def round_(x: Column, places: int = 0) -> Column:
    """Half away from zero; places may be negative; the type stays."""
    return F.round(x, places)


def truncate(x: Column, places: int = 0, kind: str = "double") -> Column:
    """Towards zero. Doubles get a millionth of the last place, so that 123.123 has three places."""
    p = float(10**places) if places >= 0 else None
    d = x.cast("double")
    scaled, fuzz = (d * p if p else d / float(10**-places)), (1e-6 if kind == "double" else 1e-9)
    whole = F.when(d > 0, F.floor(scaled + fuzz)).otherwise(F.ceil(scaled - fuzz)).cast("double")
    out = whole / p if p else whole * float(10**-places)
    return {"double": out, "integer": out.cast("int"), "money": out.cast("decimal(14,4)")}[kind]


def constrain(x: Column, low: Column, high: Column) -> Column:
    """Within bounds; a null bound is none."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def square(x: Column) -> Column:
    return x * x


def power(x: Column, p: Column) -> Column:
    """Always a double."""
    return F.pow(x.cast("double"), p)


def rand(seed: int | None = None) -> Column:
    """From 0 up to 1; the sequence is Spark's own."""
    return F.rand(seed)
