"""Comparison with the dialect's rule for NULL, and arithmetic that goes by the types of its operands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import MONEY

__all__ = ["compare", "negate", "in_list", "as_int", "add", "add_text", "subtract", "subtract_text", "multiply", "repeat_text", "divide"]

NUMERIC = ("integer", "double", "money")


def compare(a: Column, op: str, b: Column) -> Column:
    """A comparison that is false, not null, where an operand is null. In a positive conjunct of a filter the plain comparison does
    and can be pushed down; under NOT and in projections this one is needed."""
    ops = {"=": a == b, "==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
    return F.coalesce(ops[op], F.lit(False))


def negate(c: Column) -> Column:
    """NOT: null for null. Over a comparison of this dialect it is true where an operand is null."""
    return ~c


def in_list(x: Column, values: list) -> Column:
    """IN: null for a null left side; nulls in the list match nothing."""
    return F.when(x.isNotNull(), x.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False))


def as_int(c: Column) -> Column:
    """A truth value as it is projected: 1, 0 or null."""
    return c.cast("int")


def _wide(kind: str, x: Column) -> Column:
    return x.cast(MONEY) if kind == "money" else x


def _result(a: str, b: str) -> str:
    if a not in NUMERIC or b not in NUMERIC:
        raise TypeError(f"no arithmetic on {a} and {b}")
    return "money" if "money" in (a, b) else "double" if "double" in (a, b) else "integer"


def add(a: Column, b: Column, kinds: tuple[str, str] = ("integer", "integer")) -> Column:
    out = _wide(kinds[0], a) + _wide(kinds[1], b)
    return (a.cast(MONEY) + b.cast(MONEY)).cast(MONEY) if _result(*kinds) == "money" else out


def add_text(a: Column, b: Column, column: bool = True) -> Column:
    """String ``+`` anything: concatenation. A left operand that is a column loses trailing spaces."""
    return F.concat(F.rtrim(a) if column else a, b.cast("string"))


def subtract(a: Column, b: Column, kinds: tuple[str, str] = ("integer", "integer")) -> Column:
    return (a.cast(MONEY) - b.cast(MONEY)).cast(MONEY) if _result(*kinds) == "money" else a - b


def subtract_text(a: Column, b: Column) -> Column:
    """String ``-`` string: the left one without that ending, if it has it."""
    return F.when(F.endswith(a, b), F.left(a, F.greatest(F.length(a) - F.length(b), F.lit(0)))).when(b.isNotNull(), a)


def multiply(a: Column, b: Column, kinds: tuple[str, str] = ("integer", "integer")) -> Column:
    """Money times a number is rounded half away from zero to four places; money times money is an error."""
    if kinds == ("money", "money"):
        raise TypeError("money can't be multiplied by money")
    if _result(*kinds) != "money":
        return a * b
    m, x = (a, b) if kinds[0] == "money" else (b, a)
    if "integer" in kinds:
        return (m.cast(MONEY) * x.cast("decimal(10,0)")).cast(MONEY)
    return F.round(m.cast("double") * x, 4).cast(MONEY)


def repeat_text(text: Column, times: Column) -> Column:
    """String ``*`` integer, in either order."""
    return F.repeat(text, F.greatest(times, F.lit(0)).cast("int"))


def divide(a: Column, b: Column, kinds: tuple[str, str] = ("integer", "integer")) -> Column:
    """Integers divide to an integer, cut towards zero; money by an integer is cut and by a double rounded to four places; money by
    money is a double. Division by zero is an error, as Spark's ANSI mode has it."""
    kind = _result(*kinds)
    if kind == "integer":
        return F.call_function("div", a, b)
    if kind == "double":
        return a / b
    if kinds == ("money", "money"):
        return a.cast("double") / b.cast("double")
    if kinds[0] != "money":
        raise TypeError(f"{kinds[0]} can't be divided by money")
    if kinds[1] == "integer":
        q = a.cast("decimal(20,4)") * 10000 / b.cast("decimal(10,0)")
        return (F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("decimal(20,0)") / 10000).cast(MONEY)
    return F.round(a.cast("double") / b, 4).cast(MONEY)
