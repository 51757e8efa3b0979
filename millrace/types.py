"""Types of the dialect in Spark's terms, and its conversions.

MONEY is decimal(14,4); DATETIME is timestamp_ntz without fractions of seconds; truth values are integers 0 and 1 where
they are projected. Conversions never fail: text that isn't a number counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 4)
DATETIME = T.TimestampNTZType()
#: Names that ``convert`` takes.
NAMES = {"integer": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "money": MONEY, "datetime": DATETIME}


def money(x: Column | str | float) -> Column:
    """As MONEY, rounded half away from zero to four places."""
    return (x if isinstance(x, Column) else F.lit(x)).cast(MONEY)


def datetime(x: Column) -> Column:
    """As DATETIME, fractions of seconds cut off."""
    return F.date_trunc("SECOND", x).cast(DATETIME)


def to_integer(x: Column, kind: str = "string") -> Column:
    """Text by its leading number (decimal, 0x hexadecimal or 0 octal), others cut towards zero."""
    if kind != "string":
        return F.when(x.cast("double") < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    text = F.ltrim(x)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(text, r"^[+-]", "")
    hexadecimal = F.conv(F.regexp_extract(body, r"^0[xX]([0-9A-Fa-f]+)", 1), 16, 10)
    octal = F.conv(F.regexp_extract(body, r"^0([0-7]+)", 1), 8, 10)
    decimal = F.regexp_extract(body, r"^([0-9]+)", 1)
    digits = F.when(body.rlike(r"^0[xX][0-9A-Fa-f]"), hexadecimal).when(body.rlike(r"^0[0-7]"), octal).otherwise(decimal)
    return F.when(x.isNotNull(), F.coalesce(sign * digits.try_cast("int"), F.lit(0)))


def to_double(x: Column) -> Column:
    number = F.regexp_extract(F.ltrim(x.cast("string")), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return F.when(x.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


#: Month names by their first three letters, in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NAME = f"({'|'.join(MONTHS)})[a-z]*"
#: Dates within a text: numbers with ``/`` or ``-`` between (year first if it has three digits or more, else month, day, year), day month year, month day year.
NUMBERS, DAY_FIRST, NAME_FIRST = r"([0-9]{1,4})[/-]([0-9]{1,2})[/-]([0-9]{1,4})", rf"\b([0-9]{{1,2}})[ ,\-]+{_NAME}[ ,\-]+([0-9]{{1,4}})", rf"\b{_NAME} +([0-9]{{1,2}})[ ,]+([0-9]{{1,4}})(?![0-9:])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it takes it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_datetime(x: Column) -> Column:
    """Text with a date (``3/1/17``, ``2017-03-01``, ``1 Mar 2017``, ``March 1, 2017``) and perhaps a time (``3pm``, ``13:01``, ``1:01:59 PM``) and an offset
    (``+0600``, ``-06:00``). Years of two digits reach ten years into the future. A time with an offset becomes the session's local
    time. Fractions of seconds are dropped; text without a date, or with an impossible one, is null.

    Each pattern is looked for once in a text; what it finds is cut up without patterns' groups."""
    number = lambda c: c.try_cast("int")
    month = lambda c: F.array_position(F.array(*map(F.lit, MONTHS)), F.left(c, F.lit(3))).cast("int")
    soon = F.year(F.current_date()) - 2000 + 10
    clock, hour_only, offset = r"[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?", r"([0-9]{1,2}) *[ap]m", r"[0-9m] *([+-][0-9]{2}:?[0-9]{2}) *$"

    def dated(text: Column) -> Column:
        rest = F.regexp_replace(text, "|".join((NUMBERS, DAY_FIRST, NAME_FIRST)), " ")
        parts_of = lambda date: _let(F.split(date, "[ ,/-]+"), lambda parts: _let(rest, lambda r: _let(F.split(F.regexp_extract(r, clock, 0), ":"), lambda time: local(parts, r, time))))
        by_name = _let(F.regexp_extract(text, DAY_FIRST, 0), lambda d: F.when(d != "", d).otherwise(F.regexp_extract(text, NAME_FIRST, 0)))
        date = _let(F.regexp_extract(text, NUMBERS, 0), lambda d: F.when(d != "", d).otherwise(by_name))
        return _let(date, lambda d: F.when(d != "", parts_of(d)))

    def local(parts: Column, rest: Column, time: Column) -> Column:
        one, two, three = parts[0], parts[1], parts[2]
        name_first, day_first, year_first = one >= "a", two >= "a", F.length(one) > 2
        month_ = F.when(name_first, month(one)).when(day_first, month(two)).otherwise(number(F.when(year_first, two).otherwise(one)))
        day = number(F.when(name_first, two).when(day_first, one).when(year_first, three).otherwise(two))
        year = number(F.when(year_first & ~name_first, one).otherwise(three))
        year = _let(year, lambda y: F.when(y < soon, y + 2000).when(y < 100, y + 1900).otherwise(y))
        hour = F.coalesce(number(F.get(time, F.lit(0))), number(F.regexp_extract(rest, hour_only, 1)), F.lit(0))
        half = F.regexp_extract(rest, r"[0-9] *([ap])m", 1)
        hour = _let(F.struct(hour.alias("h"), half.alias("half")), lambda t: F.when((t["half"] == "p") & (t["h"] < 12), t["h"] + 12).when((t["half"] == "a") & (t["h"] == 12), 0).otherwise(t["h"]))
        minute, second = (F.coalesce(number(F.get(time, F.lit(i))), F.lit(0)) for i in (1, 2))
        at = F.try_make_timestamp_ntz(year, month_, day, hour, minute, second.cast("decimal(8,6)"))
        return _let(at, lambda a: _let(F.regexp_extract(rest, offset, 1), lambda o: F.when(o == "", a).otherwise(to_session(a, o))))

    def to_session(at: Column, o: Column) -> Column:
        minutes = (number(F.substring(o, 2, 2)) * 60 + number(F.right(o, F.lit(2)))) * F.when(o.startswith("-"), -1).otherwise(1)
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.timestamp_add("MINUTE", -minutes, at))

    return _let(F.lower(x), dated)


def convert(kind: str, x: Column, source: str = "string") -> Column:
    """The conversion ``convert('kind', x)``; ``source`` names the type of x."""
    if kind == "integer":
        return to_integer(x, source)
    if kind == "double":
        return to_double(x) if source == "string" else x.cast("double")
    if kind == "money":
        return money(to_double(F.regexp_replace(x, r"^\s*(-?)\$", "$1"))) if source == "string" else money(x)
    if kind == "datetime":
        return to_datetime(x) if source == "string" else datetime(x)
    if kind == "string":
        return x.cast("string")
    raise ValueError(f"no type {kind!r}; one of {', '.join(NAMES)}")
