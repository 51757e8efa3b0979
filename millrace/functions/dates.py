"""Date and time functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import MONEY

__all__ = ["getdate", "datepart", "dateadd", "datediff", "dateformat", "moneyformat"]

PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.dayofweek}


def getdate() -> Column:
    return F.localtimestamp()


def datepart(part: str, t: Column) -> Column:
    """A part of a datetime; weekdays count from Sunday, 1."""
    return PARTS[part](t)


def dateadd(part: str, n: Column, t: Column) -> Column:
    """Months and years keep the day, or the last of the month if it has no such day."""
    return F.timestamp_add(part.upper(), n, t)


def datediff(part: str, a: Column, b: Column) -> Column:
    """How many boundaries of the part lie between a and b: the end of January is one month before the first of February."""
    if part == "year":
        return F.year(b) - F.year(a)
    if part == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if part in ("day", "weekday"):
        return F.date_diff(b.cast("date"), a.cast("date"))
    return F.timestamp_diff(part.upper(), F.date_trunc(part, a), F.date_trunc(part, b))


#: The dialect's pattern pieces, longest first, and Spark's for each; none where the piece prints nothing.
PIECES = {"MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "yyyy": "yyyy", "yy": "yy", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "dd": "dd", "d": "d", "D": "", "I": "", "L": ""}


def dateformat(t: Column, pattern: str) -> Column:
    """By the dialect's pattern (``d dd ddd M MM MMM MMMM yy yyyy HH hh mm ss``); ``ddd`` is the day with its ending, 1st, 2nd.
    After ``hh`` AM or PM follows the first piece of the time that a space, a comma or the pattern's end follows."""
    out: list[Column] = []
    half_day = False
    pieces = re.findall("|".join(["ddd", *PIECES]) + "|.", pattern, re.S)
    for piece, after in zip(pieces, [*pieces[1:], ""]):
        if piece == "ddd":
            d = F.dayofmonth(t)
            ending = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
            out.append(F.concat(d.cast("string"), ending))
        elif piece in PIECES:
            if PIECES[piece]:
                out.append(F.date_format(t, PIECES[piece]))
        else:
            out.append(F.lit(piece))
        half_day = piece == "hh" or half_day and piece != "HH"
        if half_day and piece in ("hh", "mm", "ss") and after[:1] in ("", " ", ","):
            out.append(F.when(F.hour(t) < 12, "AM").otherwise("PM"))
            half_day = False
    return F.when(t.isNotNull(), F.concat(F.lit(""), *out))


#: Pieces of a money pattern that stand for a digit, and those that show the sign: for amounts of zero or more, and for less.
PLACES, SIGNS = "0#^ *", {"+": "+-", "-": " -", "(": " (", ")": " )", "[": "( ", "]": ") "}
#: What zero prints by one of these pieces.
ZEROS = {"Z": "-0-", "z": "0", "B": ""}


def moneyformat(m: Column, pattern: str) -> Column:
    """By the dialect's money pattern.

    ``0`` and ``^`` print a digit always, ``#`` none in front of the first one, ``*`` and space a space there. The first of them prints all digits that the others
    leave over. ``,`` groups; in front of the first digit it is a space, or nothing beside ``#``. ``.`` is the point, after which four digits may follow;
    decimals that the pattern has no room for are printed all the same unless they are zeros. ``$`` comes first, wherever it stands. ``+ - ( ) [ ]`` show the
    sign (``[ ]`` put parentheses around amounts that aren't negative); without any of them a minus sign stands in front. ``I`` exchanges point and
    comma; ``Z``, ``z`` and ``B`` print zero as ``-0-``, ``0`` or nothing. All else prints nothing.

    The pattern becomes one column expression while the query is planned."""
    value, negative = F.abs(m.cast(MONEY)), m < 0
    whole = F.floor(value).cast("long")
    fraction = F.round((value - whole) * 10000).cast("int")
    point, comma, zero, before = ".", ",", None, 0
    for c in pattern:
        if c == point:
            break
        before += c in PLACES
        point, comma = (",", ".") if c == "I" else (point, comma)
        zero = ZEROS.get(c, zero)
    front = [] if any(c in SIGNS for c in pattern) else [F.when(negative, "-").otherwise("")]
    front += [F.lit("$")] * pattern.count("$")
    out: list[Column] = []
    started, decimals, place = F.lit(False), False, before
    digit = lambda k: F.pmod(F.floor(fraction / F.lit(10**k)), F.lit(10)).cast("string")

    def left_over() -> None:
        """Decimals that the pattern has no room for."""
        nonlocal decimals, place
        if not decimals:
            out.append(F.when(fraction != 0, point).otherwise(""))
            decimals, place = True, 4
        while place:
            place -= 1
            out.append(F.when(F.pmod(fraction, F.lit(10 ** (place + 1))) != 0, digit(place)).otherwise(""))

    for i, c in enumerate(pattern):
        after, last = pattern[i + 1 : i + 2], pattern[i - 1 : i]
        if c in PLACES and place:
            place -= 1
            if decimals:
                out.append(digit(place))
            else:
                d = F.floor(whole / F.lit(10**place)) if place == before - 1 else F.pmod(F.floor(whole / F.lit(10**place)), F.lit(10))
                started = started | (d != 0) if c not in "0^" else F.lit(True)
                out.append(F.when(started, d.cast("string")).otherwise(" " if c in " *" else ""))
        elif c == ",":
            out.append(F.when(started, comma).otherwise("" if "#" in (last, after) else " "))
        elif c == ".":
            if not before:
                out.append(F.when(whole != 0, F.left(whole.cast("string"), F.lit(1))).otherwise(""))
            out.append(F.lit(point))
            started, decimals, place = F.lit(True), True, 4
        elif c in SIGNS:
            out.append(F.when(negative, SIGNS[c][1]).otherwise(SIGNS[c][0]))
        if after in ("", "]", ")") or after in "+-" and c in PLACES:
            left_over()
    shown = F.concat(F.lit(""), *front, *out)
    return F.when(m.isNotNull(), shown if zero is None else F.when(m == 0, zero).otherwise(shown))
