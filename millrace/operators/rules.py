"""Column rules: presentation hints as checks, request parameters as filters, and masking of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_hints(df: DataFrame, hints: dict[str, dict]) -> DataFrame:
    """Add ``violations``, an array of ``column:rule`` of what a row breaks. Rules: required, min, max, length, enum, constraint (a column
    expression that must hold). All but ``required`` pass null."""
    checks = []
    for name, rules in hints.items():
        c = F.col(name)
        tests = {
            "required": lambda v: c.isNull() if v else F.lit(False), "min": lambda v: c < F.lit(v), "max": lambda v: c > F.lit(v),
            "length": lambda v: F.length(c) > v, "enum": lambda v: ~c.isin(list(v)), "constraint": lambda v: ~v,
        }
        checks += [F.when(F.coalesce(tests[r](v), F.lit(False)), F.lit(f"{name}:{r}")) for r, v in rules.items() if r != "default"]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def apply_defaults(df: DataFrame, hints: dict[str, dict]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(r["default"])) for n, r in hints.items() if "default" in r})


def request_filter(df: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """Rows by request parameters: ``a=v`` equal, ``a=*v*`` containing, ``a=v*`` starting with, ``a=*v`` ending with."""
    for name, value in parameters.items():
        c = F.col(name).cast("string")
        body = value.strip("*")
        if value.startswith("*") and value.endswith("*") and len(value) > 1:
            df = df.where(F.contains(c, F.lit(body)))
        elif value.endswith("*"):
            df = df.where(F.startswith(c, F.lit(body)))
        elif value.startswith("*"):
            df = df.where(F.endswith(c, F.lit(body)))
        else:
            df = df.where(F.col(name) == F.lit(value).cast(dict(df.dtypes)[name]))
    return df


def obfuscate(df: DataFrame, key: str, rules: dict[str, str], table: str = "", words: list[str] | None = None) -> DataFrame:
    """Mask columns: the same value always gives the same mask, of the same type. ``rules`` gives each column's inputs to the hash by letters:
    K key, A column name, N table name, V value. Whole numbers stay as long as they are, other numbers lie
    anywhere between -10,000 and 10,000 in hundredths, dates move within a year, digits stay digits, other text becomes words (of ``words``) or letters of its own length. Nulls stay null. Plain column expressions.
    """
    kinds = dict(df.dtypes)

    def masked(name: str, letters: str) -> Column:
        c, kind = F.col(name), kinds[name]
        inputs = {"K": F.lit(key), "A": F.lit(name), "N": F.lit(table), "T": F.lit(table), "V": c.cast("string")}
        once = [inputs[x] for x in letters]
        digest = F.sha1(F.concat_ws("|", *once, *once))
        number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        if kind in ("int", "bigint", "smallint"):
            size = F.pow(F.lit(10.0), F.length(F.abs(c).cast("string"))).cast("long")
            return (F.when(c < 0, -1).otherwise(1) * F.pmod(number, size)).cast(kind)
        if kind == "double" or kind.startswith("decimal"):
            return ((F.pmod(number, F.lit(2_000_001)) - 1_000_000) / 100).cast(kind)
        if kind.startswith("timestamp") or kind == "date":
            return F.timestamp_add("DAY", F.pmod(number, F.lit(365)).cast("int") - 182, c).cast(kind)
        letters_only = F.translate(F.substring(F.repeat(digest, F.ceil(F.length(c) / 40).cast("int") + 1), F.lit(1), F.length(c)), "0123456789", "ghijklmnop")
        digits = F.translate(F.substring(F.repeat(digest, F.ceil(F.length(c) / 40).cast("int") + 1), F.lit(1), F.length(c)), "abcdef", "012345")
        word = F.get(F.array(*map(F.lit, words)), F.pmod(number, F.lit(len(words))).cast("int")) if words else letters_only
        return F.when(c.rlike("^[0-9]+$"), digits).otherwise(word)

    return df.withColumns({n: F.when(F.col(n).isNotNull(), masked(n, r)) for n, r in rules.items()})
