"""Conditions, digests and other functions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["condition", "isnull", "nullif", "hash_", "hmac", "pbkdf2", "user_name", "eval_"]


def condition(c: Column, a: Column, b: Column) -> Column:
    """a if c holds, b if it doesn't, null if c is null."""
    return F.when(c.isNull(), F.lit(None)).when(c, a).otherwise(b)


def isnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def nullif(a: Column, b: Column) -> Column:
    """Null if both are equal or either is null."""
    return F.when(b.isNotNull(), F.nullif(a, b))


def hash_(algorithm: str, s: Column) -> Column:
    """md5, sha1, sha256, sha384 or sha512 in hexadecimal."""
    if algorithm == "md5":
        return F.md5(s)
    return F.sha1(s) if algorithm == "sha1" else F.sha2(s, int(algorithm.removeprefix("sha")))


def hmac(algorithm: str, s: Column, key: Column) -> Column:
    """The keyed digest in hexadecimal: the digest of the key's outer pad and the digest of its inner pad and the text (RFC 2104). Plain column
    expressions over the digests that Spark has; the key meets its pads in words of eight bytes."""
    size = 128 if algorithm in ("sha384", "sha512") else 64
    raw = F.encode(key, "UTF-8")
    long_key = F.length(raw) > size
    hexed = F.rpad(F.when(long_key, hash_(algorithm, raw)).otherwise(F.hex(raw)), 2 * size, "0")
    words = [F.conv(F.substring(hexed, i * 16 + 1, 16), 16, -10).cast("long") for i in range(size // 8)]

    def pad(byte: str) -> Column:
        with_ = F.lit(int(byte * 8, 16))
        return F.unhex(F.concat(*[F.lpad(F.hex(w.bitwiseXOR(with_)), 16, "0") for w in words]))

    inner = hash_(algorithm, F.concat(pad("36"), F.encode(s, "UTF-8")))
    return hash_(algorithm, F.concat(pad("5C"), F.unhex(inner)))


def pbkdf2(algorithm: str, s: Column, salt: Column, rounds: int, size: int) -> Column:
    """The derived key in hexadecimal."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or k is None else hashlib.pbkdf2_hmac(algorithm, t.encode(), k.encode(), rounds, size).hex() for t, k in zip(texts, salts)], dtype="object")

    return run(s, salt)


def user_name() -> Column:
    return F.current_user()


def eval_(text: str) -> Column:
    """An expression from text, in Spark's own SQL, compiled while the query is planned."""
    return F.expr(text)
