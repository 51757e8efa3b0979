"""String functions. Lengths and positions count characters; ``byte_length`` counts bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "ascii", "charindex", "upper", "lower", "mixed", "char_length", "byte_length", "octet_length", "ltrim", "rtrim", "lztrim", "substring", "right", "ralign", "replicate", "reverse",
    "replace", "escape", "quote", "substitute", "wordify", "levenshtein", "lev_compare", "cos_compare", "to_hex", "from_hex", "to_base64", "from_base64",
]

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii(s: Column) -> Column:
    """The first byte; null for an empty string."""
    return F.when(s != "", F.conv(F.substring(F.hex(F.encode(s, "UTF-8")), 1, 2), 16, 10).cast("int"))


def charindex(needle: Column, hay: Column) -> Column:
    """The first place of needle in hay from 1, or 0."""
    return F.position(needle, hay)


def upper(s: Column) -> Column:
    """a-z only."""
    return F.translate(s, LETTERS[1], LETTERS[0])


def lower(s: Column) -> Column:
    """A-Z only."""
    return F.translate(s, *LETTERS)


def mixed(s: Column, words: str | None = None) -> Column:
    """Every word with a capital first letter; ``'`` and ``-`` don't end a word. A list of words (``"LLC,Mc*"``) gives the spelling
    of those, and ``Mc*`` a capital after that beginning where at least two letters follow. Of several entries that fit the first
    counts, whole words before beginnings. Plain column expressions."""
    listed = [w for w in (words or "").split(",") if w]

    def spell(word: Column, deep: bool) -> Column:
        run = lower(F.regexp_extract(word, "^[A-Za-z]*", 0))
        out = F.when(F.lit(False), word)
        for w in (w for w in listed if "*" not in w):
            out = out.when(run == w.lower(), F.concat(F.lit(w), lower(F.substring(word, len(w) + 1, 1 << 30))))
        for head in (w[: w.index("*")] for w in listed if "*" in w):
            rest = F.substring(word, len(head) + 1, 1 << 30)
            out = out.when(F.startswith(run, F.lit(head.lower())) & (F.length(run) > len(head) + 1), F.concat(F.lit(head), spell(rest, False) if deep else lower(rest)))
        return out.otherwise(F.concat(upper(F.substring(word, 1, 1)), lower(F.substring(word, 2, 1 << 30))))

    pieces = F.regexp_extract_all(s, F.lit("[A-Za-z][A-Za-z'\\-]*|[^A-Za-z]+"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[A-Za-z]"), spell(p, True)).otherwise(p)), "")


def char_length(s: Column) -> Column:
    return F.char_length(s)


def byte_length(s: Column) -> Column:
    """What the dialect's ``char_length`` counts in text that isn't ASCII."""
    return F.octet_length(s)


def octet_length(x: Column, kind: str = "string") -> Column:
    """Bytes by type: text by its bytes, an integer 4, a double 8, a money value 8, a datetime 8."""
    sizes = {"integer": 4, "double": 8, "money": 8, "datetime": 8}
    return F.octet_length(x) if kind == "string" else F.when(x.isNotNull(), F.lit(sizes[kind]))


def ltrim(s: Column) -> Column:
    """Spaces only."""
    return F.ltrim(s)


def rtrim(s: Column) -> Column:
    return F.rtrim(s)


def lztrim(s: Column) -> Column:
    """Leading zeros go as long as a digit follows."""
    return F.regexp_replace(s, r"^0+(?=[0-9])", "")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From 1; a start before 1 is 1, a negative length gives an empty string."""
    at = F.greatest(start, F.lit(1))
    if length is None:
        return F.when(start.isNotNull(), F.substring(s, at, F.length(s)))
    return F.when(start.isNotNull() & length.isNotNull(), F.substring(s, at, F.greatest(length, F.lit(0))))


def right(s: Column, n: Column) -> Column:
    return F.right(s, F.greatest(n, F.lit(0)))


def ralign(s: Column, n: Column) -> Column:
    """Spaces in front up to a width; longer strings stay."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, F.lit(" ")))


def replicate(s: Column, n: Column) -> Column:
    """At most 255 copies; null for a negative number."""
    return F.when(n >= 0, F.repeat(s, F.least(n, F.lit(255)).cast("int")))


def reverse(s: Column) -> Column:
    return F.reverse(s)


def replace(s: Column, find: Column, by: Column) -> Column:
    """A null replacement is empty; nothing is found by an empty string."""
    return F.when(find == "", s).otherwise(F.replace(s, find, F.coalesce(by, F.lit(""))))


def escape(s: Column, chars: str, bad: str = "") -> Column:
    """A backslash before each of ``chars`` and each backslash; a string with one of ``bad`` is an error."""
    out = F.regexp_replace(s, "([" + re.escape(chars + "\\") + "])", r"\\$1")
    return F.when(s.rlike("[" + re.escape(bad) + "]"), F.raise_error("character not allowed").cast("string")).otherwise(out) if bad else out


def quote(s: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))


def _is_set(c: Column, kind: str) -> Column:
    empty = F.trim(c) == "" if kind == "string" else c == 0 if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(False)
    return c.isNotNull() & ~F.coalesce(empty, F.lit(False))


def substitute(template: str, columns: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """Fill a template: ``[:a]`` or ``[:obj:a]`` is a value, ``[+:a,:b]..[/]`` text if any is set, ``[-:a]..[/]`` if unset and
    ``[?:a=V]..[/]`` if it has that value. ``columns`` names what the template may use (``"a"``, ``"obj:a"``), ``kinds`` their Spark types
    (default string). The template becomes one column expression while the query is planned. A null value is empty.
    """
    kinds = kinds or {}
    tokens = re.split(r"(\[[^\]]*\])", template)

    def find(name: str) -> str:
        name = name.strip().lstrip(":")
        if name not in columns:
            raise ValueError(f"the template's {name!r} isn't among the columns")
        return name

    def build(at: int) -> tuple[list[Column], int]:
        parts: list[Column] = []
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if not (t.startswith("[") and t.endswith("]")):
                parts += [F.lit(t)] * bool(t)
            elif t.startswith("[/"):
                return parts, at
            elif t.startswith("[:"):
                parts.append(F.coalesce(columns[find(t[1:-1])].cast("string"), F.lit("")))
            elif t[1:2] in "+-?":
                inner, at = build(at)
                names = t[2:-1]
                if t[1] == "?":
                    name, _, value = names.partition("=")
                    when = F.coalesce(columns[find(name)].cast("string") == value, F.lit(False))
                else:
                    each = [_is_set(columns[find(n)], kinds.get(find(n), "string")) for n in names.split(",")]
                    when = each[0]
                    for e in each[1:]:
                        when = when | e
                    when = ~when if t[1] == "-" else when
                parts.append(F.when(when, F.concat(F.lit(""), *inner)).otherwise(""))
            else:
                parts.append(F.lit(t))
        return parts, at

    return F.concat(F.lit(""), *build(0)[0])


#: Number words in fixed spelling.
ONES = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
TENS = "Zero Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()
SCALES = ["", "Thousand", "Million", "Billion", "Trillion", "Quadrillion"]


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def wordify(x: Column, kind: str = "integer") -> Column:
    """A number in words; money with its hundredths (``Twenty-One and 01/100``). Plain column expressions."""
    whole = F.abs(x.cast("decimal(20,4)"))
    n = F.floor(whole).cast("long")

    def below_thousand(v: Column) -> Column:
        hundreds, rest = F.floor(v / 100).cast("int"), F.pmod(v, F.lit(100)).cast("int")
        tens, ones = F.floor(rest / 10).cast("int"), F.pmod(rest, F.lit(10)).cast("int")
        small = F.when(rest < 20, F.get(_array(ONES), rest)).when(ones == 0, F.get(_array(TENS), tens)).otherwise(F.concat_ws("-", F.get(_array(TENS), tens), F.get(_array(ONES), ones)))
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(F.get(_array(ONES), hundreds), F.lit(" Hundred"))), F.when(rest > 0, small))

    parts = []
    for k in range(5, -1, -1):
        group = F.pmod(F.floor(n / F.lit(1000**k)), F.lit(1000)).cast("int")
        parts.append(F.when(group > 0, F.concat_ws(" ", below_thousand(group), F.lit(SCALES[k]) if k else F.lit(None).cast("string"))))
    words = F.when(n == 0, F.lit("Zero")).otherwise(F.concat_ws(" ", *parts))
    out = F.concat_ws(" ", F.when(x < 0, F.lit("Negative")), words)
    if kind == "money":
        cents = F.floor((whole - n) * 100).cast("int")
        out = F.concat(out, F.lit(" and "), F.lpad(cents.cast("string"), 2, "0"), F.lit("/100"))
    return F.when(x.isNotNull(), out)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def lev_compare(a: Column, b: Column, width: int = 0) -> Column:
    """Likeness from 0 to 1: one less the distance by the longer length. An empty string gives one half. If one string only has
    characters more than the other, the distance counts half; a field width of at least the longer length eases short differences."""
    d, la, lb = F.levenshtein(a, b).cast("double"), F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    share = d / longest
    share = F.when(F.abs(la - lb) == d, share / 2).otherwise(share)
    if width:
        ease = (d + width * 0.75) / width
        share = F.when((longest <= width) & (ease < 1), share * ease).otherwise(share)
    return F.when((la == 0) | (lb == 0), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.5))).otherwise(1 - share)


#: Fixed values of the likeness: bins that pairs of bytes are hashed to, what stands before and after a string, what is added to digits' codes, and
#: the modulus of the weights.
PAIR_BINS, EDGE, DIGITS_UP, WEIGHTS = 251, 96, 75, 13
#: Bytes that are skipped: ASCII white space and punctuation.
SKIPPED = [b for b in range(128) if 9 <= b <= 13 or 32 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126]


def _pairs(s: Column) -> Column:
    """(bin, weight) of each pair of neighbouring bytes, those of either end with EDGE."""
    hexed = F.hex(F.encode(lower(s), "UTF-8"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    codes = F.transform(F.filter(bytes_, lambda b: ~b.isin(SKIPPED)), lambda b: F.when(b.between(48, 57), b + DIGITS_UP).otherwise(b))
    edge = F.array(F.lit(EDGE))

    def pair(p: Column) -> Column:
        x, y = p["x"].cast("double"), p["y"].cast("double")
        value = (x * x * x + y * y * y) * ((x + 1) / (y + 1))
        bin_ = F.pmod(F.floor(value + 0.5) - 1, F.lit(PAIR_BINS))
        return F.struct(bin_.alias("bin"), (F.pmod(p["x"] + p["y"], F.lit(WEIGHTS)) + 1).cast("long").alias("weight"))

    return F.transform(F.arrays_zip(F.concat(edge, codes).alias("x"), F.concat(codes, edge).alias("y")), pair)


def cos_compare(a: Column, b: Column) -> Column:
    """Likeness from 0 to 1: the cosine of two weighted counts of neighbouring bytes. ASCII punctuation and white space are skipped
    and case of A-Z doesn't count; equal strings give 1. Plain column expressions: meant for names, as its work grows with the square of a length."""
    at = lambda pairs, bin_: F.aggregate(F.filter(pairs, lambda p: p["bin"] == bin_), F.lit(0).cast("long"), lambda n, p: n + p["weight"])
    bins = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["bin"]))
    dot = lambda x, y: F.aggregate(bins(x), F.lit(0).cast("long"), lambda n, k: n + at(x, k) * at(y, k))
    x, y = _pairs(a), _pairs(b)
    likeness = dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(a == b, F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), likeness)


def to_hex(s: Column) -> Column:
    return F.lower(F.hex(F.encode(s, "UTF-8")))


def from_hex(s: Column) -> Column:
    return F.decode(F.unhex(s), "UTF-8")


def to_base64(s: Column) -> Column:
    return F.base64(F.encode(s, "UTF-8"))


def from_base64(s: Column) -> Column:
    return F.decode(F.unbase64(s), "UTF-8")
