"""Functions and operators on literals, nulls and edge values."""

import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import types


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


def money(x):
    return types.money(F.lit(x))


def cases():
    NULL, NULLI = L(None).cast("string"), L(None).cast("int")
    return {
        "compare_null": (fn.compare(NULLI, "=", L(1)), False),
        "not_compare_null": (fn.negate(fn.compare(NULLI, "=", L(1))), True),
        "in_null": (fn.in_list(NULLI, [1]), None),
        "in_list_null": (fn.in_list(L(2), [1, None]), False),
        "in_empty": (fn.in_list(L(2), []), False),
        "int_divide": (fn.divide(L(-5), L(2)), -2),
        "double_divide": (fn.divide(L(5), L(2.0), ("integer", "double")), 2.5),
        "money_by_int": (fn.divide(money("5.00"), L(2), ("money", "integer")), Decimal("2.5000")),
        "money_by_int_cut": (fn.divide(money("-1.00"), L(3), ("money", "integer")), Decimal("-0.3333")),
        "money_by_double": (fn.divide(money("5.00"), L(2.0), ("money", "double")), Decimal("2.5000")),
        "money_by_money": (fn.divide(money("5.00"), money("2.00"), ("money", "money")), 2.5),
        "divide_null": (fn.divide(L(2), NULLI), None),
        "money_times": (fn.multiply(money("1.1"), L(3), ("money", "integer")), Decimal("3.3000")),
        "money_plus": (fn.add(money("1.1"), L(3), ("money", "integer")), Decimal("4.1000")),
        "money_minus": (fn.subtract(L(3), money("1.1"), ("integer", "money")), Decimal("1.9000")),
        "text_plus": (fn.add_text(L("ab  "), L(1)), "ab1"),
        "text_plus_literal": (fn.add_text(L("ab "), L(1), column=False), "ab 1"),
        "text_minus": (fn.subtract_text(L("abc"), L("bc")), "a"),
        "text_minus_other": (fn.subtract_text(L("abc"), L("ab")), "abc"),
        "text_minus_longer": (fn.subtract_text(L("b"), L("abc")), "b"),
        "text_minus_null": (fn.subtract_text(L("b"), NULL), None),
        "text_times": (fn.repeat_text(L("ab"), L(3)), "ababab"),
        "ascii_empty": (fn.ascii(L("")), None),
        "ascii": (fn.ascii(L("A")), 65),
        "charindex": (fn.charindex(L("b"), L("abc")), 2),
        "charindex_none": (fn.charindex(L("x"), L("abc")), 0),
        "upper": (fn.upper(L("aé")), "Aé"),
        "lower": (fn.lower(L("AÉ")), "aÉ"),
        "mixed": (fn.mixed(L("o'NEILL and JEAN-luc 3rd st")), "O'neill And Jean-luc 3Rd St"),
        "mixed_words": (fn.mixed(L("ACME LLC mcdonald MCD"), "LLC,Mc*"), "Acme LLC McDonald Mcd"),
        "mixed_null": (fn.mixed(NULL), None),
        "char_length": (fn.char_length(L("é")), 1),
        "byte_length": (fn.byte_length(L("é")), 2),
        "octet_length": (fn.octet_length(L(1), "integer"), 4),
        "lztrim": (fn.lztrim(L("00120")), "120"),
        "lztrim_zero": (fn.lztrim(L("000")), "0"),
        "substring": (fn.substring(L("abcdef"), L(-1), L(2)), "ab"),
        "substring_negative": (fn.substring(L("abcdef"), L(2), L(-2)), ""),
        "substring_rest": (fn.substring(L("abcdef"), L(4)), "def"),
        "right": (fn.right(L("abc"), L(-1)), ""),
        "ralign": (fn.ralign(L("ab"), L(4)), "  ab"),
        "ralign_long": (fn.ralign(L("abcde"), L(4)), "abcde"),
        "replicate": (fn.replicate(L("a"), L(300)), "a" * 255),
        "replicate_negative": (fn.replicate(L("a"), L(-1)), None),
        "replace_null": (fn.replace(L("abc"), L("b"), NULL), "ac"),
        "replace_empty": (fn.replace(L("abc"), L(""), L("x")), "abc"),
        "escape": (fn.escape(L("a'b\\"), "'"), "a\\'b\\\\"),
        "quote": (fn.quote(L('a"b')), '"a\\"b"'),
        "wordify": (fn.wordify(L(1021)), "One Thousand Twenty-One"),
        "wordify_zero": (fn.wordify(L(0)), "Zero"),
        "wordify_negative": (fn.wordify(L(-120)), "Negative One Hundred Twenty"),
        "wordify_money": (fn.wordify(money("21.01"), "money"), "Twenty-One and 01/100"),
        "lev": (fn.levenshtein(L("kitten"), L("sitting")), 3),
        "lev_compare_empty": (fn.lev_compare(L(""), L("a")), 0.5),
        "lev_compare_inserts": (fn.lev_compare(L("hello"), L("hello!")), 1 - 1 / 12),
        "cos_same": (fn.cos_compare(L("hello"), L("hello")), 1.0),
        "cos_null": (fn.cos_compare(L("hello"), NULL), None),
        "hex": (fn.to_hex(L("az")), "617a"),
        "unhex": (fn.from_hex(L("617a")), "az"),
        "b64": (fn.from_base64(fn.to_base64(L("hé"))), "hé"),
        "round": (fn.round_(L(2.5)), 3.0),
        "round_negative": (fn.round_(L(-2.5)), -3.0),
        "truncate": (fn.truncate(L(123.123), 3), 123.123),
        "truncate_tens": (fn.truncate(L(-123), -2, "integer"), -100),
        "constrain": (fn.constrain(L(7), NULLI, L(5)), 5),
        "constrain_null": (fn.constrain(NULLI, L(1), L(5)), None),
        "power": (fn.power(L(2), L(3)), 8.0),
        "condition_null": (fn.condition(F.lit(None).cast("boolean"), L(1), L(2)), None),
        "condition": (fn.condition(L(False), L(1), L(2)), 2),
        "nullif_null": (fn.nullif(L(1), NULLI), None),
        "nullif": (fn.nullif(L(1), L(2)), 1),
        "hash": (fn.hash_("sha512", L("a")), hashlib.sha512(b"a").hexdigest()),
        "hmac": (fn.hmac("sha1", L("a"), L("k")), hmac.new(b"k", b"a", "sha1").hexdigest()),
        "pbkdf2": (fn.pbkdf2("sha256", L("a"), L("s"), 5, 8), hashlib.pbkdf2_hmac("sha256", b"a", b"s", 5, 8).hex()),
        "datediff_month": (fn.datediff("month", L("2024-01-31").cast("timestamp_ntz"), L("2024-02-01").cast("timestamp_ntz")), 1),
        "datediff_hour_back": (fn.datediff("hour", L("2024-01-01 02:01:00").cast("timestamp_ntz"), L("2024-01-01 00:59:00").cast("timestamp_ntz")), -2),
        "dateadd_clamp": (F.date_format(fn.dateadd("month", L(1), L("2024-01-31").cast("timestamp_ntz")), "yyyy-MM-dd"), "2024-02-29"),
        "weekday": (fn.datepart("weekday", L("2024-06-02").cast("timestamp_ntz")), 1),
        "dateformat": (fn.dateformat(L("2024-06-02 15:04:05").cast("timestamp_ntz"), "ddd MMM yyyy, HH:mm:ss"), "2nd Jun 2024, 15:04:05"),
        "dateformat_pm": (fn.dateformat(L("2024-06-02 15:04:05").cast("timestamp_ntz"), "hh:mm"), "03:04PM"),
        "moneyformat": (fn.moneyformat(money("-1234.5"), "$#,##0.00"), "-$1,234.50"),
        "moneyformat_brackets": (fn.moneyformat(money("-0.5"), "($0.00)"), "$(0.50)"),
        "convert_hex": (types.convert("integer", L(" 0x1F")), 31),
        "convert_octal": (types.convert("integer", L("-017")), -15),
        "convert_junk": (types.convert("integer", L("abc")), 0),
        "convert_lead": (types.convert("integer", L("12abc")), 12),
        "convert_money_cut": (types.convert("integer", money("-1.9"), "money"), -1),
        "convert_double": (types.convert("double", L("-1.5e2x")), -150.0),
        "convert_money": (types.convert("money", L("$12.34")), Decimal("12.3400")),
        "convert_null": (types.convert("integer", NULL), None),
    }


def test_values(spark):
    expected = cases()
    row = spark.range(1).select(*[column.alias(name) for name, (column, _) in expected.items()]).first()
    assert {n: row[n] for n in expected} == {n: v for n, (_, v) in expected.items()}


def test_errors(spark):
    with pytest.raises(Exception, match="(?i)division by zero"):
        value(spark, fn.divide(L(1), L(0)))
    with pytest.raises(TypeError):
        fn.multiply(money("1"), money("2"), ("money", "money"))
    with pytest.raises(Exception, match="not allowed"):
        value(spark, fn.escape(L("a|b"), "'", "|"))


def test_cosine_ranges(spark):
    a, b, c = "Cynthia Adams; cynthiaadams@gmail.com; 720-769-1293", "Timothy Adams; thetbear@gmail.com; 720-891-1470", "Lance Freson; lancetheturtle@gmail.com; 720-111-8189"
    assert 0.49 <= value(spark, fn.cos_compare(L(a), L(b))) <= 0.54
    assert 0.425 <= value(spark, fn.cos_compare(L(b), L(c))) <= 0.475
    assert value(spark, fn.cos_compare(L("Samuel"), L("Alex"))) <= 0.025


def test_substitute(spark):
    df = spark.createDataFrame([("Black", "", 0, 5), (None, "x", 3, None)], "color string, note string, n int, m int")
    cells = {c: F.col(c) for c in df.columns}
    template = "[:color]|[+:note]has [:note][/]|[-:n]none[/-:n]|[?:m=5]five[/?]|[+:n,:m]some[/+]"
    out = fn.substitute(template, cells, dict(df.dtypes))
    assert [r[0] for r in df.select(out).collect()] == ["Black||none|five|some", "|has x|||some"]
    with pytest.raises(ValueError):
        fn.substitute("[:nothing]", cells)


def test_datetimes_from_text(spark):
    texts = ["3/1/17 12:00", "3/1/2017 12:00am", "3-1-2017 3pm", "2017-03-01 20:00", "03-01-99 20:00", "03-01-99 04:00 +0600", "03-01-99 04:00-0600", "1 Mar 2017 13:01:59", "March 1, 2017 1:01 PM", "2017-03-01T20:00:01.5", "junk", "13/41/2017", None, ""]
    want = ["2017-03-01 12:00:00", "2017-03-01 00:00:00", "2017-03-01 15:00:00", "2017-03-01 20:00:00", "1999-03-01 20:00:00", "1999-02-28 22:00:00", "1999-03-01 10:00:00", "2017-03-01 13:01:59", "2017-03-01 13:01:00", "2017-03-01 20:00:01", None, None, None, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] and str(r[0]) for r in df.select(types.convert("datetime", F.col("t"))).collect()] == want


def test_datetimes_look_for_each_pattern_once(spark, capsys):
    """Three forms of dates, the rest, clock, hour, half day and offset: one search each, and odd texts as before."""
    texts = ["2 jan 3/4/2017 5pm", "Sept 3 99 1:2:3 am", "x 5 - Marxyz - 2001 12am", "2017-3-4 7:08\n", "1/2/345", "12/2/34567", "5 may 1 3/4", "31 feb 2017", "1 jan 2017 24:00", "1 jan 2017 12:00 +9999"]
    want = ["2017-03-04 17:00:00", "1999-09-03 01:02:03", "2001-03-05 00:00:00", "2017-03-04 07:08:00", "0345-01-02 00:00:00", "3456-12-02 00:00:00", "2001-05-05 00:00:00", None, None, "2016-12-28 07:21:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(types.convert("datetime", F.col("t")).alias("d"))
    shown = [r[0] for r in df.select(F.date_format("d", "yyyy-MM-dd HH:mm:ss")).collect()]
    assert [a for a, w in zip(shown, want) if a != w] == []
    capsys.readouterr()
    df.explain()
    assert capsys.readouterr().out.count("regexp_") <= 8


def test_money_patterns(spark):
    """The whole pattern language, over zero, positive and negative amounts."""
    amounts = [0, 12.5, -12.5, 1234567.891, 0.25]
    want = {
        "$#,###,##0.00": ["$0.00", "$12.50", "-$12.50", "$1,234,567.891", "$0.25"], "Z0.00": ["-0-", "12.50", "-12.50", "1234567.891", "0.25"], "B0": ["", "12.5", "-12.5", "1234567.891", "0.25"],
        "****0.00": ["    0.00", "   12.50", "-   12.50", "1234567.891", "    0.25"], "[##0.00]": ["(0.00)", "(12.50)", " 12.50 ", "(1234567.891)", "(0.25)"], "##0.00-": ["0.00 ", "12.50 ", "12.50-", "1234567.891 ", "0.25 "],
        "^^^0": ["0000", "0012.5", "-0012.5", "1234567.891", "0000.25"], "#": ["", "12.5", "-12.5", "1234567.891", ".25"],
    }
    df = spark.createDataFrame([(float(a),) for a in amounts], "a double")
    for pattern, shown in want.items():
        assert [r[0] for r in df.select(fn.moneyformat(types.money(F.col("a")), pattern)).collect()] == shown, pattern


def test_keyed_digests(spark):
    """Against Python's own, with short, long and empty keys."""
    rows = [("Jefe", "what do ya want for nothing?"), ("k" * 200, "x"), ("", ""), ("é", "中")]
    df = spark.createDataFrame(rows, "k string, t string")
    for algorithm in ("md5", "sha1", "sha256", "sha384", "sha512"):
        assert [r[0] for r in df.select(fn.hmac(algorithm, F.col("t"), F.col("k"))).collect()] == [hmac.new(k.encode(), t.encode(), algorithm).hexdigest() for k, t in rows]


def test_keyed_digests_by_words(spark, capsys):
    """Keys of every length around the blocks, of bytes that meet the pads as zeros, and null ones; no step for each byte of a key."""
    letters = "6\\\x00\x01\x7f中é\U0001f600aZ"
    rows = [("".join(letters[(n * 7 + i * i) % len(letters)] for i in range(n)), f"text {n}") for n in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300)] + [("6" * 64, ""), ("\\" * 64, "x"), ("k" * 64, "y"), ("k" * 65, "y"), ("k" * 128, "y"), ("k" * 129, "y"), (None, "z"), ("k", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    for algorithm in ("md5", "sha1", "sha256", "sha384", "sha512"):
        want = [None if k is None or t is None else hmac.new(k.encode(), t.encode(), algorithm).hexdigest() for k, t in rows]
        assert [r[0] for r in df.select(fn.hmac(algorithm, F.col("t"), F.col("k"))).collect()] == want
    capsys.readouterr()
    df.select(fn.hmac("sha256", F.col("t"), F.col("k"))).explain()
    assert "transform(" not in capsys.readouterr().out
