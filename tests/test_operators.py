"""Relational operators on small tables."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml, grouping, hierarchy, joins, ordering, pivot, reports, rules, setops, windows

C = F.col


@pytest.fixture(scope="module")
def colors(spark):
    return spark.createDataFrame([(0, "Black", 2), (1, "Red", 3), (2, "Green", 5), (3, "Yellow", 7), (4, "Blue", 11), (5, "Magenta", 13), (6, "Cyan", 17), (7, "White", 19)], "f_id int, f_desc string, f_count int")


@pytest.fixture(scope="module")
def animals(spark):
    names = ["Aardvark", "Beagle", "Cow", "Dog", "Elephant", "Fox", "Goat", "Hawk"]
    return spark.createDataFrame([(i, n, i * i) for i, n in enumerate(names)], "f_id int, f_desc string, f_square int")


@pytest.fixture(scope="module")
def shades(spark):
    return spark.createDataFrame(list(enumerate(["green", "yellow", "blue", "red", "orange", "purple", "violet"], 1)), "rowid int, color string")


def test_optional_group_is_missing_as_a_whole(animals, colors, shades):
    out = joins.join_graph(
        {"t1": animals, "t2": colors, "js": shades},
        [joins.Edge(("t1", "t2"), C("t1.f_id") == C("t2.f_id"), "t2"), joins.Edge(("t2", "js"), F.lower("t2.f_desc") == C("js.color"))],
    )
    rows = {r[0]: (r[1], r[2]) for r in out.select("t1.f_id", "t2.f_desc", "js.rowid").collect()}
    assert rows == {0: (None, None), 1: ("Red", 4), 2: ("Green", 1), 3: ("Yellow", 2), 4: ("Blue", 3), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_filter_on_the_optional_side_runs_first(animals, colors):
    out = joins.join_graph({"a": animals, "c": colors}, [joins.Edge(("a", "c"), C("a.f_id") == C("c.f_id"), "c")], {"c": C("f_id").isNull()})
    assert out.count() == 8 and out.where(C("c.f_id").isNotNull()).count() == 0


def test_conflicting_roles_are_an_error(animals, colors, shades):
    edges = [joins.Edge(("a", "c"), C("a.f_id") == C("c.f_id"), "c"), joins.Edge(("a", "s"), C("a.f_id") == C("s.rowid")), joins.Edge(("c", "s"), C("c.f_id") == C("s.rowid"))]
    with pytest.raises(ValueError):
        joins.join_graph({"a": animals, "c": colors, "s": shades}, edges)


def test_cross_and_null_keys(spark, colors):
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert joins.join_graph({"a": nulls, "b": colors}).count() == 16
    assert joins.join_graph({"a": nulls, "b": colors}, [joins.Edge(("a", "b"), C("a.k") == C("b.f_id"))]).count() == 1


def test_band_and_paged_and_as_of(spark):
    values = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 99.0)], "id int, v double")
    bands = spark.createDataFrame([("low", 0.0, 10.0), ("wide", 4.0, 40.0)], "n string, lo double, hi double")
    assert sorted((r["id"], r["n"]) for r in joins.band_join(values, bands, "v", "lo", "hi", 10.0).collect()) == [(1, "low"), (1, "wide"), (2, "wide")]
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 1, "w")], "src string, page int, row string")
    out = joins.lateral_pages(spark.createDataFrame([("a",), ("b",)], "k string"), pages, C("k") == C("src"))
    assert sorted(r["row"] for r in out.collect()) == ["x", "y"]
    left = spark.createDataFrame([("k", 1), ("k", 5), ("q", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "v2"), ("k", 5, "v5")], "k string, at int, v string")
    assert sorted((r["k"], r["t"], r["v"]) for r in joins.as_of_join(left, right, ["k"], "t", "at", ["v"]).collect()) == [("k", 1, None), ("k", 5, "v5"), ("q", 5, None)]


def test_windows(colors):
    size = F.length("f_desc")
    order = [size, C("f_id")]
    out = windows.row_number(colors, order, [size], "r2")
    out = windows.row_number(out, order, name="r1")
    out = windows.dense_rank(windows.dense_rank(out, order, name="d1"), order, [size], "d2")
    rows = [(r["f_id"], r["r1"], r["r2"], r["d1"], r["d2"]) for r in out.orderBy("r1").collect()]
    assert rows == [(1, 1, 1, 1, 1), (4, 2, 1, 1, 2), (6, 3, 2, 1, 2), (0, 4, 1, 1, 3), (2, 5, 2, 1, 3), (7, 6, 3, 1, 3), (3, 7, 1, 1, 4), (5, 8, 1, 1, 5)]


def test_runs_restart_when_a_key_comes_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, None)], "i int, k string")
    assert [r["n"] for r in windows.row_number(df, [C("i")], [C("k")], "n").orderBy("i").collect()] == [1, 2, 1, 1, 1, 2]


def test_grouping_rules(spark, colors):
    empty = colors.where("f_id < 0")
    assert empty.groupBy("f_id").count().count() == 0
    row = grouping.group(empty, ["f_desc"], [F.count(F.lit(1)).alias("n"), F.sum("f_count").alias("s")], one_row=True).collect()
    assert [tuple(r) for r in row] == [(None, 0, None)]
    assert grouping.group(colors, ["f_desc"], [F.count(F.lit(1)).alias("n")], one_row=True).count() == 8
    df = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, "a", 7)], "i int, g string, v int")
    out = grouping.group(df, ["g"], [grouping.first(C("v"), C("i")).alias("f"), grouping.last(C("v"), C("i")).alias("l"), grouping.nth(C("v"), 2, C("i")).alias("n2"), grouping.nth(C("v"), 3, C("i")).alias("n3"), grouping.avg(C("v"), "integer").alias("a")], ["i", "v"], C("i")).first()
    assert (out["f"], out["l"], out["n2"], out["n3"], out["a"], out["i"], out["v"]) == (10, 7, 7, None, 8, 3, 7)
    assert grouping.two_level(colors, [F.length("f_desc")], [F.sum("f_count").alias("x")], [F.sum("x").alias("y")]).first()["y"] == 77


def test_order_and_limit(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "i int, v int")
    assert [r["i"] for r in ordering.order_by(df, "v desc").collect()] == [1, 3, 2]
    assert [r["i"] for r in ordering.order_by(df, "v").collect()] == [1, 2, 3]
    assert [r["i"] for r in ordering.limit(ordering.order_by(df, "v"), 1, 1).collect()] == [2]
    assert ordering.select_rows(df, where=C("v").isNotNull(), rowcount=2, having=C("v") > 5).count() <= 1


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    assert dml.delete(t, C("k") > 1).count() == 2
    assert {r["k"]: r["v"] for r in dml.update(t, C("k") == 1, {"v": F.upper("v")}).collect()} == {1: "A", 2: "b", None: "n"}
    source = spark.createDataFrame([(1, 2, "x"), (2, 3, "new"), (3, 3, "again"), (4, None, "null")], "o int, k int, v string")
    out = dml.upsert(t, source.select("k", "v", "o").drop("o"), ["k"], {"v": F.concat("t.v", C("s.v"))}, C("v"))
    assert sorted((r["k"] if r["k"] is not None else -1, r["v"]) for r in out.collect()) == [(-1, "n"), (-1, "null"), (1, "a"), (2, "bx"), (3, "againnew")]
    with pytest.raises(ValueError):
        dml.insert(t, spark.createDataFrame([(1,)], "other int"))


def test_pivot(spark):
    eav = spark.createDataFrame([(1, "age", 5, None), (1, "name", None, "Ann"), (2, "name", None, "Bob")], "id int, attr_name string, i int, s string")
    assert sorted(tuple(r) for r in pivot.eav_pivot(eav, ["id"], "attr_name", ["i", "s"], {"age": "int", "name": "string"}).collect()) == [(1, 5, "Ann"), (2, None, "Bob")]
    long = eav.select("id", "attr_name", F.coalesce(C("i").cast("string"), "s").alias("attr_value"))
    changed = pivot.eav_write(long, spark.createDataFrame([(1, "age", None), (2, "name", "Rob")], "id int, attr_name string, attr_value string"), ["id"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "name", "Ann"), (2, "name", "Rob")]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    walk = lambda **x: sorted((r["id"], r["__depth"], r["__path"]) for r in hierarchy.subtree(nodes, C("id") == "a", name_col="id", **x).collect())
    assert walk() == [("b", 1, "/a/b"), ("c", 2, "/a/b/c"), ("d", 1, "/a/d")]
    assert walk(inclusive=True)[0] == ("a", 0, "/a")
    assert walk(where=C("id").isin("b", "c"), pruned=True) == [("b", 1, "/a/b")]
    levels = hierarchy.tree_view([(nodes.where("parent is null"), "id", None), (nodes.where("parent = 'a'"), "id", "parent")])
    assert sorted(r["path"] for r in levels.collect()) == ["/a", "/a/b", "/a/d"]


def test_reports_and_rules(spark, colors):
    out = reports.running(colors, [C("f_id")], {"s": ("sum", C("f_count"), C("f_count") > 3)}).orderBy("f_id")
    assert [r["s"] for r in out.collect()] == [None, None, 5, 12, 23, 36, 53, 72]
    two = reports.parallel(colors.where("f_id < 2"), colors.select(C("f_id").alias("o")).where("o < 3"), [C("f_id")], [C("o")])
    assert sorted((r["row_no"], r["f_id"], r["o"]) for r in two.collect() if r["f_id"] is not None) == [(1, 0, 0), (2, 1, 1)] and two.count() == 3
    bad = rules.check_hints(colors, {"f_desc": {"length": 6, "required": True}, "f_count": {"max": 17}})
    assert {r["f_id"]: r["violations"] for r in bad.where("size(violations) > 0").collect()} == {5: ["f_desc:length"], 7: ["f_count:max"]}
    assert rules.request_filter(colors, {"f_desc": "*e*"}).count() == 6
    masked = rules.obfuscate(colors, "k", {"f_desc": "KV", "f_count": "KV"})
    a, b = masked.orderBy("f_id").collect(), rules.obfuscate(colors, "k", {"f_desc": "KV", "f_count": "KV"}).orderBy("f_id").collect()
    assert a == b and all(len(x["f_desc"]) == len(y["f_desc"]) for x, y in zip(a, colors.orderBy("f_id").collect())) and dict(masked.dtypes) == dict(colors.dtypes)


def test_runs_and_numbers_over_whole_tables(spark, monkeypatch):
    """Without ``by`` rows are numbered by sorted ranges and runs found over stretches of them; null keys equal each other."""
    import random

    monkeypatch.setattr(windows, "STRETCH", 64)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, k int").repartition(4)
    want, n = [], 0
    for i, (o, k) in enumerate(rows):
        n += i == 0 or k != rows[i - 1][1]
        want.append((o, n))
    assert sorted((r["o"], r["run"]) for r in windows.runs(df, [F.col("k")], [F.col("o")]).collect()) == want
    assert sorted((r["o"], r["row_number"]) for r in windows.number(df, [F.col("o")]).collect()) == [(i, i + 1) for i in range(500)]
    assert windows.number(df.limit(0), [F.col("o")]).count() == windows.runs(df.limit(0), [F.col("k")], [F.col("o")]).count() == 0


def test_in_query_with_nulls(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert [r["hit"] for r in a.select(setops.in_query(F.col("x"), b, "y").alias("hit")).collect()] == [True, False, None]


def test_nth_by_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, 9), ("b", 1, 1)], "k string, o int, v int")
    assert [tuple(r) for r in grouping.nth_by_key(df, ["k"], F.col("v"), 2, F.col("o"), "second").collect()] == [("a", 7)]
