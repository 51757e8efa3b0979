"""Readers, writers, the catalog and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.plans.catalog import Catalog, StoredQuery, rows, show_plan
from millrace.sources import files, structure, text, trees
from millrace.streaming import events

FIELDS = [text.Field("i", "integer"), text.Field("s"), text.Field("m", "money"), text.Field("d", "datetime"), text.Field("last")]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,s,m,d,last\n1,  "x, y",$2.50,2024-01-31 10:00:00,end  \n,"",,,\n')
    a, b = text.read_delimited(spark, str(tmp_path / "a.csv"), FIELDS).collect()
    assert (a["i"], a["s"], float(a["m"]), a["d"], a["last"]) == (1, "x, y", 2.5, datetime.datetime(2024, 1, 31, 10), "end")
    assert (b["i"], b["s"], b["m"], b["d"], b["last"]) == (None, "", None, None, "")
    (tmp_path / "b.csv").write_text("i,s,m,d,last\n7,q,1,2024-02-01,z\n")
    many = text.read_many(spark, str(tmp_path / "*.csv"), FIELDS)
    assert many.count() == 3 and many.select("path").distinct().count() == 2
    out = str(tmp_path / "out")
    text.write_delimited(text.read_delimited(spark, str(tmp_path / "b.csv"), FIELDS), out)
    assert text.read_delimited(spark, out, FIELDS).collect() == text.read_delimited(spark, str(tmp_path / "b.csv"), FIELDS).collect()


def test_fixed_width_and_row_ids(spark, tmp_path):
    (tmp_path / "f.txt").write_text("  1abc\n 22de \n")
    out = text.read_fixed_width(spark, str(tmp_path / "f.txt"), [text.Field("n", "integer", 1, 3), text.Field("s", "string", 4, 3)])
    assert [tuple(r) for r in out.collect()] == [(1, "abc"), (22, "de")]
    ids = text.with_row_ids(spark.range(0, 100, 1, 7))
    assert sorted((r["name"], r["id"]) for r in ids.collect()) == [(i + 1, i) for i in range(100)]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"rowid": 1, "on": true, "price": {"wholepart": 2, "fractionpart": 5000}, "at": {"year": 2024, "month": 2, "day": 3}, "kids": [{"n": 1}, {"n": 2}]}, {"rowid": 2, "on": false, "kids": []}]')
    df = trees.read_json(spark, str(tmp_path / "a.json"))
    a = df.select("on", trees.money_of(F.col("price")).alias("m"), F.make_date("at.year", "at.month", "at.day").alias("d")).first()
    assert a["on"] == 1 and float(a["m"]) == 2.5 and str(a["d"]) == "2024-02-03"
    assert sorted(r["kids_n"] or 0 for r in trees.flatten(df, ["kids"]).collect()) == [0, 1, 2]
    (tmp_path / "b.json").write_text('{"x": {"rowid": 1, "color": "red"}, "description": "text", "y": {"rowid": 2, "color": "blue"}}')
    assert sorted(tuple(r) for r in trees.read_json_object(spark, str(tmp_path / "b.json"), "rowid int, color string").collect()) == [("x", 1, "red"), ("y", 2, "blue")]
    (tmp_path / "c.xml").write_text('<all><item id="1"><n>a</n></item><item id="2"><n>b</n></item></all>')
    assert sorted((r["id"], r["n"]) for r in trees.read_xml(spark, str(tmp_path / "c.xml"), "item").collect()) == [(1, "a"), (2, "b")]


def test_datetime_of(spark):
    df = spark.range(1).select(F.struct(F.lit(2024).alias("year"), F.lit(2).alias("month"), F.lit(3).alias("day"), F.lit(4).alias("hour"), F.lit(None).cast("int").alias("minute"), F.lit(None).cast("int").alias("second")).alias("s"))
    assert df.select(trees.datetime_of(F.col("s"))).first()[0] == datetime.datetime(2024, 2, 3, 4)


def test_files_and_mail(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.eml").write_bytes(b"From: a@example.com\nTo: b@example.com\nSubject: Hi\nContent-Type: text/plain\n\nbody one\n")
    (tmp_path / "box").write_text("From x\nFrom: a@example.com\nSubject: One\n\nfirst\nFrom y\nFrom: c@example.com\nSubject: Two\n\nsecond\n")
    assert [r["name"] for r in files.list_files(spark, str(tmp_path / "m")).collect()] == ["a.eml"]
    one = files.read_mail(spark, str(tmp_path / "m")).first()
    assert (one["sender"], one["subject"], one["body"].strip()) == ("a@example.com", "Hi", "body one")
    both = files.read_mail(spark, str(tmp_path / "box"), mbox=True).orderBy("message").collect()
    assert [(r["subject"], r["body"].strip()) for r in both] == [("One", "first"), ("Two", "second")]


def test_structure(spark, tmp_path):
    (tmp_path / "q.struct").write_text('$Version=2$\nq "system/query" { sql = "select \\"x\\""; n = 1, 2; // note\n p "query/parameter" { type = string; } empty "x/y" { } }')
    rows = sorted((r["node"], r["type"], r["attribute"] or "", r["value"] or "") for r in structure.read_structure(spark, str(tmp_path / "q.struct")).collect())
    assert set(rows) == {("/q/empty", "x/y", "", ""), ("/q/p", "query/parameter", "type", "string"), ("/q", "system/query", "n", "1"), ("/q", "system/query", "n", "2"), ("/q", "system/query", "sql", 'select "x"')}


def test_catalog(spark):
    c = Catalog(spark)
    c.source("/t/a", lambda: spark.createDataFrame([(1, "red"), (2, "blue")], "id int, color string"))
    c.source("/t/b", lambda: spark.createDataFrame([(3,)], "id int"))
    c.link("/l", "/t/a")
    assert c.open("/l").count() == 2 and c.wildcard("/t/*").count() == 3
    c.store("/q", StoredQuery("SELECT * FROM src_t_a WHERE color = :color AND id >= :least", {"color": "string", "least": "int"}, {"least": 0}))
    assert [r["id"] for r in c.execute("/q", color="blue").collect()] == [2]
    assert c.execute("/q", F.col("id") > 5, color="blue").count() == 0
    with pytest.raises(TypeError):
        c.execute("/q", shape="round")
    with pytest.raises(KeyError):
        c.open("/none")
    c.declare("n", "k int, v string")
    c.insert("n", spark.createDataFrame([(1, "a")], "k int, v string"))
    c.upsert("n", spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"], {"v": F.col("s.v")}, F.col("v"))
    c.update("n", F.col("k") == 2, {"v": F.lit("z")})
    c.delete("n", F.col("k") == 1)
    assert [tuple(r) for r in rows(c.collection("n"))] == [(2, "z")]
    c.declare_object("o")
    c.assign("o", c.open("/t/a"), F.col("id"))
    assert c.variables["o"] == {"id": 2, "color": "blue"} and c.open("/t/a").where(F.col("color") == c.variable("o", "color")).count() == 1
    assert c.open("/t/b").select(c.value("/t/b", "id").alias("x")).first()["x"] == 3
    assert "Physical Plan" in show_plan(c.open("/t/a"))


def test_streams(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.follow(spark, str(tmp_path / "in"), data.schema, 1)
    seen = []
    q = events.notify(stream, F.col("event_type") == "purchase", lambda df, n: seen.append(df.count()), str(tmp_path / "ck1"))
    q.awaitTermination(120)
    assert sum(seen) == data.where("event_type = 'purchase'").count()
    out = events.windowed(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], late="4000 days")
    q = out.writeStream.outputMode("update").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    final = spark.table("w").groupBy("window_start", "event_type").agg(F.max("n").alias("n"))
    assert final.agg(F.sum("n")).first()[0] == data.count()
    sess = events.sessions(data, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    assert sess.agg(F.sum("n")).first()[0] == data.count()
    assert events.latest_by_key(data, ["user_id"], "event_id").count() == data.select("user_id").distinct().count()


def test_database(spark):
    """Write to and read from a database over JDBC; a scan in ranges gives the same rows."""
    url, driver = "jdbc:derby:memory:shop;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "k int, name string")
    files.write_table(rows, url, "things", parts=2, **driver)
    files.write_table(rows.select((F.col("k") + 50).alias("k"), "name"), url, "things", **driver)
    found = files.read_table(spark, url, "things", split_by="k", bounds=(0, 100), parts=4, **driver)
    assert found.count() == 100 and found.rdd.getNumPartitions() == 4 and found.where("k = 70").first()[1] == "name 20"


def test_row_ids_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n" + "\n".join(map(str, range(3))) + "\n")
    (tmp_path / "b.csv").write_text("k\n" + "\n".join(map(str, range(3, 2000))) + "\n")
    (tmp_path / "c.csv").write_text("k\n2000\n")
    out = text.read_delimited(spark, str(tmp_path / "*.csv"), [text.Field("k", "integer")], row_id="name")
    assert sorted((r["name"], r["k"]) for r in out.collect()) == [(i + 1, i) for i in range(2001)]


def test_readers_by_type(spark, tmp_path):
    (tmp_path / "odd.name").write_text('{"k": 1}')
    c = Catalog(spark)
    c.source_of_type("/x", "application/json", str(tmp_path / "odd.name"))
    assert c.open("/x").first()["k"] == 1
    with pytest.raises(KeyError):
        c.source_of_type("/y", "video/mpeg", "x")
