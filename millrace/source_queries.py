"""Registered queries of the sources, the catalog and the session's objects. Each writes a given table in the format of a source to the shared
folder and reads it back, so its SQL is the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import types
from millrace.operators import dml, joins
from millrace.plans.catalog import Catalog, StoredQuery
from millrace.queries import C, query
from millrace.sources import files, structure, text, trees
from millrace.storage import new_path
from millrace.streaming import events as streams

ORDERS = [text.Field("o_orderkey", "integer"), text.Field("o_orderstatus"), text.Field("o_totalprice", "money"), text.Field("o_orderdate", "datetime"), text.Field("o_orderpriority")]
ORDERS_SQL = "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(14,4)) AS o_totalprice, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS o_orderdate, o_orderpriority"


def _orders(t):
    return t.orders.select("o_orderkey", "o_orderstatus", types.money(C("o_totalprice")).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


def _saved(t, df, **options) -> str:
    path = new_path(t.spark, "csv")
    text.write_delimited(df, path, **options)
    return path


@query(ORDERS_SQL + " FROM orders")
def source_delimited(t):
    return text.read_delimited(t.spark, _saved(t, _orders(t)), ORDERS)


@query(ORDERS_SQL + " FROM orders")
def source_compressed(t):
    return text.read_delimited(t.spark, _saved(t, _orders(t), separator="|", header=False, compression="gzip"), ORDERS, header=False, separator="|")


@query("""SELECT n_nationkey, trim(n_name) AS n_name, n_regionkey FROM nation""")
def source_fixed_width(t):
    path = new_path(t.spark, "fixed")
    t.nation.select(F.concat(F.lpad(C("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 30, " "), F.lpad(C("n_regionkey").cast("string"), 3, " ")).alias("value")).write.text(path)
    return text.read_fixed_width(t.spark, path, [text.Field("n_nationkey", "integer", 1, 4), text.Field("n_name", "string", 5, 30), text.Field("n_regionkey", "integer", 35, 3)])


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) AS id, CAST(o_orderkey AS INTEGER) AS o_orderkey FROM orders""")
def source_row_ids(t):
    """Numbers in file order, over several files of unequal size."""
    path = _saved(t, t.orders.select("o_orderkey").repartitionByRange(7, (C("o_orderkey") * C("o_orderkey"))).sortWithinPartitions("o_orderkey"))
    return text.read_delimited(t.spark, path, [text.Field("o_orderkey", "integer")], row_id="id")


@query("""SELECT CAST(c_custkey AS INTEGER) AS k, c_name AS name, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def source_wildcard(t):
    """All files that a pattern matches, with their paths."""
    path = new_path(t.spark, "many")
    text.write_delimited(t.customer.select("c_custkey", "c_name"), f"{path}/customer")
    text.write_delimited(t.supplier.select("s_suppkey", "s_name"), f"{path}/supplier")
    rows = text.read_many(t.spark, f"{path}/*", [text.Field("k", "integer"), text.Field("name")])
    return rows.select("k", "name", F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("origin"))


@query("""SELECT p_partkey, p_name, p_size, p_retailprice, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part""")
def source_json(t):
    path = new_path(t.spark, "json")
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice", (C("p_size") > 25).alias("large")).write.json(path)
    return trees.read_json(t.spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double, large boolean", lines=True)


@query("""SELECT r_name, n_name, CAST(n_nationkey + 0.25 AS DECIMAL(14,4)) AS fee, CAST(TIMESTAMP '2024-02-03 04:00:00' + INTERVAL 1 DAY * n_nationkey AS TIMESTAMP) AS since FROM region JOIN nation ON r_regionkey = n_regionkey""")
def source_json_tree(t):
    """One array of nested objects in a file: money and datetime objects, and rows inside rows."""
    fee = F.struct(C("n_nationkey").alias("wholepart"), F.lit(2500).alias("fractionpart"))
    day = F.date_add(F.lit("2024-02-03").cast("date"), C("n_nationkey"))
    since = F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"), F.lit(4).alias("hour"), F.lit(0).alias("minute"), F.lit(0).alias("second"))
    nations = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", fee.alias("fee"), since.alias("since"))).alias("nation"))
    regions = t.region.join(nations, C("n_regionkey") == C("r_regionkey")).select(F.struct("r_name", "nation").alias("r"))
    path = new_path(t.spark, "json")
    regions.agg(F.to_json(F.collect_list("r")).alias("value")).write.text(path)
    rows = trees.flatten(trees.read_json(t.spark, path), ["nation"])
    return rows.select("r_name", C("nation_n_name").alias("n_name"), trees.money_of(C("nation_fee")).alias("fee"), trees.datetime_of(C("nation_since")).alias("since"))


@query("""SELECT n_name AS name, n_nationkey AS rowid, n_regionkey AS region FROM nation""")
def source_json_object(t):
    """One object whose members are the rows."""
    path = new_path(t.spark, "json")
    members = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(C("n_nationkey").alias("rowid"), C("n_regionkey").alias("region")))))
    t.nation.agg(F.to_json(members).alias("value")).write.text(path)
    return trees.read_json_object(t.spark, path, "rowid int, region int")


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def source_xml(t):
    path = new_path(t.spark, "xml")
    t.supplier.select(C("s_suppkey").alias("_s_suppkey"), "s_name", "s_acctbal").write.format("xml").option("rowTag", "supplier").option("rootTag", "suppliers").save(path)
    return trees.read_xml(t.spark, path, "supplier", "s_suppkey long, s_name string, s_acctbal double")


@query("""SELECT '/' || replace(r_name, ' ', '_') AS node, 'app/region' AS type, 'key' AS attribute, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT '/' || replace(r_name, ' ', '_') || '/n' || n_nationkey, 'app/nation', 'name', n_name FROM region JOIN nation ON n_regionkey = r_regionkey""")
def source_structure(t):
    path = new_path(t.spark, "structure")
    inner = F.concat(F.lit("n"), C("n_nationkey").cast("string"), F.lit(' "app/nation" { name = "'), C("n_name"), F.lit('"; }'))
    nations = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(inner), "\n").alias("inside"))
    one = F.concat(F.lit("$Version=2$\n"), F.regexp_replace("r_name", " ", "_"), F.lit(' "app/region" { key = '), C("r_regionkey").cast("string"), F.lit(";\n"), C("inside"), F.lit("\n}"))
    t.region.join(nations, C("n_regionkey") == C("r_regionkey")).repartition("r_regionkey").select(C("r_regionkey"), one.alias("value")).write.partitionBy("r_regionkey").text(path)
    return structure.read_structure(t.spark, f"{path}/*").select("node", "type", "attribute", "value")


@query("""SELECT c_name || '@example.com' AS sender, 'Order of ' || c_custkey AS subject, 'text/plain' AS mime, c_mktsegment AS body FROM customer""")
def source_mail(t):
    path = new_path(t.spark, "mail")
    name = F.regexp_replace("c_name", "#", "")
    message = F.concat(F.lit("From x\nFrom: "), name, F.lit("@example.com\nSubject: Order of "), C("c_custkey").cast("string"), F.lit("\nContent-Type: text/plain\n\n"), C("c_mktsegment"))
    t.customer.select(message.alias("value")).write.text(path)
    found = files.read_mail(t.spark, path, mbox=True)
    return found.select(F.regexp_replace("sender", "Customer", "Customer#").alias("sender"), "subject", "mime", F.trim(F.regexp_replace("body", "\n", "")).alias("body"))


@query("""SELECT 'region=' || r_regionkey AS folder, 1 AS files, TRUE AS filled FROM region""")
def source_folder(t):
    path = new_path(t.spark, "folder")
    t.region.coalesce(1).write.partitionBy("r_regionkey").parquet(path)
    found = files.list_files(t.spark, path, recursive=True).where("name like '%.parquet'")
    return found.groupBy(F.regexp_replace(F.regexp_extract("path", "(r_regionkey=[0-9]+)/[^/]*$", 1), "r_regionkey", "region").alias("folder")).agg(F.count(F.lit(1)).cast("int").alias("files"), F.bool_and(C("size") > 0).alias("filled"))


def _catalog(t) -> Catalog:
    c = Catalog(t.spark)
    c.source("/apps/east/customer", lambda: t.customer.where("c_nationkey < 12").select("c_custkey", "c_name"))
    c.source("/apps/west/customer", lambda: t.customer.where("c_nationkey >= 12").select("c_custkey", "c_name", "c_mktsegment"))
    c.link("/apps/new", "/apps/west/customer")
    c.source_of_type("/apps/orders", "text/csv", _saved(t, _orders(t)), fields=ORDERS)
    return c


@query("""SELECT c_custkey, c_name, CASE WHEN c_nationkey >= 12 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey < 12 THEN '/apps/east/customer' ELSE '/apps/west/customer' END AS origin FROM customer""")
def catalog_wildcard(t):
    return _catalog(t).wildcard("/apps/*/customer").withColumnRenamed("__path", "origin").select("c_custkey", "c_name", "c_mktsegment", "origin")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey >= 12""")
def catalog_link(t):
    return _catalog(t).open("/apps/new")


@query(ORDERS_SQL + " FROM orders WHERE o_orderstatus = 'F'")
def catalog_type(t):
    """A source whose reader is chosen by its type."""
    return _catalog(t).open("/apps/orders").where("o_orderstatus = 'F'")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey >= 12 AND c_mktsegment = 'BUILDING' AND c_custkey >= 5 AND c_custkey % 2 = 0""")
def catalog_stored_query(t):
    """A stored query with parameters, of which one has a default, and criteria over its result."""
    c = _catalog(t)
    c.store("/q/segment", StoredQuery("SELECT c_custkey, c_mktsegment FROM src_apps_west_customer WHERE c_mktsegment = :segment AND c_custkey >= :least", {"segment": "string", "least": "bigint"}, {"least": 5}))
    return c.execute("/q/segment", C("c_custkey") % 2 == 0, segment="BUILDING")


@query("""SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS named, (SELECT max(n_nationkey) FROM nation) AS newest FROM region""")
def catalog_objects(t):
    """A direct reference to one object's attribute, and a session's object that a query fills from its last row."""
    c = _catalog(t)
    c.source("/one", lambda: t.nation.where("n_nationkey = 3"))
    c.declare_object("seen")
    c.assign("seen", t.nation.select("n_nationkey"), C("n_nationkey"))
    return t.region.select("r_name", c.value("/one", "n_name").alias("named"), c.variable("seen", "n_nationkey").alias("newest"))


@query("""SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 3""")
def catalog_object(t):
    c = _catalog(t)
    c.source("/one", lambda: t.nation.where("n_nationkey = 3"))
    return c.object("/one").select("n_name", "n_regionkey")


@query("""SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey AND (n_nationkey < 12) = (c_nationkey < 12) WHERE n_nationkey % 2 = 0""")
def catalog_computed_path(t):
    """Each nation's customers from the source that a path made of the nation's number names."""
    c = Catalog(t.spark)
    c.source("/apps/east/customer", lambda: t.customer.where("c_nationkey < 12").select("c_custkey", "c_nationkey"))
    c.source("/apps/west/customer", lambda: t.customer.where("c_nationkey >= 12").select("c_custkey", "c_nationkey"))
    path = F.concat(F.lit("/apps/"), F.when(C("n_nationkey") < 12, "east").otherwise("west"), F.lit("/customer"))
    return joins.lateral_path(t.nation.where("n_nationkey % 2 = 0"), path, c.wildcard("/apps/*/customer"), C("c_nationkey") == C("n_nationkey")).select("n_nationkey", "c_custkey")


@query("""SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_suppkey % 3 = 0 THEN 'new name' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT -1, 'extra'""")
def catalog_collection(t):
    """A collection of the session: declared, filled, updated, upserted and thinned out."""
    c = Catalog(t.spark)
    c.declare("held", "k bigint, name string, bal double")
    c.insert("held", t.supplier.select(C("s_suppkey").alias("k"), C("s_name").alias("name"), C("s_acctbal").alias("bal")))
    c.upsert("held", t.supplier.where("s_suppkey % 3 = 0").select(C("s_suppkey").alias("k"), F.lit("new name").alias("name")).unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("extra").alias("name"))).withColumn("bal", F.lit(None).cast("double")), ["k"], {"name": C("s.name")}, C("name"))
    c.update("held", C("bal") < 0, {"name": F.lit("debt")})
    c.delete("held", (C("k") % 5 == 0) & (C("k") >= 0))
    return c.collection("held").select("k", "name")


@query("""SELECT e.event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events e WHERE value > 50 GROUP BY e.event_type""")
def stream_notify(t):
    """Rows that meet a condition, sent on in batches and written down once each."""
    out = new_path(t.spark, "notified")
    path = new_path(t.spark, "in")
    t.events.repartition(3).write.parquet(path)
    stream = streams.follow(t.spark, path, t.events.schema, 1)
    save = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
    streams.notify(stream, C("value") > 50, save, new_path(t.spark, "stream")).awaitTermination()
    found = t.spark.read.schema(t.events.schema).parquet(f"{out}/*")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_latest(t):
    return streams.latest_by_key(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey >= 10 UNION ALL SELECT -1, NULL""")
def write_back(t):
    """A file that statements change: each writes a new version, which the next one reads."""
    fields = [text.Field("o_orderkey", "integer"), text.Field("o_orderstatus"), text.Field("o_orderpriority")]
    again = lambda df: text.read_delimited(t.spark, _saved(t, df), fields)
    rows = again(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    rows = again(dml.update(rows, C("o_orderstatus") == "F", {"o_orderpriority": F.lit("closed")}))
    rows = again(dml.delete(rows, C("o_orderkey") < 10))
    rows = dml.insert(rows, t.spark.range(1).select(F.lit(-1).alias("o_orderkey")))
    return rows.select("o_orderkey", "o_orderpriority")
