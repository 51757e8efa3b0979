"""The registered queries of the operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import types
from millrace.operators import dml, grouping, hierarchy, joins, ordering, pivot, reports, rules, setops, windows
from millrace.storage import new_path
from millrace.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads a table of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows over all shuffle partitions, for columns that cost far more than their rows' bytes: a file of few splits would keep most cores idle."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


C = F.col


# ---- projection, filters, predicates


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag""")
def flagship(t):
    return ordering.order_by(grouping.group(t.lineitem.where(C("l_discount") > 0.05), ["l_returnflag"], [grouping.count(F.lit(1)).alias("n"), F.round(grouping.sum_(C("l_quantity")), 2).alias("q")]), "l_returnflag")


@query("""SELECT event_id, CASE WHEN coalesce(value > 50, FALSE) THEN 1 ELSE 0 END AS above, CASE WHEN NOT coalesce(value > 50, FALSE) THEN 1 ELSE 0 END AS not_above FROM events WHERE NOT coalesce(value = 0, FALSE)""")
def filter_null_rule(t):
    above = fn.compare(C("value"), ">", F.lit(50))
    return t.events.where(fn.negate(fn.compare(C("value"), "=", F.lit(0)))).select("event_id", fn.as_int(above).alias("above"), fn.as_int(fn.negate(above)).alias("not_above"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS hit FROM customer WHERE c_nationkey IN (1, 3, 5, 7)""")
def in_list(t):
    return t.customer.where(fn.in_list(C("c_nationkey"), [1, 3, 5, 7, None])).select("c_custkey", fn.as_int(fn.in_list(C("c_mktsegment"), ["BUILDING", "MACHINERY"])).alias("hit"))


@query("""SELECT event_id FROM events WHERE (value IS NULL OR value > 90) AND props IS NOT NULL""")
def is_null(t):
    return t.events.where((C("value").isNull() | (C("value") > 90)) & C("props").isNotNull()).select("event_id")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
def scalar_subquery(t):
    return t.customer.join(t.customer.agg(F.avg("c_acctbal").alias("mean")), C("c_acctbal") > C("mean")).select("c_custkey", "c_acctbal")


@query("""SELECT n_name, (SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS first_supplier FROM nation""")
def correlated_subquery(t):
    least = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("first_supplier"))
    return t.nation.join(least, C("s_nationkey") == C("n_nationkey"), "left").select("n_name", "first_supplier")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND contains(p_type, 'A')""")
def like_contains(t):
    return t.part.where(C("p_name").like("%a%") & C("p_type").contains("A")).select("p_partkey", "p_name")


@query("""SELECT 1 AS one, 'x' AS x""")
def no_from(t):
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("x"))


# ---- joins


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000""")
def join_inner(t):
    return joins.join_graph({"o": t.orders, "c": t.customer}, [joins.Edge(("o", "c"), C("o.o_custkey") == C("c.c_custkey"))], {"o": C("o_totalprice") > 100000}).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey""")
def join_left_filtered_right(t):
    return joins.join_graph({"c": t.customer, "o": t.orders}, [joins.Edge(("c", "o"), C("c.c_custkey") == C("o.o_custkey"), "o")], {"o": C("o_totalprice") > 150000}).select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN (SELECT * FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45) ON c_custkey = o_custkey""")
def join_optional_group(t):
    return joins.join_graph(
        {"c": t.customer, "o": t.orders, "l": t.lineitem},
        [joins.Edge(("c", "o"), C("c.c_custkey") == C("o.o_custkey"), "o"), joins.Edge(("o", "l"), C("o.o_orderkey") == C("l.l_orderkey"))],
        {"l": C("l_quantity") > 45},
    ).select("c_custkey", "o_orderkey", "l_linenumber")


@query("""SELECT r_name, n_name, s_name FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def join_chain_outer(t):
    return joins.join_graph(
        {"r": t.region, "n": t.nation, "s": t.supplier},
        [joins.Edge(("r", "n"), C("r.r_regionkey") == C("n.n_regionkey"), "n"), joins.Edge(("n", "s"), C("s.s_nationkey") == C("n.n_nationkey"), "s")],
    ).select("r_name", "n_name", "s_name")


@query("""SELECT n_name, s_name, c_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey""")
def join_independent_outer(t):
    return joins.join_graph(
        {"n": t.nation, "s": t.supplier, "c": t.customer},
        [joins.Edge(("n", "s"), C("s.s_nationkey") == C("n.n_nationkey"), "s"), joins.Edge(("n", "c"), C("c.c_nationkey") == C("n.n_nationkey"), "c", ("n.n_nationkey",))],
        {"s": C("s_acctbal") > 5000, "c": C("c_acctbal") > 9000},
    ).select("n_name", "s_name", "c_name")


@query("""SELECT r_name, n_name FROM region CROSS JOIN nation""")
def join_cross_small(t):
    return joins.join_graph({"r": t.region, "n": t.nation}).select("r_name", "n_name")


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def join_self_theta(t):
    on = (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))
    return joins.join_graph({"a": t.nation, "b": t.nation}, [joins.Edge(("a", "b"), on)]).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("""SELECT p_partkey, (p_size // 10) * 10 AS low FROM part WHERE p_size IS NOT NULL""")
def join_band(t):
    bands = t.spark.range(0, 20).select((C("id") * 10).cast("int").alias("low"), (C("id") * 10 + 10).cast("int").alias("high"))
    return joins.band_join(t.part, bands, "p_size", "low", "high", 10).select("p_partkey", "low")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def join_semi(t):
    return joins.nonempty(t.customer, t.orders.where(C("o_totalprice") > 200000), C("o_custkey") == C("c_custkey")).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_anti(t):
    return setops.not_exists(t.customer, t.orders, C("o_custkey") == C("c_custkey")).select("c_custkey")


@query("""SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts GROUP BY e.event_id""")
def join_as_of(t):
    bought = t.events.where(C("event_type") == "purchase").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    shifted = bought.select("user_id", (C("ts") + F.expr("interval 1 microsecond")).alias("at"), "last_purchase")
    return joins.as_of_join(t.events.select("event_id", "user_id", "ts"), shifted, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("""SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL""")
def join_lateral(t):
    return joins.lateral_explode(t.documents.select("doc_id", "text"), F.split(C("text"), "\n"), "line").select("doc_id", "line")


@query("""SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_regionkey = 1) n RIGHT JOIN supplier ON s_nationkey = n_nationkey""")
def join_right_outer(t):
    edge = joins.Edge(("n", "s"), C("s.s_nationkey") == C("n.n_nationkey"), "n")
    return joins.join_graph({"n": t.nation, "s": t.supplier}, [edge], {"n": C("n_regionkey") == 1}).select("n_name", "s_name")


@query("""SELECT a.event_id, count(b.event_id) AS n FROM (SELECT * FROM events WHERE event_id % 50 = 0) a LEFT JOIN (SELECT * FROM events WHERE event_id % 50 = 1) b ON a.value = b.value GROUP BY a.event_id""")
def join_null_keys(t):
    """Null keys meet nothing, on either side."""
    edge = joins.Edge(("a", "b"), C("a.value") == C("b.value"), "b")
    out = joins.join_graph({"a": t.events, "b": t.events}, [edge], {"a": C("event_id") % 50 == 0, "b": C("event_id") % 50 == 1})
    return out.groupBy(C("a.event_id").alias("event_id")).agg(F.count("b.event_id").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) THEN 1 ELSE 0 END AS hit FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def in_subquery(t):
    kept = t.customer.where(setops.in_query(C("c_nationkey"), t.nation.where("n_regionkey < 3"), "n_nationkey"))
    return kept.select("c_custkey", fn.as_int(setops.in_query(C("c_nationkey"), t.supplier.where("s_acctbal > 0"), "s_nationkey")).alias("hit"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber - 1 AS page, l_partkey FROM lineitem WHERE l_linenumber <> 4) SELECT l_orderkey AS o_orderkey, page, l_partkey FROM p JOIN orders ON o_orderkey = l_orderkey WHERE page = (SELECT count(DISTINCT page) FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.page < p.page)""")
def join_lateral_pages(t):
    """Pages of each order up to the first one that is missing."""
    pages = t.lineitem.where("l_linenumber <> 4").select("l_orderkey", (C("l_linenumber") - 1).alias("page"), "l_partkey")
    return joins.lateral_pages(t.orders.select("o_orderkey"), pages, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "page", "l_partkey")


@query("""SELECT r_name, n_name, s_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def report_multinested(t):
    levels = [(t.region, None), (t.nation, C("n_regionkey") == C("r_regionkey")), (t.supplier, C("s_nationkey") == C("n_nationkey"))]
    return reports.multinested(levels).select("r_name", "n_name", "s_name")


# ---- grouping


@query("""SELECT value, count(*) AS n FROM (SELECT round(value / 10) AS value FROM events) GROUP BY value""")
def group_null_key(t):
    return grouping.group(t.events.select(fn.round_(C("value") / 10).alias("value")), ["value"], [F.count(F.lit(1)).alias("n")])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(o_totalprice) FILTER (o_totalprice > 100000) IS NOT NULL AS has_large FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def group_sets(t):
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.when(C("o_totalprice") > 100000, C("o_totalprice"))).isNotNull().alias("has_large")]
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(*aggregates)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, max(l_shipdate) AS latest, min(l_extendedprice) AS least FROM lineitem GROUP BY ALL""")
def group_aggregates(t):
    return grouping.group(t.lineitem, ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"), F.max("l_shipdate").alias("latest"), F.min("l_extendedprice").alias("least")])


@query("""SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS mean FROM lineitem GROUP BY l_returnflag""")
def group_int_avg_trunc(t):
    return grouping.group(t.lineitem, ["l_returnflag"], [grouping.avg(C("l_linenumber"), "integer").alias("mean")])


@query("""SELECT o_custkey, count(*) AS n, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""")
def group_last_row(t):
    return grouping.group(t.orders, ["o_custkey"], [F.count(F.lit(1)).alias("n")], ["o_orderkey", "o_orderpriority", "o_totalprice"], C("o_orderkey"))


@query("""SELECT DISTINCT c_nationkey, c_mktsegment FROM customer""")
def group_distinct(t):
    return grouping.group(t.customer, ["c_nationkey", "c_mktsegment"])


@query("""SELECT user_id, arg_min(value, event_id) FILTER (value IS NOT NULL) AS first_value, arg_max(value, event_id) FILTER (value IS NOT NULL) AS last_value, list(value ORDER BY event_id) FILTER (value IS NOT NULL)[3] AS third FROM events GROUP BY user_id""")
def agg_first_last_nth(t):
    k = C("event_id")
    ends = grouping.group(t.events, ["user_id"], [grouping.first(C("value"), k).alias("first_value"), grouping.last(C("value"), k).alias("last_value")])
    return ends.join(grouping.nth_by_key(t.events, ["user_id"], C("value"), 3, k, "third"), "user_id", "left")


@query("""SELECT n_regionkey, string_agg(n_name || ',', '' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def agg_string_sum(t):
    return grouping.group(t.nation, ["n_regionkey"], [grouping.sum_text(F.concat("n_name", F.lit(",")), C("n_nationkey")).alias("names")])


@query("""SELECT n_regionkey, rtrim(string_agg(n_name || ',', '' ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey""")
def agg_in_expression(t):
    joined = grouping.sum_text(F.concat("n_name", F.lit(",")), C("n_nationkey"))
    return grouping.group(t.nation, ["n_regionkey"], [joined.alias("j")]).select("n_regionkey", fn.subtract_text(C("j"), F.lit(",")).alias("names"))


@query("""SELECT max(q) AS most, sum(n)::BIGINT AS all_rows, count(*) AS groups FROM (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def agg_two_level(t):
    return grouping.two_level(t.lineitem, ["l_orderkey"], [F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")], [F.max("q").alias("most"), F.sum("n").alias("all_rows"), F.count(F.lit(1)).alias("groups")])


@query("""SELECT CAST(NULL AS INTEGER) AS c_nationkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS total""")
def group_empty_one_row(t):
    return grouping.group(t.customer.where(C("c_custkey") < 0), ["c_nationkey"], [F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")], one_row=True)


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5 ORDER BY n DESC, l_suppkey LIMIT 10 OFFSET 5""")
def having_limit_offset(t):
    out = grouping.group(t.lineitem, ["l_suppkey"], [F.count(F.lit(1)).alias("n")], having=C("n") > 5)
    return ordering.limit(ordering.order_by(out, "n desc", "l_suppkey"), 5, 10)


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def group_rollup(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def group_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag""")
def crosstab(t):
    return grouping.crosstab(t.lineitem, ["l_returnflag"], "l_linestatus", F.count(F.lit(1)), ["O", "F"]).select("l_returnflag", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


# ---- windows and order


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders""")
def win_row_number_sorted(t):
    return windows.row_number_sorted(t.orders, [C("o_custkey")], [C("o_orderkey")], "rn").select("o_orderkey", "rn")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders""")
def win_row_number_all(t):
    return windows.row_number(t.orders, [C("o_totalprice"), C("o_orderkey")], name="place").select("o_orderkey", "place")


@query("""SELECT o_orderkey, sum(new) OVER (ORDER BY o_orderkey)::BIGINT AS run, 1 AS alone FROM (SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER (ORDER BY o_orderkey) AND row_number() OVER (ORDER BY o_orderkey) > 1 THEN 0 ELSE 1 END AS new FROM orders)""")
def win_dense_rank_all(t):
    ranked = windows.dense_rank(t.orders, [C("o_orderkey")], [C("o_orderstatus")], "run")
    return windows.dense_rank(ranked, [C("o_orderkey")], name="alone").select("o_orderkey", "run", "alone")


@query("""SELECT o_orderkey, rank() OVER w AS r, ntile(4) OVER w AS quarter, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS least FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def win_extensions(t):
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quarter"), F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("least"))


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 60) WHERE twice > 50000 ORDER BY o_orderkey LIMIT 10 OFFSET 5""")
def order_of_steps(t):
    rows = ordering.order_by(t.orders, "o_orderkey")
    return ordering.select_rows(rows, C("o_orderstatus") == "F", ["o_orderkey", (C("o_totalprice") * 2).alias("twice")], C("twice") > 50000, 60, 5, 10)


RUNS = """SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run, event_type, user_id
FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS rn FROM ({RUNS})""")
def win_row_number_runs(t):
    return windows.row_number(t.events, [C("event_id")], [C("event_type")], "rn", [C("user_id")]).select("event_id", "rn")


@query(f"""SELECT event_id, run AS dr FROM ({RUNS})""")
def win_dense_rank_runs(t):
    return windows.dense_rank(t.events, [C("event_id")], [C("event_type")], "dr", [C("user_id")]).select("event_id", "dr")


@query("""SELECT event_id, lag(value) OVER w AS one_before, lag(value, 2) OVER w AS two_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win_lag(t):
    k, u = [C("event_id")], [C("user_id")]
    return t.events.select("event_id", windows.lag(C("value"), k, 1, u).alias("one_before"), windows.lag(C("value"), k, 2, u).alias("two_before"))


@query("""SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS FIRST, event_id) AS place FROM events""")
def order_nulls_first(t):
    return windows.row_number_sorted(t.events, [C("user_id")], [C("value").desc_nulls_first(), C("event_id")], "place").select("event_id", "value", "place")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25""")
def order_top(t):
    return ordering.limit(ordering.order_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey"), 25)


# ---- scalar operators and functions


@query("""SELECT p_partkey, rtrim(p_name) || ' ' || CAST(p_size AS VARCHAR) AS plus, CASE WHEN ends_with(p_name, p_brand) THEN left(p_name, length(p_name) - length(p_brand)) ELSE p_name END AS minus, CASE WHEN ends_with(p_type, 'L') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS minus_l, repeat('ab', p_size % 4) AS times FROM part""")
def string_arithmetic(t):
    plus = fn.add_text(fn.add_text(C("p_name"), F.lit(" ")), C("p_size"), column=False)
    return t.part.select("p_partkey", plus.alias("plus"), fn.subtract_text(C("p_name"), C("p_brand")).alias("minus"), fn.subtract_text(C("p_type"), F.lit("L")).alias("minus_l"), fn.repeat_text(F.lit("ab"), C("p_size") % 4).alias("times"))


@query("""SELECT l_orderkey, l_linenumber, CAST(trunc((3 - l_linenumber * 2)::DOUBLE / 3) AS BIGINT) AS int_div, l_quantity / 4 AS real_div, l_linenumber * 3 AS product FROM lineitem""")
def number_arithmetic(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.divide(F.lit(3) - C("l_linenumber") * 2, F.lit(3)).alias("int_div"), fn.divide(C("l_quantity"), F.lit(4), ("double", "integer")).alias("real_div"), fn.multiply(C("l_linenumber"), F.lit(3)).alias("product"))


@query("""SELECT o_orderkey, m::DOUBLE AS m, round(m::DOUBLE * 1.5, 4) AS times, CAST(trunc(m * 10000 / 7) AS DOUBLE) / 10000 AS by_int, m::DOUBLE / 3.2::DOUBLE AS ratio FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,4)) AS m FROM orders)""")
def money_arithmetic(t):
    m = types.money(C("o_totalprice"))
    return t.orders.select("o_orderkey", m.cast("double").alias("m"), F.round(fn.multiply(m, F.lit(1.5), ("money", "double")).cast("double"), 4).alias("times"), fn.divide(m, F.lit(7), ("money", "integer")).cast("double").alias("by_int"), fn.divide(m, types.money(3.2), ("money", "money")).alias("ratio"))


@query("""SELECT p_partkey, CASE WHEN p_name = '' THEN NULL ELSE ascii(p_name) END AS first_byte, instr(p_name, 'e') AS at, upper(p_name) AS up, lower(p_name) AS low, length(p_name) AS chars, strlen(p_name) AS bytes, right(p_name, 3) AS ending, reverse(p_name) AS backwards, replace(p_name, 'a', 'xy') AS swapped, repeat(left(p_name, 1), 3) AS thrice FROM part""")
def string_basic(t):
    n = C("p_name")
    return t.part.select("p_partkey", fn.ascii(n).alias("first_byte"), fn.charindex(F.lit("e"), n).alias("at"), fn.upper(n).alias("up"), fn.lower(n).alias("low"), fn.char_length(n).alias("chars"), fn.byte_length(n).alias("bytes"), fn.right(n, F.lit(3)).alias("ending"), fn.reverse(n).alias("backwards"), fn.replace(n, F.lit("a"), F.lit("xy")).alias("swapped"), fn.replicate(F.left(n, F.lit(1)), F.lit(3)).alias("thrice"))


@query("""SELECT c_custkey, ltrim('  ' || c_name, ' ') AS l, rtrim(c_name || '  ', ' ') AS r, regexp_replace(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '^0+([0-9])', '\\1') AS z, substr(c_name, 3, 4) AS mid, substr(c_name, 5) AS tail, lpad(CAST(c_custkey AS VARCHAR), 12, ' ') AS aligned FROM customer""")
def string_trim(t):
    n, k = C("c_name"), C("c_custkey").cast("string")
    return t.customer.select("c_custkey", fn.ltrim(F.concat(F.lit("  "), n)).alias("l"), fn.rtrim(F.concat(n, F.lit("  "))).alias("r"), fn.lztrim(F.lpad(k, 9, "0")).alias("z"), fn.substring(n, F.lit(3), F.lit(4)).alias("mid"), fn.substring(n, F.lit(5)).alias("tail"), fn.ralign(k, F.lit(12)).alias("aligned"))


@query("""SELECT p_partkey, '"' || regexp_replace(p_name, '(["\\\\])', '\\\\\\1', 'g') || '"' AS quoted, regexp_replace(p_name, '([ae\\\\])', '\\\\\\1', 'g') AS escaped FROM part""")
def string_escape(t):
    return t.part.select("p_partkey", fn.quote(C("p_name")).alias("quoted"), fn.escape(C("p_name"), "ae").alias("escaped"))


@query("""SELECT p_partkey, lower(hex(encode(p_name))) AS hexed, decode(unhex(hex(encode(p_name)))) AS unhexed, base64(encode(p_name)) AS b64, decode(from_base64(base64(encode(p_name)))) AS unb64 FROM part""")
def string_codecs(t):
    n = C("p_name")
    return t.part.select("p_partkey", fn.to_hex(n).alias("hexed"), fn.from_hex(fn.to_hex(n)).alias("unhexed"), fn.to_base64(n).alias("b64"), fn.from_base64(fn.to_base64(n)).alias("unb64"))


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d, CASE WHEN abs(length(a.n_name) - length(b.n_name)) = levenshtein(a.n_name, b.n_name) THEN 1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)) / 2 ELSE 1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)) END AS likeness FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def string_similarity(t):
    pairs = t.nation.alias("a").join(t.nation.alias("b"), C("a.n_regionkey") == C("b.n_regionkey"))
    a, b = C("a.n_name"), C("b.n_name")
    return pairs.select(a.alias("a"), b.alias("b"), fn.levenshtein(a, b).alias("d"), fn.lev_compare(a, b).alias("likeness"))


@query("""WITH h AS (SELECT n_name, n_regionkey, hex(encode(lower(n_name))) AS x FROM nation),
c AS (SELECT *, list_transform(list_filter(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER)), lambda b: NOT (b BETWEEN 9 AND 13 OR b BETWEEN 32 AND 47 OR b BETWEEN 58 AND 64 OR b BETWEEN 91 AND 96 OR b BETWEEN 123 AND 126)), lambda b: CASE WHEN b BETWEEN 48 AND 57 THEN b + 75 ELSE b END) AS c FROM h),
p AS (SELECT n_name, n_regionkey, unnest(list_concat([96], c))::DOUBLE AS x, unnest(list_concat(c, [96]))::DOUBLE AS y FROM c),
v AS (SELECT n_name, n_regionkey, (CAST(floor((x * x * x + y * y * y) * ((x + 1) / (y + 1)) + 0.5) AS BIGINT) - 1) % 251 AS bin, sum((x + y) % 13 + 1) AS w FROM p GROUP BY ALL),
n AS (SELECT n_name, sqrt(sum(w * w)) AS size FROM v GROUP BY n_name)
SELECT a.n_name AS a, b.n_name AS b, round(CASE WHEN a.n_name = b.n_name THEN 1.0 ELSE coalesce((SELECT sum(u.w * w.w) FROM v u JOIN v w ON u.bin = w.bin WHERE u.n_name = a.n_name AND w.n_name = b.n_name), 0) / (x.size * y.size) END, 9) AS likeness
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN n x ON x.n_name = a.n_name JOIN n y ON y.n_name = b.n_name""")
def string_cosine(t):
    pairs = t.nation.alias("l").join(t.nation.alias("r"), C("l.n_regionkey") == C("r.n_regionkey"))
    return pairs.select(C("l.n_name").alias("a"), C("r.n_name").alias("b"), F.round(fn.cos_compare(C("l.n_name"), C("r.n_name")), 9).alias("likeness"))


@query("""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(concat_ws(' ', c_name, c_mktsegment), '[A-Za-z][A-Za-z''-]*|[^A-Za-z]+'), lambda p: CASE WHEN NOT regexp_matches(p, '^[A-Za-z]') THEN p
WHEN lower(regexp_extract(p, '^[A-Za-z]*')) = 'building' THEN 'BUILDING' || lower(substr(p, 9)) WHEN starts_with(lower(p), 'mac') AND length(regexp_extract(p, '^[A-Za-z]*')) > 4 THEN 'Mac' || upper(substr(p, 4, 1)) || lower(substr(p, 5)) ELSE upper(left(p, 1)) || lower(substr(p, 2)) END), '') AS spelt FROM customer""")
def string_mixed(t):
    return t.customer.select("c_custkey", fn.mixed(F.concat_ws(" ", "c_name", "c_mktsegment"), "BUILDING,Mac*").alias("spelt"))


@query("""SELECT c_custkey, 'Dear ' || c_name || CASE WHEN c_acctbal > 0 OR c_acctbal < 0 THEN ', you have ' || c_mktsegment ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' THEN '!' ELSE '' END AS letter FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal <> 0""")
def string_substitute(t):
    template = "Dear [:c:name][+:c:segment], you have [:c:segment][/+:c:segment][?:c:segment=BUILDING]![/?]"
    return t.customer.where("c_mktsegment is not null and c_acctbal <> 0").select("c_custkey", fn.substitute(template, {"c:name": C("c_name"), "c:segment": C("c_mktsegment")}).alias("letter"))


def _below_thousand(v: str) -> str:
    ones, tens = f"{fn.strings.ONES}", f"{fn.strings.TENS}"
    small = f"CASE WHEN {v} % 100 < 20 THEN {ones}[{v} % 100 + 1] WHEN {v} % 10 = 0 THEN {tens}[{v} % 100 // 10 + 1] ELSE {tens}[{v} % 100 // 10 + 1] || '-' || {ones}[{v} % 10 + 1] END"
    return f"concat_ws(' ', CASE WHEN {v} >= 100 THEN {ones}[{v} // 100 + 1] || ' Hundred' END, CASE WHEN {v} % 100 > 0 THEN {small} END)"


def _in_words(n: str) -> str:
    groups = [f"CASE WHEN {n} // {1000**k} % 1000 > 0 THEN {_below_thousand(f'({n} // {1000**k} % 1000)')} || '{' ' + word if word else ''}' END" for k, word in ((2, "Million"), (1, "Thousand"), (0, ""))]
    return f"CASE WHEN {n} = 0 THEN 'Zero' ELSE concat_ws(' ', {', '.join(groups)}) END"


@query(f"""SELECT o_orderkey, {_in_words("o_orderkey")} AS in_words, {_in_words("whole")} || ' and ' || lpad(CAST(hundredths % 100 AS VARCHAR), 2, '0') || '/100' AS price
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(floor(CAST(o_totalprice AS DECIMAL(14,4)) * 100) AS BIGINT) AS hundredths FROM orders)""")
def number_wordify(t):
    return t.orders.select("o_orderkey", fn.wordify(C("o_orderkey")).alias("in_words"), fn.wordify(types.money(C("o_totalprice")), "money").alias("price"))


@query("""SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, trunc(c_acctbal) AS tr, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, 0), 5000) END AS held, round(sqrt(abs(c_acctbal)), 9) AS s, c_acctbal * c_acctbal AS sq, round(pow(c_custkey, 0.5), 9) AS p, round(log10(c_custkey + 1), 9) AS lg FROM customer""")
def math_basic(t):
    x = C("c_acctbal")
    return t.customer.select("c_custkey", fn.abs_(x).alias("a"), fn.round_(x, 1).alias("r"), fn.truncate(x).alias("tr"), fn.constrain(x, F.lit(0.0), F.lit(5000.0)).alias("held"), F.round(fn.sqrt(fn.abs_(x)), 9).alias("s"), fn.square(x).alias("sq"), F.round(fn.power(C("c_custkey"), F.lit(0.5)), 9).alias("p"), F.round(fn.log10(C("c_custkey") + 1), 9).alias("lg"))


@query("""SELECT l_orderkey, l_linenumber, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(asin(x), 9) AS d, round(acos(x), 9) AS e, round(atan(x), 9) AS f, round(atan2(x, l_quantity), 9) AS g, round(degrees(x), 9) AS h, round(radians(x), 9) AS i FROM (SELECT *, l_discount AS x FROM lineitem)""")
def math_trigonometry(t):
    x = C("l_discount")
    columns = {"a": fn.sin(x), "b": fn.cos(x), "c": fn.tan(x), "d": fn.asin(x), "e": fn.acos(x), "f": fn.atan(x), "g": fn.atan2(x, C("l_quantity")), "h": fn.degrees(x), "i": fn.radians(x)}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in columns.items()])


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, dayofweek(o_orderdate) + 1 AS w FROM orders""")
def date_parts(t):
    x = C("o_orderdate")
    return t.orders.select("o_orderkey", fn.datepart("year", x).alias("y"), fn.datepart("month", x).alias("m"), fn.datepart("day", x).alias("d"), fn.datepart("hour", x).alias("h"), fn.datepart("weekday", x).alias("w"))


@query("""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month, CAST(o_orderdate - INTERVAL 10 DAY AS TIMESTAMP) AS before, datediff('month', o_orderdate, TIMESTAMP '1999-03-01 00:00:00') AS months, datediff('day', o_orderdate, TIMESTAMP '1999-03-01 00:00:00') AS days, datediff('year', o_orderdate, TIMESTAMP '1999-03-01 00:00:00') AS years, datediff('hour', o_orderdate, TIMESTAMP '1999-03-01 00:30:00') AS hours FROM orders""")
def date_arithmetic(t):
    x, to = C("o_orderdate"), F.lit("1999-03-01 00:00:00").cast("timestamp_ntz")
    later = F.lit("1999-03-01 00:30:00").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", fn.dateadd("month", F.lit(1), x).alias("next_month"), fn.dateadd("day", F.lit(-10), x).alias("before"), fn.datediff("month", x, to).alias("months"), fn.datediff("day", x, to).alias("days"), fn.datediff("year", x, to).alias("years"), fn.datediff("hour", x, later).alias("hours"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS short, strftime(o_orderdate, '%B %-d, %Y %H:%M') AS long FROM orders""")
def date_format(t):
    return t.orders.select("o_orderkey", fn.dateformat(C("o_orderdate"), "dd MMM yyyy").alias("short"), fn.dateformat(C("o_orderdate"), "MMMM d, yyyy HH:mm").alias("long"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || printf('%,d', CAST(floor(abs(c_acctbal)) AS BIGINT)) || '.' || lpad(CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS shown FROM customer""")
def money_format(t):
    return t.customer.select("c_custkey", fn.moneyformat(types.money(C("c_acctbal")), "$#,###,##0.00").alias("shown"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value > 50 THEN 'high' ELSE 'low' END AS level, coalesce(value, -1) AS filled, nullif(event_type, 'click') AS other FROM events""")
def conditionals(t):
    return t.events.select("event_id", fn.condition(C("value") > 50, F.lit("high"), F.lit("low")).alias("level"), fn.isnull(C("value"), F.lit(-1.0)).alias("filled"), fn.nullif(C("event_type"), F.lit("click")).alias("other"))


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS i, CAST(c_custkey AS VARCHAR) AS s, 0 AS junk, 31 AS hexed, CAST(c_nationkey AS DOUBLE) AS d FROM customer""")
def conversions(t):
    return t.customer.select("c_custkey", types.convert("integer", C("c_acctbal"), "double").alias("i"), types.convert("string", C("c_custkey")).alias("s"), types.convert("integer", C("c_name")).alias("junk"), types.convert("integer", F.lit("0x1f")).alias("hexed"), types.convert("double", C("c_nationkey"), "integer").alias("d"))


@query("""SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s256 FROM documents""")
def hashes(t):
    return t.documents.select("doc_id", fn.hash_("md5", C("text")).alias("m"), fn.hash_("sha1", C("text")).alias("s1"), fn.hash_("sha256", C("text")).alias("s256"))


def _pad(x: int) -> str:
    return f"unhex(array_to_string(list_transform(range(0, 64), lambda i: printf('%02X', xor(CAST('0x' || substr(k, 2 * i + 1, 2) AS INTEGER), {x}))), ''))"


@query(f"""SELECT c_custkey, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(c_name)))) AS mac FROM (SELECT c_custkey, c_name, rpad(hex(encode(c_mktsegment)), 128, '0') AS k FROM customer)""")
def keyed_hashes(t):
    return t.customer.select("c_custkey", fn.hmac("sha256", C("c_name"), C("c_mktsegment")).alias("mac"))


@query("""SELECT * FROM (VALUES (1, '120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b'), (2, 'ae4d0c95af6b46d32d0adff928f06dd02a303f8ef3c251dfd6e2d85a95474c43'), (4096, 'c5e478d59288c841aa530db6845c4c8d962893a001ce4e11a4963873aa98134a')) AS t(rounds, derived)""")
def derived_keys(t):
    """Published test vectors of this derivation with SHA-256, password ``password`` and salt ``salt``."""
    one = lambda n: t.spark.range(1).select(F.lit(n).alias("rounds"), fn.pbkdf2("sha256", F.lit("password"), F.lit("salt"), n, 32).alias("derived"))
    return one(1).unionByName(one(2)).unionByName(one(4096))


@query("""SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS short, CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP) AS dashes, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS named, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS spelt, CAST(date_trunc('minute', o_orderdate) - INTERVAL 6 HOUR AS TIMESTAMP) AS east, CAST(date_trunc('minute', o_orderdate) + INTERVAL 90 MINUTE AS TIMESTAMP) AS west, CAST(NULL AS TIMESTAMP) AS junk FROM orders""")
def convert_datetime(t):
    text = lambda pattern: types.convert("datetime", F.date_format("o_orderdate", pattern))
    rows = t.dealt(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    return rows.select("o_orderkey", text("M/d/yy").alias("short"), text("M-d-yyyy h:mma").alias("dashes"), text("d MMM yyyy HH:mm:ss").alias("named"), text("MMMM d, yyyy").alias("spelt"), text("yyyy-MM-dd HH:mm '+0600'").alias("east"), text("yyyy-MM-dd HH:mm'-01:30'").alias("west"), types.convert("datetime", C("o_orderpriority")).alias("junk"))


@query("""SELECT o_orderkey, 1 + day(o_orderdate) - 1 || CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END || strftime(o_orderdate, ' %B %y') AS ordinal, strftime(o_orderdate, '%Y-%-m-%-d %I:%M%p') AS half_day, strftime(o_orderdate, '%I%p %M:%S') AS hour_first, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS numbers FROM orders""")
def date_patterns(t):
    show = lambda pattern: fn.dateformat(C("o_orderdate"), pattern)
    return t.orders.select("o_orderkey", show("ddd MMMM yy").alias("ordinal"), show("yyyy-M-d hh:mm").alias("half_day"), show("hh mm:ss").alias("hour_first"), show("MM/dd/yyyy HH:mm:ss").alias("numbers"))


@query("""SELECT c_custkey, CASE WHEN m = 0 THEN '-0-' WHEN m < 0 THEN '-$' || n ELSE '$' || n END AS zero, CASE WHEN m < 0 THEN ' ' || n || ' ' ELSE '(' || n || ')' END AS brackets, CASE WHEN m < 0 THEN '(' || n || ')' ELSE ' ' || n || ' ' END AS parentheses, n || CASE WHEN m < 0 THEN '-' ELSE ' ' END AS sign_last, CASE WHEN m < 0 THEN '-' ELSE '+' END || n AS sign_first, CASE WHEN m < 0 THEN '-' ELSE '' END || lpad(n, 8, ' ') AS padded, CASE WHEN m < 0 THEN '-' ELSE '' END || lpad(n, 8, '0') AS zeros, CASE WHEN m < 0 THEN '-' ELSE '' END || CAST(w AS VARCHAR) || CASE WHEN c > 0 THEN '.' || rtrim(lpad(CAST(c AS VARCHAR), 2, '0'), '0') ELSE '' END AS short
FROM (SELECT *, CAST(w AS VARCHAR) || '.' || lpad(CAST(c AS VARCHAR), 2, '0') AS n FROM (SELECT c_custkey, c_acctbal AS m, CAST(round(abs(c_acctbal) * 100) AS BIGINT) // 100 AS w, CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 100 AS c FROM customer))""")
def money_patterns(t):
    show = lambda pattern: fn.moneyformat(types.money(C("c_acctbal")), pattern)
    return t.customer.select("c_custkey", show("Z$###0.00").alias("zero"), show("[###0.00]").alias("brackets"), show("(###0.00)").alias("parentheses"), show("###0.00-").alias("sign_last"), show("+###0.00").alias("sign_first"), show("****0.00").alias("padded"), show("^^^^0.00").alias("zeros"), show("0").alias("short"))


@query("""SELECT o_custkey, CAST(trunc(sum(m) * 10000 / count(m)) AS DOUBLE) / 10000 AS money_mean, CAST(sum(k) // count(k) AS BIGINT) AS integer_mean, round(avg(o_totalprice), 6) AS mean FROM (SELECT *, CAST(o_totalprice AS DECIMAL(14,4)) AS m, o_orderkey + 9007199254740993 AS k FROM orders) GROUP BY o_custkey""")
def avg_by_type(t):
    rows = t.orders.withColumn("k", C("o_orderkey") + 9007199254740993)
    return grouping.group(rows, ["o_custkey"], [grouping.avg(types.money(C("o_totalprice")), "money").cast("double").alias("money_mean"), grouping.avg(C("k"), "integer").alias("integer_mean"), F.round(grouping.avg(C("o_totalprice")), 6).alias("mean")])


@query("""SELECT o_orderkey, CAST(m + 1.2345 AS DOUBLE) AS plus, CAST(m - 7 AS DOUBLE) AS minus, o_totalprice + 0.5 AS real_plus, -CAST(m AS DOUBLE) AS negated FROM (SELECT *, CAST(o_totalprice AS DECIMAL(14,4)) AS m FROM orders)""")
def money_sums(t):
    m = types.money(C("o_totalprice"))
    return t.orders.select("o_orderkey", fn.add(m, types.money(1.2345), ("money", "money")).cast("double").alias("plus"), fn.subtract(m, F.lit(7), ("money", "integer")).cast("double").alias("minus"), fn.add(C("o_totalprice"), F.lit(0.5), ("double", "double")).alias("real_plus"), (-m).cast("double").alias("negated"))


@query("""SELECT n_name, strlen(n_name) AS text_bytes, 4 AS integer_bytes, TRUE AS now, TRUE AS random, TRUE AS somebody, 3 * n_nationkey AS evaluated FROM nation""")
def session_functions(t):
    now, r = fn.getdate(), fn.rand(7)
    return t.nation.select("n_name", fn.octet_length(C("n_name")).alias("text_bytes"), fn.octet_length(C("n_nationkey"), "integer").alias("integer_bytes"), (F.year(now) > 2000).alias("now"), ((r >= 0) & (r < 1)).alias("random"), (F.length(fn.user_name()) > 0).alias("somebody"), fn.eval_("3 * n_nationkey").alias("evaluated"))


@query("""SELECT a.n_name AS a, b.n_name AS b, CASE WHEN greatest(length(a.n_name), length(b.n_name)) <= 20 AND (d + 15) / 20 < 1 THEN 1 - share * ((d + 15) / 20) ELSE 1 - share END AS eased FROM (SELECT *, CASE WHEN abs(length(x) - length(y)) = d THEN d / greatest(length(x), length(y)) / 2 ELSE d / greatest(length(x), length(y)) END AS share FROM (SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name)::DOUBLE AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)) JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j""")
def string_similarity_by_width(t):
    pairs = t.nation.alias("a").join(t.nation.alias("b"), C("a.n_regionkey") == C("b.n_regionkey"))
    return pairs.select(C("a.n_name").alias("a"), C("b.n_name").alias("b"), fn.lev_compare(C("a.n_name"), C("b.n_name"), 20).alias("eased"))


# ---- tables that change


@query("""SELECT * FROM (SELECT c_custkey, c_name, CASE WHEN coalesce(c_acctbal < 0, FALSE) THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer)""")
def update_set(t):
    return dml.update(t.customer.select("c_custkey", "c_name", "c_acctbal"), C("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})


@query("""SELECT event_id, value FROM events WHERE NOT coalesce(value < 50, FALSE)""")
def delete_where(t):
    return dml.delete(t.events.select("event_id", "value"), C("value") < 50)


@query("""SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT -n_nationkey - 1, n_name, NULL FROM nation""")
def insert_select(t):
    target = t.supplier.select(C("s_suppkey").alias("k"), C("s_name").alias("name"), C("s_acctbal").alias("bal"))
    return dml.insert(target, t.nation.select((-C("n_nationkey") - 1).alias("k"), C("n_name").alias("name")))


@query("""SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT -n_nationkey - 1, n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE 7 END FROM nation""")
def insert_through_filter(t):
    """Inserts through a query with ``WHERE nation = 7``: rows that don't say a nation get that one."""
    target = t.supplier.select(C("s_suppkey").alias("k"), C("s_name").alias("name"), C("s_nationkey").alias("nation"))
    rows = t.nation.select((-C("n_nationkey") - 1).alias("k"), C("n_name").alias("name"), F.when(C("n_regionkey") == 2, 9).alias("nation"))
    return dml.insert_through(target, rows, {"nation": 7})


@query("""WITH src AS (SELECT o_custkey AS k, sum(o_totalprice) AS x FROM orders GROUP BY o_custkey UNION ALL SELECT 1000000 + r_regionkey, r_regionkey * 1.0::DOUBLE FROM region)
SELECT c.c_custkey AS k, CASE WHEN s.k IS NULL THEN 0 ELSE round(s.x, 2) END AS x FROM customer c LEFT JOIN src s ON s.k = c.c_custkey UNION ALL SELECT s.k, round(s.x, 2) FROM src s WHERE s.k NOT IN (SELECT c_custkey FROM customer)""")
def upsert_merge(t):
    target = t.customer.select(C("c_custkey").alias("k"), F.lit(0.0).alias("x"))
    source = t.orders.groupBy(C("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("x")).unionByName(t.region.select((C("r_regionkey") + 1000000).cast("long").alias("k"), C("r_regionkey").cast("double").alias("x")))
    return dml.upsert(target, source, ["k"], {"x": C("s.x")}, C("x")).select("k", F.round("x", 2).alias("x"))


# ---- pivots, trees, reports, rules


@query("""SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_brand IS NOT NULL OR p_type IS NOT NULL OR p_size IS NOT NULL""")
def eav_round_trip(t):
    eav = pivot.eav_unpivot(t.part, ["p_partkey"], ["p_brand", "p_type", "p_size"])
    return pivot.eav_pivot(eav, ["p_partkey"], "attr_name", ["attr_value"], {"p_brand": "string", "p_type": "string", "p_size": "int"})


def _tree(t):
    top = t.spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("world").alias("name"))
    regions = t.region.select(F.concat(F.lit("r"), C("r_regionkey").cast("string")).alias("id"), F.lit("world").alias("parent"), C("r_name").alias("name"))
    nations = t.nation.select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), C("n_regionkey").cast("string")).alias("parent"), C("n_name").alias("name"))
    return top.unionByName(regions).unionByName(nations)


TREE = """WITH RECURSIVE nodes AS (SELECT 'world' AS id, NULL AS parent, 'world' AS name UNION ALL SELECT 'r' || r_regionkey, 'world', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
walk AS (SELECT id, name, '/' || name AS path, 0 AS depth FROM nodes WHERE id = 'world' UNION ALL SELECT n.id, n.name, w.path || '/' || n.name, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id)
SELECT id, name, path, depth FROM walk """


@query(TREE)
def subtree_inclusive(t):
    return hierarchy.subtree(_tree(t), C("id") == "world", inclusive=True).select("id", "name", C("__path").alias("path"), C("__depth").alias("depth"))


@query(TREE.replace("'/' || name AS path, 0 AS depth", "'/' || name AS path, CAST(NULL AS VARCHAR) AS up, CAST(NULL AS VARCHAR) AS above, 0 AS depth").replace("w.path || '/' || n.name, w.depth", "w.path || '/' || n.name, w.path, w.name, w.depth").replace("SELECT id, name, path, depth FROM", "SELECT id, up, above, depth FROM") + "WHERE depth > 0")
def subtree_parents(t):
    return hierarchy.subtree(_tree(t), C("id") == "world").select("id", C("__parentpath").alias("up"), C("__parentname").alias("above"), C("__depth").alias("depth"))


@query(TREE + "WHERE depth = 1")
def subtree_pruned(t):
    return hierarchy.subtree(_tree(t), C("id") == "world", where=C("__depth") >= 1, pruned=True).select("id", "name", C("__path").alias("path"), C("__depth").alias("depth"))


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def inherit_attributes(t):
    child = t.nation.withColumn("label", F.when(C("n_nationkey") % 2 == 0, C("n_name")))
    return hierarchy.inherit(child, t.region.select("r_regionkey", C("r_name").alias("label")), "n_regionkey", "r_regionkey", ["label"]).select("n_nationkey", "label")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) FILTER (o_orderstatus = 'F') OVER w AS closed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def report_running(t):
    out = reports.running(t.orders, [C("o_orderkey")], {"total": ("sum", C("o_totalprice"), None), "closed": ("count", F.lit(1), C("o_orderstatus") == "F")}, [C("o_custkey")])
    return out.select("o_orderkey", F.round("total", 2).alias("total"), "closed")


@query("""SELECT coalesce(a.n, b.n) AS row_no, r_name, n_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS n, r_name FROM region) a FULL JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS n, n_name FROM nation) b ON a.n = b.n""")
def report_parallel(t):
    return reports.parallel(t.region, t.nation, [C("r_regionkey")], [C("n_nationkey")]).select("row_no", "r_name", "n_name")


@query("""SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey""")
def report_nested(t):
    return reports.nested(t.region, t.nation, C("n_regionkey") == C("r_regionkey")).select("r_name", "n_name")


@query("""SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY ALL""")
def report_chart_series(t):
    out = reports.chart_series(t.orders.withColumn("y", F.year("o_orderdate")), "y", "o_orderstatus", F.count(F.lit(1)), ["F", "O"])
    return out.select("y", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'c_acctbal:min' END, CASE WHEN NOT c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment:enum' END], lambda x: x IS NOT NULL), ' ') AS broken FROM customer""")
def hint_checks(t):
    out = rules.check_hints(t.customer, {"c_acctbal": {"min": 0}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}})
    return out.select("c_custkey", F.array_join("violations", " ").alias("broken"))


@query("""SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND p_size = 10""")
def request_filter(t):
    return rules.request_filter(t.part, {"p_name": "*a*", "p_size": "10"}).select("p_partkey")


@query("""WITH d AS (SELECT *, sha1('key|' || c_name || '|key|' || c_name) AS dn, CAST('0x' || left(sha1('key|' || c_custkey || '|key|' || c_custkey), 15) AS BIGINT) AS nk,
  CAST('0x' || left(sha1('key|c_acctbal|customer|customer|' || c_acctbal || '|key|c_acctbal|customer|customer|' || c_acctbal), 15) AS BIGINT) AS nb FROM customer)
SELECT translate(left(repeat(dn, 2), length(c_name)), '0123456789', 'ghijklmnop') AS c_name, nk % CAST(pow(10, length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS c_custkey, (nb % 2000001 - 1000000) / 100 AS c_acctbal, c_nationkey, c_mktsegment FROM d""")
def obfuscated(t):
    return rules.obfuscate(t.customer, "key", {"c_name": "KV", "c_custkey": "KV", "c_acctbal": "KANTV"}, "customer")


# ---- set operations


@query("""SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier""")
def set_union(t):
    return setops.union(t.nation.select(C("n_nationkey").alias("k")), t.supplier.select(C("s_nationkey").alias("k")))


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def set_intersect(t):
    return setops.intersect(t.customer.select(C("c_nationkey").alias("k")), t.supplier.select(C("s_nationkey").alias("k")))


@query("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier""")
def set_except(t):
    return setops.except_(t.nation.select(C("n_nationkey").alias("k")), t.supplier.select(C("s_nationkey").alias("k")))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL""")
def events_by_hour(t):
    w = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return w.select(C("window.start").alias("hour"), "event_type", "n", "v")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_by_day(t):
    """The events as a stream of files, counted by day; each batch replaces the table of counts in the shared folder."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    counts = streams.windowed(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")])
    out = new_path(t.spark, "by-day")
    save = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", new_path(t.spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select(C("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""SELECT CAST(min(ts) AS TIMESTAMP) AS began, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def event_sessions(t):
    out = streams.sessions(t.events, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select(C("session_start").cast("timestamp_ntz").alias("began"), "user_id", "n")
