"""Every registered query against its SQL."""

import pytest
from pyspark.sql import functions as F

from millrace import source_queries  # noqa: F401  (registers its queries)
from millrace.queries import ORACLE, QUERIES
from tests.compare import of_duck, of_spark


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert of_spark(QUERIES[name](spark, "/root/testdata/sf0.001")) == of_duck(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_group_null_key_rounds_halves_away_from_zero(spark, tmp_path):
    """Halves of either sign, the largest double below one half, and nulls, against DuckDB."""
    import duckdb

    values = [5.0, 15.0, 25.0, -5.0, -25.0, 4.9999999999999991, 4.0, None, None]
    spark.createDataFrame([(v,) for v in values], "value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert of_spark(QUERIES["group_null_key"](spark, str(tmp_path))) == of_duck(con, ORACLE["group_null_key"])


def test_join_independent_outer_is_spread(spark, tmp_path, monkeypatch):
    """A nation with most rows, one with suppliers only, one with customers only, one with neither, and keys without a nation: the same rows as the SQL's, not in one task."""
    import duckdb

    from millrace.operators import joins

    monkeypatch.setattr(joins, "SHARE", 50, raising=False)
    nations = [(i, f"n{i}") for i in range(4)]
    suppliers = [(f"s{i}", 0, 6000.0) for i in range(800)] + [("only", 1, 6000.0), ("poor", 2, 1.0), ("lost", None, 6000.0), ("far", 9, 6000.0)]
    customers = [(f"c{i}", 0, 9500.0) for i in range(30)] + [("alone", 2, 9500.0), ("lost", None, 9500.0), ("twin", 0, 9500.0), ("twin", 0, 9500.0)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(suppliers, "s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("nation", "supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    out = QUERIES["join_independent_outer"](spark, str(tmp_path))
    assert of_spark(out) == of_duck(con, ORACLE["join_independent_outer"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800 * 32 + 3 and max(sizes) < 0.6 * sum(sizes)


def test_convert_datetime_is_dealt_over_tasks(spark):
    sizes = [r["count"] for r in QUERIES["convert_datetime"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1500 and max(sizes) < 750


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
