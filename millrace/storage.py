"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a temporary folder if Spark runs in one process on this machine, else one in
    the warehouse, which all executors reach."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_folder"):
        alone = sc.master == "local" or sc.master.startswith("local[")
        sc._millrace_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-{uuid.uuid4().hex}"
    return sc._millrace_folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, which cuts the lineage, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
