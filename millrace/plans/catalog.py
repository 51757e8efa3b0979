"""A catalog of paths: sources, stored queries with parameters, and collections of a session."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dml
from millrace.sources import files, structure, text, trees


#: Readers by type.
READERS: dict[str, Callable[..., DataFrame]] = {
    "text/csv": text.read_delimited, "text/plain": text.read_fixed_width, "application/json": trees.read_json, "application/xml": trees.read_xml, "message/rfc822": files.read_mail,
    "application/mbox": lambda spark, path: files.read_mail(spark, path, mbox=True), "system/structure": structure.read_structure, "system/directory": files.list_files,
    "application/parquet": lambda spark, path: spark.read.parquet(path),
}


@dataclass(frozen=True)
class StoredQuery:
    """Spark SQL text with named parameters (``:color``), their types and defaults."""

    text: str
    parameters: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


class Catalog:
    """Paths to DataFrames. Sources are read when they are asked for, so an open path always sees the current files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, Callable[[], DataFrame]] = {}
        self._queries: dict[str, StoredQuery] = {}
        self._collections: dict[str, DataFrame] = {}
        self.variables: dict[str, dict[str, object]] = {}

    def source(self, path: str, reader: Callable[[], DataFrame]) -> None:
        self._sources[path] = reader

    def source_of_type(self, path: str, mime: str, folder: str, **options) -> None:
        """A source that is read by its type, whatever the file's name is: one of READERS."""
        if mime not in READERS:
            raise KeyError(f"no reader for {mime}; one of {', '.join(sorted(READERS))}")
        self._sources[path] = lambda: READERS[mime](self.spark, folder, **options)

    def link(self, path: str, to: str) -> None:
        self._sources[path] = lambda: self.open(to)

    def open(self, path: str) -> DataFrame:
        if path in self._queries:
            return self.execute(path)
        if path not in self._sources:
            raise KeyError(f"nothing at {path}")
        return self._sources[path]()

    def wildcard(self, pattern: str) -> DataFrame:
        """The union of all sources that match, ``*`` standing for anything within a path element; missing columns are null."""
        from fnmatch import fnmatchcase

        hits = [p for p in sorted(self._sources) if len(p.split("/")) == len(pattern.split("/")) and all(fnmatchcase(a, b) for a, b in zip(p.split("/"), pattern.split("/")))]
        if not hits:
            raise KeyError(f"nothing matches {pattern}")
        frames = [self.open(p).withColumn("__path", F.lit(p)) for p in hits]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def store(self, path: str, query: StoredQuery) -> None:
        self._queries[path] = query

    def execute(self, path: str, criteria: Column | None = None, **parameters) -> DataFrame:
        """Run a stored query. Parameters are bound, never pasted into the text; criteria filter its result and Catalyst pushes them down."""
        q = self._queries[path]
        unknown = set(parameters) - set(q.parameters)
        if unknown:
            raise TypeError(f"{path} has no parameters {sorted(unknown)}")
        args = {n: _typed(parameters.get(n, q.defaults.get(n)), t) for n, t in q.parameters.items()}
        for p, reader in self._sources.items():
            reader().createOrReplaceTempView(_view(p))
        for name, df in self._collections.items():
            df.createOrReplaceTempView(name)
        out = self.spark.sql(q.text, args=args)
        return out if criteria is None else out.where(criteria)

    def object(self, path: str) -> DataFrame:
        """The object at a path as a table of one row: the first one of its source, without rows if there is none."""
        return self.open(path).limit(1)

    def value(self, path: str, attribute: str) -> Column:
        """One attribute of the first row at a path, as a constant for other queries; null if there is none."""
        row = self.open(path).select(attribute).head()
        return F.lit(None if row is None else row[0])

    # -- objects of variables

    def declare_object(self, name: str) -> None:
        self.variables[name] = {}

    def assign(self, name: str, df: DataFrame, order: Column) -> None:
        """Set an object's variables to the values of a query's last row by ``order``. Only that row comes to the driver; no row changes nothing."""
        row = df.orderBy(order.desc()).head()
        if row is not None:
            self.variables[name].update(row.asDict())

    def variable(self, name: str, attribute: str) -> Column:
        return F.lit(self.variables[name].get(attribute))

    # -- collections

    def declare(self, name: str, schema: str) -> DataFrame:
        """An empty collection."""
        self._collections[name] = self.spark.createDataFrame([], schema)
        return self._collections[name]

    def collection(self, name: str) -> DataFrame:
        return self._collections[name]

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        self._collections[name] = dml.insert(self._collections[name], rows)
        return self._collections[name]

    def update(self, name: str, where: Column, values: dict[str, Column]) -> DataFrame:
        self._collections[name] = dml.update(self._collections[name], where, values)
        return self._collections[name]

    def delete(self, name: str, where: Column) -> DataFrame:
        self._collections[name] = dml.delete(self._collections[name], where)
        return self._collections[name]

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Column) -> DataFrame:
        self._collections[name] = dml.upsert(self._collections[name], rows, keys, values, order)
        return self._collections[name]

    def drop(self, name: str) -> None:
        del self._collections[name]


def _typed(value, kind: str):
    """A parameter's value as its declared type; only literals can be bound."""
    return None if value is None else {"int": int, "bigint": int, "double": float, "string": str}.get(kind, lambda v: v)(value)


def _view(path: str) -> str:
    return "src" + "".join(c if c.isalnum() else "_" for c in path)


def rows(df: DataFrame):
    """Fetch a result row by row, one partition in memory at a time."""
    return df.toLocalIterator()


def show_plan(df: DataFrame) -> str:
    """The plan that Spark chose, as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
