"""The engine's front door: statements in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.catalog import Catalog, TableDef
from millrace.plans.changes import ChangeLog
from millrace.plans.statements import CreateTable, Delete, Insert, Select, StatementError, Update, parse, split_statements
from millrace.sources import columnar, files
from millrace.sources.pipe import read_pipe

#: A longer log is folded into a new stored version of its table.
COMPACT_AFTER = 50


class Session:
    """Tables over data_dir/<name>.csv, stored as Parquet below store_dir.

    The catalog outlives the session; the change log doesn't until it is compacted.
    """

    def __init__(self, spark: SparkSession, data_dir: str, store_dir: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.data_dir, self.store_dir, self.compact_after = spark, data_dir.rstrip("/"), store_dir.rstrip("/"), compact_after
        self.catalog = Catalog(spark, f"{self.store_dir}/catalog.json").load()
        self.logs: dict[str, ChangeLog] = {}
        for name in self.catalog.tables:
            self._publish(name)

    def execute(self, text: str) -> DataFrame | None:
        """Run one statement; a SELECT gives its DataFrame."""
        statement = parse(text)
        if isinstance(statement, Select):
            return self.spark.sql(statement.text)
        if isinstance(statement, CreateTable):
            self.create(statement)
        else:
            self.change(statement)
        return None

    def script(self, text: str) -> list[DataFrame]:
        """Run all statements; the results of its SELECTs."""
        whole, rest = split_statements(text)
        results = [self.execute(s) for s in (*whole, *([rest] if rest.strip() else []))]
        return [r for r in results if r is not None]

    def create(self, statement: CreateTable) -> None:
        """Declare a table and lay its text file out as Parquet; without a file it starts empty."""
        if statement.name in self.catalog:
            raise StatementError(f"table {statement.name!r} exists")
        source = f"{self.data_dir}/{statement.name}.csv"
        if files.exists(self.spark, source):
            rows = read_pipe(self.spark, source, statement.schema)
        else:
            rows = self.spark.createDataFrame([], statement.schema)
        table = TableDef(statement.name, statement.schema, self._path(statement.name, 0), statement.primary_key, statement.indexes)
        columnar.store(rows, table.path, table.primary_key, table.indexes)
        self.catalog.add(table)
        self._publish(statement.name)

    def change(self, statement: Insert | Delete | Update) -> None:
        name = statement.table.lower()
        if name not in self.catalog:
            raise StatementError(f"no table {statement.table!r}")
        log = self.logs.setdefault(name, ChangeLog())
        before, count = list(log.changes), log.statements
        log.add(statement)
        try:
            self._publish(name)
        except Exception:
            log.changes, log.statements = before, count
            self._publish(name)
            raise
        if len(log) >= self.compact_after:
            self.compact(name)

    def table(self, name: str) -> DataFrame:
        """Stored rows with the changes so far."""
        table = self.catalog[name]
        base = self.spark.read.schema(table.schema).parquet(table.path)
        return self.logs[name.lower()].apply(base) if name.lower() in self.logs else base

    def compact(self, name: str) -> None:
        """Write the changed table as a new version.

        The one before stays until the next time, for results that still read it; the one before that goes.
        """
        table = self.catalog[name]
        rows, old = self.table(name), table.previous
        new = self._path(table.name, table.version + 1)
        columnar.store(rows, new, table.primary_key, table.indexes)
        table.previous, table.path, table.version = table.path, new, table.version + 1
        self.logs.pop(name.lower(), None)
        self.catalog.save()
        self._publish(name)
        if old:
            files.delete(self.spark, old)

    def _path(self, name: str, version: int) -> str:
        return f"{self.store_dir}/{name.lower()}/v{version}"

    def _publish(self, name: str) -> None:
        self.table(name).createOrReplaceTempView(self.catalog[name].name)
