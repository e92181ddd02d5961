"""Declared tables, kept as JSON beside the stored data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from millrace.sources import files


@dataclass
class TableDef:
    name: str
    schema: StructType
    path: str
    primary_key: tuple[str, ...] = ()
    indexes: tuple[str, ...] = ()
    version: int = 0
    previous: str | None = None

    def to_json(self) -> dict:
        return {"name": self.name, "schema": self.schema.jsonValue(), "path": self.path, "primary_key": self.primary_key, "indexes": self.indexes, "version": self.version, "previous": self.previous}

    @classmethod
    def from_json(cls, x: dict) -> TableDef:
        return cls(x["name"], StructType.fromJson(x["schema"]), x["path"], tuple(x["primary_key"]), tuple(x["indexes"]), x["version"], x.get("previous"))


@dataclass
class Catalog:
    """Tables by lower-cased name; save() and load() go through Spark's file systems."""

    spark: SparkSession
    path: str
    tables: dict[str, TableDef] = field(default_factory=dict)

    def load(self) -> Catalog:
        if files.exists(self.spark, self.path):
            self.tables = {t["name"].lower(): TableDef.from_json(t) for t in json.loads(files.read_text(self.spark, self.path))}
        return self

    def save(self) -> None:
        files.write_text(self.spark, self.path, json.dumps([t.to_json() for t in self.tables.values()], indent=1))

    def add(self, table: TableDef) -> None:
        self.tables[table.name.lower()] = table
        self.save()

    def __getitem__(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise KeyError(f"no table {name!r}")
        return self.tables[name.lower()]

    def __contains__(self, name: str) -> bool:
        return name.lower() in self.tables
