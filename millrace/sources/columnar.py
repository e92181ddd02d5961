"""Stored tables: Parquet whose layout takes the place of hand-written indexes.

A primary key range-partitions and sorts the files, so that a point or range lookup skips files
and row groups by their min/max. Further index columns get Parquet bloom filters. Bucketing on
a key lets equi-joins and lookups on it go without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store(df: DataFrame, path: str, primary_key: Sequence[str] = (), indexes: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write df below path and read it back. Key order costs one shuffle, at load time."""
    if primary_key:
        df = df.repartitionByRange(*primary_key).sortWithinPartitions(*primary_key)
    writer = df.write.mode(mode)
    for column in indexes:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite", path: str | None = None) -> DataFrame:
    """Save df as the table name, bucketed and sorted by key, below path or in the session's warehouse."""
    writer = df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
