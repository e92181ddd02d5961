"""Pipe-delimited text without header."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Quotes and escapes are data. A short line gives nulls, an empty field is null.
OPTIONS = {"sep": "|", "quote": "", "escape": "", "header": "false", "dateFormat": "yyyy-MM-dd", "mode": "PERMISSIVE"}


def read_pipe(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**OPTIONS).schema(schema).csv(path)


def write_pipe(df: DataFrame, path: str, mode: str = "error") -> None:
    """Text part files with one line for each row."""
    df.select(line_column(df).alias("value")).write.mode(mode).text(path)


def line_column(df: DataFrame) -> Column:
    """A row as one line; nulls are empty fields."""
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))


def lines(df: DataFrame) -> Iterator[str]:
    """A result's lines, one partition in the driver at a time."""
    renamed = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # names may repeat
    for row in renamed.select(line_column(renamed).alias("line")).toLocalIterator():
        yield row["line"]
