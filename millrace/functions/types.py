"""DDL words and the Spark types that stand for them."""

from __future__ import annotations

from pyspark.sql import types as T

#: The words of the dialect. Integers are 64-bit, decimals are binary doubles.
DDL_TYPES = {
    "string": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "int": T.LongType(),
    "decimal": T.DoubleType(),
    "date": T.DateType(),
}


class UnsupportedType(ValueError):
    """A column type that the dialect doesn't know."""


def spark_type(word: str) -> T.DataType:
    """The Spark type of a DDL word; length and precision in parentheses are ignored."""
    name = word.partition("(")[0].strip().lower()
    if name not in DDL_TYPES:
        raise UnsupportedType(f"unsupported type {word!r}; known: {', '.join(DDL_TYPES)}")
    return DDL_TYPES[name]
