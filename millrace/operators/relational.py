"""Relational operators as thin functions on DataFrames.

Each declares what to compute; Catalyst picks the physical operator. STRATEGIES names the
hints for a caller who knows better, for instance that a side stays small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import true_only

#: Join strategies and the physical operator that each asks for.
STRATEGIES = {
    "auto": None,
    "hash": "shuffle_hash",  # one-pass hash join
    "merge": "merge",  # sort-merge join; it spills
    "broadcast": "broadcast",  # index lookup or nested loop on a side that every task holds
    "product": "shuffle_replicate_nl",  # cartesian product without a broadcast side
}
#: Largest side, in bytes of its plan's estimate, that broadcast_if_small hands to every task.
BROADCAST_BYTES = 64 << 20


def project(df: DataFrame, *items: str | Column, **aliases: str | Column) -> DataFrame:
    """Columns, expressions or `t.*`; keywords name expressions."""
    named = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in aliases.items()]
    return df.select(*(F.expr(i) if isinstance(i, str) and not i.endswith("*") else i for i in items), *named)


def select_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is true."""
    return df.where(condition)


def table_alias(df: DataFrame, name: str) -> DataFrame:
    """A table or a subquery in FROM under a name."""
    return df.alias(name)


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs; for sides that are meant to be small."""
    return left.crossJoin(right)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the estimate is within the limit; else the optimiser shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column, how: str = "inner", strategy: str = "auto") -> DataFrame:
    """An equi or theta join. broadcast is checked against BROADCAST_BYTES first."""
    hint = STRATEGIES[strategy]
    if hint == "broadcast":
        right = broadcast_if_small(right)
    elif hint:
        right = right.hint(hint)
    return left.join(right, on, how)


#: Widths of range_join's buckets: width * 2^level; what no level holds is compared with all points.
LEVELS = 40


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, as an equi-join on buckets.

    An interval goes to the buckets of the narrowest level that is at least as wide, so to two at
    most, however wide it is; a point goes to one bucket of each level that occurs. width is
    that of the narrowest level. No pair is found twice. Rows with a null bound or
    point, and empty intervals, match nothing.
    """
    span = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(float(width)))))).cast("int")
    some = intervals.where(F.col(low) < F.col(high)).withColumn("__level", F.coalesce(level, F.lit(LEVELS)))
    # A few numbers.
    used = sorted(r[0] for r in some.select("__level").distinct().collect())
    bucket = lambda c: F.when(F.col("__level") < LEVELS, F.floor(F.col(c).cast("double") / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))))).otherwise(0).cast("long")
    some = some.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(low), bucket(high)))))
    dealt = points.where(F.col(point).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("__bucket", bucket(point))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return dealt.join(some, ["__level", "__bucket"]).where(inside).drop("__level", "__bucket")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, parts: int = 64) -> DataFrame:
    """Each row of left with the row of right of the same key whose time is the latest that isn't after its own; nulls if there is none.

    by is the key's name on both sides, times are numbers; other names must differ. The time of right is cut into parts equal spans: a row
    looks among those of its own span, and otherwise takes the last of the key's earlier spans, of which there are
    parts at most. So a key with a great share of the rows is that many groups. Of rows with
    equal times the greatest counts, by the order of its columns. Rows of left with a null key or time find nothing.
    """
    ends = right.agg(F.min(F.col(right_time).cast("double")).alias("a"), F.max(F.col(right_time).cast("double")).alias("b")).first()
    first, width = ends["a"] or 0.0, max(((ends["b"] or 0.0) - (ends["a"] or 0.0)) / parts, 1e-9)
    part = lambda t: F.least(F.lit(parts - 1), F.greatest(F.lit(-1), F.floor((F.col(t).cast("double") - first) / width))).cast("int")
    named = [c for c in right.columns if c != by]
    row = F.struct(F.col(right_time).cast("double").alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(named)))
    held = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("k"), part(right_time).alias("part"), row.alias("row"))
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    asked = left.select(whole.alias("own"), F.col(by).alias("k"), F.col(left_time).cast("double").alias("t"), part(left_time).alias("part"))
    known = asked.where(F.col("k").isNotNull() & F.col("t").isNotNull())
    none = F.lit(None).cast(held.schema["row"].dataType)
    upto = lambda *keys: Window.partitionBy(*keys[:-2]).orderBy(*keys[-2:], F.col("row")).rowsBetween(Window.unboundedPreceding, 0)
    # What a key has before each span that is asked for: no more than 2 * parts rows a key.
    spans = known.select("k", "part", F.lit(0).alias("side"), none.alias("row")).distinct()
    spans = spans.unionByName(held.groupBy("k", "part").agg(F.max("row").alias("row")).withColumn("side", F.lit(1)))
    earlier = spans.withColumn("before", F.last("row", ignorenulls=True).over(upto("k", "part", "side"))).where("side = 0").select("k", "part", "before")
    both = known.select("k", "part", "t", F.lit(1).alias("side"), none.alias("row"), "own")
    both = both.unionByName(held.select("k", "part", F.col("row.t").alias("t"), F.lit(0).alias("side"), "row", F.lit(None).cast(known.schema["own"].dataType).alias("own")))
    found = both.withColumn("row", F.last("row", ignorenulls=True).over(upto("k", "part", "t", "side"))).where("side = 1").join(earlier, ["k", "part"])
    found = found.select("own", F.coalesce("row", "before").alias("row"))
    found = found.unionByName(asked.where(F.col("k").isNull() | F.col("t").isNull()).select("own", none.alias("row")))
    return found.select("own.*", *(F.col(f"row.c{k}").alias(c) for k, c in enumerate(named)))


def comma_join(tables: Sequence[DataFrame], condition: str | Column | None = None) -> DataFrame:
    """FROM a, b, c WHERE condition: products whose equalities Catalyst turns into joins."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out if condition is None else out.where(condition)


def aggregate(df: DataFrame, keys: Sequence[str | Column], having: str | Column | None = None, **measures: str | Column) -> DataFrame:
    """Grouped aggregates, one row without keys; partial sums are built before the shuffle."""
    cols = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in measures.items()]
    out = df.groupBy(*keys).agg(*cols)
    return out if having is None else out.where(having)


def sort(df: DataFrame, *order: str | Column | tuple[str, str]) -> DataFrame:
    """Order by columns, expressions or (column, 'desc') pairs."""
    return df.orderBy(*(_order(o) for o in order))


def _order(o) -> Column:
    if isinstance(o, tuple):
        return F.col(o[0]).desc() if o[1].lower() == "desc" else F.col(o[0]).asc()
    return F.col(o) if isinstance(o, str) else o


def top(df: DataFrame, n: int, *order: str | Column | tuple[str, str]) -> DataFrame:
    """The first n rows of an order, without a full sort."""
    return sort(df, *order).limit(n)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def union_all(*tables: DataFrame) -> DataFrame:
    """Concatenation by position, under the first table's names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def union(*tables: DataFrame) -> DataFrame:
    return union_all(*tables).distinct()


def insert_overlay(base: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """base and new rows; columns that a row doesn't name are null."""
    new = base.sparkSession.createDataFrame([[r.get(c) for c in base.columns] for r in rows], base.schema)
    return base.unionByName(new)


def delete_overlay(base: DataFrame, *predicates: str | Column) -> DataFrame:
    """base without the rows for which any predicate is true."""
    for p in predicates:
        base = base.where(~true_only(F.expr(p) if isinstance(p, str) else p))
    return base


def lookup(df: DataFrame, key: str, value=None, low=None, high=None) -> DataFrame:
    """A point (value) or range (low < key <= high) lookup; it reaches the scan as a pushed filter."""
    if value is not None:
        return df.where(F.col(key) == F.lit(value))
    out = df if low is None else df.where(F.col(key) > F.lit(low))
    return out if high is None else out.where(F.col(key) <= F.lit(high))
