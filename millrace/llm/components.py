"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_path, work_path


def _starred(spark, path: str) -> tuple[DataFrame, tuple]:
    df = spark.read.schema("u long, v long").parquet(path)
    mark = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return df, tuple(mark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge in edges (a long, b long).

    component is the smallest node of it. Edges are undirected, loops and repeats are allowed,
    edges with a null end are ignored. Each round is written to the shared folder, so lost
    executors repeat one round at most. Minima are pre-aggregated before they are shuffled; the
    joins take the hub's rows on one side only, where Spark splits a skewed partition.
    """
    spark = edges.sparkSession
    path = work_path(spark, "components")
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(f"{path}/0")
    pairs, mark = _starred(spark, f"{path}/0")
    turn = 0
    while True:
        # Large star: what is larger than u, and u's smaller neighbours' minimum, meet at the minimum.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low.write.parquet(f"{path}/low-{turn}")
        low = spark.read.schema("u long, m long").parquet(f"{path}/low-{turn}")
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large.where("u <> v").distinct().write.parquet(f"{path}/large-{turn}")
        large = spark.read.schema("u long, v long").parquet(f"{path}/large-{turn}")
        # Small star: all smaller neighbours of u, and u, meet at their minimum.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        low.write.parquet(f"{path}/least-{turn}")
        low = spark.read.schema("u long, m long").parquet(f"{path}/least-{turn}")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        turn += 1
        small.distinct().write.parquet(f"{path}/{turn}")
        pairs, new = _starred(spark, f"{path}/{turn}")
        if new == mark:
            break
        mark = new
        drop_path(spark, f"{path}/{turn - 1}")
        for kind in ("low", "large", "least"):
            drop_path(spark, f"{path}/{kind}-{turn - 1}")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
