"""Line deduplication by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation, so only sketches are shuffled. Lines whose estimate lies near the threshold get an
exact distinct count; lines on enough sites are boilerplate and leave every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, spread, stage_table, table

#: A line is boilerplate on SITES sites or more, whatever its length; blank lines are left alone.
SITES = 10
#: log2 of a sketch's registers: its standard error is 1.6 %.
SKETCH_BITS = 12
#: Estimates from SITES / MARGIN up to SITES * MARGIN are counted exactly.
MARGIN = 2


def _pair(*cols):
    """Two independently seeded 64-bit hashes."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]


def line_rows(docs: DataFrame) -> DataFrame:
    """(t1, t2, site, pos, l1, l2) of every line that isn't blank; t1 and t2 stand for the text, l1 and l2 for the line."""
    t1, t2 = _pair(F.col("text"))
    rows = docs.select(t1.alias("t1"), t2.alias("t2"), F.coalesce("source", F.lit("\x00")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    l1, l2 = _pair(F.col("line"))
    return rows.select("t1", "t2", "site", "pos", l1.alias("l1"), l2.alias("l2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(l1, l2) of the lines on sites distinct sites or more."""
    spread = lines.groupBy("l1", "l2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = spread.select("l1", "l2", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= sites / MARGIN)
    spread = stage_table(spread, "line-spread")
    sure = spread.where(F.col("n") >= sites * MARGIN).select("l1", "l2")
    near = spread.where(F.col("n") < sites * MARGIN).select("l1", "l2")
    exact = lines.join(near, ["l1", "l2"]).select("l1", "l2", "site").distinct().groupBy("l1", "l2").agg(F.count("*").alias("n"))
    return stage_table(sure.union(exact.where(F.col("n") >= sites).select("l1", "l2")), "boilerplate")


def drop_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with their boilerplate lines removed from text, and n_lines and n_removed.

    docs needs text and source; other columns stay, but columns named n_lines or n_removed are replaced.
    Lines are compared without leading and trailing spaces; blank lines stay; a null source is a site of its own. A null text
    stays null with no lines; an empty text is one empty line. A very long text is one row of as many lines, and
    the positions of its removed lines are one array. Repeated rows give repeated results; an empty table gives no rows.
    """
    lines = stage_table(line_rows(docs), "line-rows")
    bad = boilerplate(lines, sites)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    t1, t2, u1, u2, gone = fresh(docs.columns, "t1", "t2", "u1", "u2", "gone")
    away = lines.join(bad, ["l1", "l2"]).groupBy(F.col("t1").alias(u1), F.col("t2").alias(u2)).agg(F.collect_set("pos").alias(gone))
    away = stage_table(away, "gone-lines")
    names = {c: F.col(f"`{c}`") for c in kept}
    rows = docs.select(*names.values(), *(k.alias(n) for k, n in zip(_pair(F.col("text")), (t1, t2), strict=True)))
    rows = rows.join(away, (F.col(t1) == F.col(u1)) & (F.col(t2) == F.col(u2)), "left")
    split = F.split("text", "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda _, k: ~F.array_contains(gone, k)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return rows.select(*(text.alias(c) if c == "text" else col for c, col in names.items()), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and the digest of what stays: drop_boilerplate()."""
    out = drop_boilerplate(spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, source, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos FROM d WHERE text IS NOT NULL
), b AS (
  SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT coalesce(source, chr(1))) >= {SITES}
), k AS (
  SELECT rid, count(*) FILTER (WHERE b.t IS NOT NULL) AS gone, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.t IS NULL) AS rest
  FROM l LEFT JOIN b ON trim(l.line) = b.t GROUP BY rid
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS text_sha256
FROM d LEFT JOIN k USING (rid)
"""
