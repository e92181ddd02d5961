"""Sharding by Hilbert-curve ordering.

Source, language, size and id are quantised to 2^BITS equal-depth bins each, cut at exact ranks of
their values; rows are ordered by the Hilbert index of their cell and cut into runs of equal row
counts, so that every shard covers a compact box of the four dimensions and a reader can skip
shards by min/max. write_shards() and read_shards() do so.

A global order is never sorted in one place. Equal rows are one row with a count. Values are
counted, dealt by ranges and added up range by range; rows are counted by cell, large cells are
cut into pieces by a hash of the row, and a row's rank is its cell's offset, its piece's offset
and its place in the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh, spread, stage_table, table, with_sums_before

DIMS, BITS = 4, 3
SHARDS = 24
#: Pieces that the rows are cut into, and the least rows of one.
PIECES, LEAST = 4096, 64


def hilbert_table(dims: int = DIMS, bits: int = BITS) -> list[tuple[int, int]]:
    """(cell, index) of every cell; a cell packs the coordinates, first dimension highest.

    Skilling's transform ("Programming the Hilbert curve", 2004): undo the excess work from
    the highest bit down, then Gray-encode, then interleave the bits.
    """
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        q = 1 << bits - 1
        while q > 1:
            low = q - 1
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= low
                else:
                    t = (x[0] ^ x[d]) & low
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << bits - 1
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | v >> b & 1
        out.append((cell, index))
    return out


def _row_columns(text: str = "text") -> dict[str, Column]:
    """What a row is ordered by, beside doc_id: source, lang, size and text_crc32."""
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
        "text_crc32": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long"),
    }


def _mix() -> Column:
    """32 bits that order the rows of a cell."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"), F.lit(":"), F.col("text_crc32").cast("string"))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("long")


#: Each dimension as a string or a number; the other is null.
VALUES = (("source", None), ("lang", None), (None, "size"), (None, "doc_id"))


def equal_depth_cuts(rows: DataFrame, total: int) -> list[list[tuple[int, object]]]:
    """For each dimension (bin, smallest value of the bin) of its bins above 0, for rows with a count n.

    A value's bin follows from the number of rows with smaller values; nulls are the smallest. At most 2^BITS - 1 cuts a dimension.
    """
    each = F.array(*(F.struct(F.lit(k).alias("dim"), (F.col(s) if s else F.lit(None).cast("string")).alias("s"), (F.col(v) if v else F.lit(None)).cast("long").alias("v")) for k, (s, v) in enumerate(VALUES)))
    seen = rows.select(F.explode(each).alias("x"), "n").groupBy("x.dim", "x.s", "x.v").agg(F.sum("n").alias("n"))
    placed = with_sums_before(seen, "shard-values", "n", "dim", "s", "v")
    bins = placed.withColumn("bin", F.expr(f"int(({1 << BITS} * (before - dim * {total})) div {max(total, 1)})"))
    cuts = bins.groupBy("dim", "bin").agg(F.min(F.struct("s", "v")).alias("at")).where("bin > 0").collect()
    return [sorted((r["bin"], r["at"]["s"] if s else r["at"]["v"]) for r in cuts if r["dim"] == k) for k, (s, _) in enumerate(VALUES)]


def _cell(cuts: list[list[tuple[int, object]]]) -> Column:
    cell = F.lit(0)
    for (s, v), own in zip(VALUES, cuts, strict=True):
        place = F.lit(0)
        for b, at in own:
            place = F.when(F.col(s or v) >= F.lit(at), b).otherwise(place)
        cell = cell * (1 << BITS) + place
    return cell.cast("int")


def _placed(rows: DataFrame, cuts: list[list[tuple[int, object]]]) -> DataFrame:
    curve = rows.sparkSession.createDataFrame(hilbert_table(), "cell int, hilbert int")  # 2^(DIMS * BITS) rows, always
    return rows.withColumn("cell", _cell(cuts)).join(F.broadcast(curve), "cell").drop("cell")


def _counted(docs: DataFrame) -> tuple[DataFrame, int]:
    """Different rows (doc_id, source, lang, size, text_crc32, mix, n), and the number of all rows."""
    rows = docs.select("doc_id", *(c.alias(n) for n, c in _row_columns().items())).groupBy("doc_id", "source", "lang", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = stage_table(rows.withColumn("mix", _mix()), "shard-rows")
    return rows, rows.agg(F.sum("n")).first()[0] or 0


def hilbert_order(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, hilbert, rank, shard, slot) of every row of docs.

    docs needs doc_id, text, lang and source; other columns are ignored. size is the text's
    UTF-8 bytes plus 8 (null: 8; its crc32 is 0), however long it is. Nulls of source and language come first, as
    does a null id. Equal rows share one defined order up to their exchange. Shards' counts differ by one at most;
    an empty table gives no rows.
    """
    rows, total = _counted(docs)
    placed = stage_table(_placed(rows, equal_depth_cuts(rows, total)), "shard-places")
    return cut_runs(placed, total, shards)


def _ranked(placed: DataFrame, total: int) -> DataFrame:
    """placed with rank, the number of rows before each row's first copy in the order (hilbert, mix, doc_id, text_crc32, size, source, lang), and per_piece."""
    per_piece = max(LEAST, -(-total // PIECES))
    upto = (Window.unboundedPreceding, -1)
    # One row for each cell of the curve: a bounded window and a bounded broadcast.
    cells = placed.groupBy("hilbert").agg(F.sum("n").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("hilbert").rowsBetween(*upto)), F.lit(0))
    cells = cells.select("hilbert", offset.alias("cell_at"), F.ceil(F.col("n") / per_piece).cast("long").alias("pieces"))
    placed = placed.join(F.broadcast(cells), "hilbert").withColumn("piece", F.expr("shiftright(mix * pieces, 32)"))
    sizes = placed.groupBy("hilbert", "piece").agg(F.sum("n").alias("n"))
    piece_at = F.coalesce(F.sum("n").over(Window.partitionBy("hilbert").orderBy("piece").rowsBetween(*upto)), F.lit(0))
    sizes = sizes.select("hilbert", "piece", piece_at.alias("piece_at"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("hilbert", "piece").orderBy("mix", "doc_id", "text_crc32", "size", "source", "lang").rowsBetween(*upto)), F.lit(0))
    ranked = placed.withColumn("inside", inside).join(sizes, ["hilbert", "piece"])
    return ranked.withColumn("rank", F.col("cell_at") + F.col("piece_at") + F.col("inside")).withColumn("per_piece", F.lit(per_piece))


def cut_runs(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Exact ranks, then equal runs; many copies of a row are dealt out before they are told apart."""
    some = _ranked(placed, total).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("per_piece").cast("long"))))
    some = some.withColumn("copies", F.least(F.col("per_piece").cast("long"), F.col("n") - F.col("first"))).repartition("hilbert", "piece", "first")
    each = some.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("rank", F.col("rank") + F.col("first") + F.col("copy"))
    return each.select(
        "doc_id", "source", "lang", "size", "text_crc32", "hilbert", "rank",
        F.expr(f"rank * {shards} div {max(total, 1)}").cast("int").alias("shard"),
        F.expr(f"rank - (((rank * {shards} div {max(total, 1)}) * {total} + {shards - 1}) div {shards})").cast("long").alias("slot"),
    )


KEY = ("hilbert", "mix", "doc_id", "text_crc32", "size", "source", "lang")
DIMENSIONS = ("source", "lang", "size", "doc_id")


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, files: int = 1) -> None:
    """Write docs, all columns, as Parquet below the folder out, by shard, and each file's least and greatest values of the dimensions.

    Rows that are equal in all that orders them stay in one shard, so that counts may differ by those
    rows; a shard is cut into files further runs of the curve. The folder ranges has a row for each run.
    """
    rows, total = _counted(docs)
    cuts = equal_depth_cuts(rows, total)
    placed = stage_table(_placed(rows, cuts), "shard-places")
    runs = shards * files
    run = F.expr(f"rank * {runs} div {max(total, 1)}")
    # One row for each run.
    firsts = _ranked(placed, total).groupBy(run.alias("run")).agg(F.min(F.struct(*KEY)).alias("at")).orderBy("run").collect()
    names = dict(zip(("source", "lang", "size", "text_crc32", "mix", "hilbert", "run"), fresh(docs.columns, "source_", "lang_", "size_", "text_crc32_", "mix_", "hilbert_", "run_"), strict=True))
    keys = docs.select("doc_id", *(c.alias(n) for n, c in _row_columns().items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keys = _placed(keys.withColumn("mix", _mix()), cuts)
    of = F.lit(firsts[0]["run"] if firsts else 0)
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    for r in firsts[1:]:
        at = F.struct(*(F.lit(r["at"][k]).cast(kinds[k]).alias(k) for k in KEY))
        of = F.when(F.struct(*KEY) >= at, F.lit(r["run"])).otherwise(of)
    keys = keys.withColumn("run", of.cast("long")).withColumn("shard", F.expr(f"run div {files}"))
    made = keys.select("row.*", F.col("shard").alias("hilbert_shard"), F.col("run").alias("hilbert_run"), F.col("hilbert").alias(names["hilbert"]))
    made = made.repartition("hilbert_run").sortWithinPartitions("hilbert_run", names["hilbert"]).drop(names["hilbert"])
    made.write.partitionBy("hilbert_shard", "hilbert_run").parquet(f"{out}/rows")
    spans = keys.groupBy("shard", "run").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in DIMENSIONS for k, f in (("least", F.min), ("most", F.max))), *(F.max(F.col(c).isNull()).alias(f"null_{c}") for c in DIMENSIONS))
    spans.coalesce(1).write.parquet(f"{out}/ranges")


def read_shards(spark: SparkSession, out: str, **wanted: tuple) -> DataFrame:
    """The rows of write_shards() whose dimensions lie in wanted, e.g. size=(100, 200); runs that can't hold any are not read.

    Bounds are inclusive, None leaves an end open; rows that are null in a wanted dimension are left out. size is that of the text.
    """
    ranges, rows = spark.read.parquet(f"{out}/ranges"), spark.read.parquet(f"{out}/rows")
    some, row = F.lit(True), F.lit(True)
    for name, (low, high) in wanted.items():
        value = _row_columns()["size"] if name == "size" else F.col(name)
        row &= value.isNotNull()
        for end, test, kept in ((low, value.__ge__, "most"), (high, value.__le__, "least")):
            if end is not None:
                row &= test(F.lit(end))
                some &= F.col(f"{kept}_{name}") >= F.lit(end) if kept == "most" else F.col(f"{kept}_{name}") <= F.lit(end)
    runs = [r["run"] for r in ranges.where(some).select("run").collect()]
    return rows.where(F.col("hilbert_run").isin(runs)).where(row).drop("hilbert_shard", "hilbert_run")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hilbert_order() of all documents in SHARDS shards."""
    return hilbert_order(spread(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


_LOOKUP = ", ".join(str(h) for _, h in hilbert_table())
ORACLE = rf"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) x(i)
), d AS (
  SELECT doc_id, source, lang, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS raw
  FROM documents
), e AS (
  SELECT d.* EXCLUDE (raw), CAST(xor(list_reduce(list_prepend(4294967295, raw), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc
), f AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), 1, 8) AS BIGINT) AS mix, count(*) OVER () AS total FROM e
), g AS (
  SELECT *, (rank() OVER (ORDER BY source NULLS FIRST) - 1) * {1 << BITS} // total AS b0, (rank() OVER (ORDER BY lang NULLS FIRST) - 1) * {1 << BITS} // total AS b1,
    (rank() OVER (ORDER BY size) - 1) * {1 << BITS} // total AS b2, (rank() OVER (ORDER BY doc_id NULLS FIRST) - 1) * {1 << BITS} // total AS b3 FROM f
), h AS (
  SELECT *, [{_LOOKUP}][((b0 * {1 << BITS} + b1) * {1 << BITS} + b2) * {1 << BITS} + b3 + 1] AS hilbert FROM g
), r AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS place FROM h
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INTEGER) AS shard,
  CAST(place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS INTEGER) AS hilbert
FROM r
"""
