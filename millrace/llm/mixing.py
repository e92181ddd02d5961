"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; within a source, keys
in ascending order are a weighted sample without replacement. A source first gives complete
epochs, then the documents with the smallest keys until the rest of its word budget is filled;
the last of them gives only the words that still fit.

Prefix sums never gather a source in one task: equal rows are one row with a count, rows are dealt
by ranges of source and key, and a document's place is what its source has in earlier ranges and
its place in its own. Sources, too, are numbered range by range, and their targets come from a few sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import fresh, spread, stage_table, table

#: Most that a source gives, as a multiple of its size; weights by the rank of the source.
EPOCHS, WEIGHTS = 3, (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII digits and marks; they and capitals are the characters that good text has few of.
MARKS, CAPITALS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", "[A-Z]+"
BEFORE = (Window.unboundedPreceding, -1)


def quality_weight(text: Column, words: Column) -> Column:
    """Product of five shares: how near the mean word length is to 6, characters that are neither marks nor
    digits, characters that aren't capitals, different words and different lines. From 0.01 to 1; 0.01 without words."""
    chars, lines = F.length(text).cast("double"), F.split(text, "\n")
    mean = chars / F.size(words)
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars
    share = lambda c: F.size(F.array_distinct(c)).cast("double") / F.size(c)
    weight = 1.0 / (1.0 + F.abs(mean - 6.0) / 6.0) * kept(MARKS) * kept(CAPITALS) * share(words) * share(lines)
    return F.when(F.size(words) > 0, F.greatest(F.lit(0.01), weight)).otherwise(0.01)


def narrow_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words, key and number n of each kind of document, and columns named by more that tell them apart, too.

    The key depends on id and text alone, so that reruns agree.
    """
    rows = docs.select(*more, "doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    draw = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.crc32(F.col("text").cast("binary")).cast("string"))
    draw = (F.conv(F.substring(F.md5(draw.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = rows.select(*more, "doc_id", "source", F.size("words").cast("long").alias("size"), (-F.log(draw) / quality_weight(F.col("text"), F.col("words"))).alias("key"))
    return rows.groupBy(*more, "doc_id", "source", "size", "key").agg(F.count("*").alias("n"))


def _dealt(rows: DataFrame, tag: str, *order) -> DataFrame:
    """rows in ranges of an order, and part, the number of the range, as a table."""
    return stage_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), tag)


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size). Adds target: shares by weight of all words, at most EPOCHS times the size.

    A source reaches its limit if its share of what the others leave is more; sources are taken
    out until no other does.
    """
    by_name = F.col("source").asc_nulls_last()
    dealt = _dealt(sizes, "mix-sources", by_name)
    # One row for each range.
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("part_at"))
    turn = (F.col("part_at") + F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1) % len(WEIGHTS)
    w = dealt.join(parts, "part").withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")))
    exact = lambda c: c.cast("decimal(38,0)")
    w = stage_table(w.select("source", "source_size", exact(F.col("source_size") * EPOCHS).alias("most"), exact(F.col("w")).alias("w")), "mix-weights")
    total = w.agg(F.coalesce(exact(F.sum("source_size")), F.lit(0)).alias("left"), F.coalesce(exact(F.sum("w")), F.lit(0)).alias("w_left")).first()
    now, full = total, F.lit(False)
    while True:
        full = F.col("most") * F.lit(int(now["w_left"])).cast("decimal(18,0)") < F.lit(int(now["left"])).cast("decimal(18,0)") * F.col("w")
        gone = w.where(full).agg(F.coalesce(exact(F.sum("most")), F.lit(0)).alias("most"), F.coalesce(exact(F.sum("w")), F.lit(0)).alias("w")).first()
        new = {"left": total["left"] - gone["most"], "w_left": total["w_left"] - gone["w"]}
        if new["w_left"] == now["w_left"]:
            break
        now = new
    share = F.lit(float(now["left"])) * F.col("w").cast("double") / F.lit(float(now["w_left"]))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), share))
    return w.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _taken(docs: DataFrame, *more: str) -> DataFrame:
    """narrow_rows() with source_size, target, epochs, rest (words of the fractional epoch) and prior, the words before a row's first copy."""
    order = ["key", "doc_id", "size", *more]
    rows = _dealt(narrow_rows(docs, *more), "mix-rows", "source", *order)
    each = rows.groupBy("part", "source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(*BEFORE)), F.lit(0))
    each = stage_table(each.withColumn("part_at", earlier), "mix-parts")
    targets = source_targets(each.groupBy("source").agg(F.sum("words").alias("source_size")))
    each = each.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("at"), "of", "part_at", "source_size", "target")
    inside = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("part", "source").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(each, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    return rows.withColumn("prior", F.col("part_at") + F.col("inside"))


def _fitting(copy: Column) -> Column:
    """Words that the fractional epoch takes of a row's copy."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prior") - copy * F.col("size"))).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, words) for each row of docs.

    docs needs doc_id, text and source; other columns are ignored. taken = epochs * size + words, where words is what the
    fractional epoch takes of the document. A null or empty text has size 0 and gives nothing;
    a null source is a source of its own, last in order; equal rows draw one key and follow one another;
    a very long text is one document, of which the budget may cut a part; with no words at all every target is 0; an empty table gives no rows.
    """
    each = _taken(docs).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("words", _fitting(F.col("copy")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("words")).alias("taken"), "epochs", "words")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Copies are whole: the document that the budget cuts is taken if half of it fits. Documents
    without words come with complete epochs only. Rows that are equal in id, source, text and all columns that can be
    hashed are taken as one, with their copies added; rows that differ in one of them are told apart.
    """
    t1, t2, other, of, by, copies, row, copy = fresh(docs.columns, "t1", "t2", "other", "of", "by", "copies", "row", "copy")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name.lower() != "text" and not isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType | T.VariantType)]
    names = {t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(1), F.col("text")), other: F.xxhash64(*plain, *(F.col(f"`{f.name}`").isNull() for f in docs.schema.fields))}
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id").alias(of), F.col("source").alias(by), *(c.alias(n) for n, c in names.items()))
    rows = rows.groupBy(of, by, *names).agg(F.first(row).alias(row))
    taken = _taken(docs.select("doc_id", "source", "text", *(c.alias(n) for n, c in names.items())), *names)
    # Of n copies the first ones are taken whole, the next one if half of it fits.
    left = F.greatest(F.lit(0), F.col("rest") - F.col("prior"))
    whole = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor((left + F.col("size") - F.ceil(F.col("size") / 2)) / F.greatest("size", F.lit(1))))).otherwise(0)
    taken = taken.withColumn(copies, F.col("epochs") * F.col("n") + whole.cast("long")).where(F.col(copies) > 0)
    taken = stage_table(taken.select(F.col("doc_id").alias(f"{of}_"), F.col("source").alias(f"{by}_"), *(F.col(n).alias(f"{n}_") for n in names), copies), "mix-copies")
    same = F.col(of).eqNullSafe(F.col(f"{of}_")) & F.col(by).eqNullSafe(F.col(f"{by}_"))
    for n in names:
        same &= F.col(n) == F.col(f"{n}_")
    return rows.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(f"{row}.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents."""
    return mix(spread(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) x(i)
), e AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS raw
  FROM documents
), d AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS size, length(text)::DOUBLE AS chars,
    length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) / length(text)::DOUBLE AS plain, length(regexp_replace(text, '[A-Z]+', '', 'g')) / length(text)::DOUBLE AS low,
    len(list_distinct(words))::DOUBLE / len(words) AS own_words, len(list_distinct(lines))::DOUBLE / len(lines) AS own_lines,
    xor(list_reduce(list_prepend(4294967295, raw), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc
  FROM e, crc
), g AS (
  SELECT *, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc AS BIGINT)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    CASE WHEN size > 0 THEN greatest(0.01::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + abs(chars / size - 6.0::DOUBLE) / 6.0::DOUBLE) * plain * low * own_words * own_lines) ELSE 0.01::DOUBLE END AS weight
  FROM d
), k AS (
  SELECT *, -ln(u) / weight AS key FROM g
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS most FROM s
), c AS (
  SELECT *, most / w AS ratio,
    CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_rest
  FROM w WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (
  SELECT rest, w_rest FROM c WHERE most * w_rest > rest * w ORDER BY ratio, rest, w_rest LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(most, (SELECT rest FROM u) * w / (SELECT w_rest FROM u)), 0) AS target FROM c
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - prior)) AS BIGINT) AS taken
FROM p
"""
