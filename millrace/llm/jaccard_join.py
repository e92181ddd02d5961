"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked if their Jaccard similarity is 0.8
or more. MinHash values find candidates: BANDS bands of ROWS values, where a pair at exactly 0.8
is missed with probability (1 - 0.8^ROWS)^BANDS = 9e-8, and more similar pairs more rarely.

Candidates' MinHash values are compared step by step, and a pair is dropped as soon as the
posterior probability of reaching the threshold (uniform prior) falls below TOLERANCE. This
happens twice. Within the buckets of each band, single bytes of the values tell which texts hang
together; what loosely similar texts share is cut here, so that clusters grow along pairs that may
well reach the threshold, not along band collisions. Within a cluster the whole values are
compared, and what remains is verified on the exact shingle sets (64-bit hashes).

Pairs are never emitted: buckets and clusters are cut into blocks, each pair of blocks is one
bounded unit of work, and it returns link counts and a spanning forest of its links. A node is a
text, whatever the ids of its rows; copies are one node and are never expanded.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, ranges, spread, stage_table, table, trimmed, words_of
from millrace.llm.components import components

SHINGLE, THRESHOLD = 5, (4, 5)
BANDS, ROWS = 41, 5
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
#: Texts of a block of a bucket, of a cluster's block, and of one in a cluster of more than MANY blocks.
NEAR_BLOCK, BLOCK, MOST, MANY = 512, 128, 2048, 32
#: Shingles of a text that are hashed at once.
PIECE = 100_000
#: Cells of the largest incidence matrix; beyond, sets are intersected pair by pair.
CELLS = 8_000_000
#: Pairs that are compared at once.
PAIRS = 1 << 18

_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = _RNG.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, HASHES, np.uint64)
_BAND = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _UNBASE)]
    return _POWERS


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; one of all words if it has fewer than size.

    A hash doesn't depend on the shingle's place, so long texts are hashed in pieces of PIECE shingles.
    """
    words = words_of(text)
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate([_spans(words[k : k + PIECE + n - 1], n) for k in range(0, len(words) - n + 1, PIECE)]))


def _spans(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of all runs of n words, from one prefix sum of byte values times powers of an odd base."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: len(words) - n + 1], ends[n - 1 :]
    return _mix((total[b] - total[a]) * inverse[a] ^ (b - a).astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 512):
        got = (_A[:, None] * hashes[None, k : k + 512] + _B[:, None]).min(axis=1) >> np.uint64(32)
        out = np.minimum(out, got.astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = (_BAND * (sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64)
    return _mix(x + np.arange(BANDS, dtype=np.uint64) * _BASE).view(np.int64)


SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("bytes", pa.binary())])


def _sketch(batches):
    for batch in batches:
        keys, bands, low = [], [], []
        for text in batch.column(1):
            text = text.as_py()
            got = shingles(text)
            sig = signature(got)
            keys.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest())
            bands.append(band_keys(sig) if len(got) else [])
            low.append(sig.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], schema=SKETCH)


MEMBERS = pa.schema([("cluster", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("hashes", pa.binary())])


def _members(batches):
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.columns[-1]]
        made = [pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema=MEMBERS)


def least_matches(n: int, tolerance: float = TOLERANCE, by_chance: float = 0.0) -> int:
    """Fewest equal values among n for which a pair stays; by_chance: how often unequal values look equal.

    With a uniform prior on the share of equal values, the posterior of t or more after m equal
    values of n is P(Binomial(n + 1, t) <= m).
    """
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    t += (1 - t) * by_chance
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = [least_matches(BLOCK_OF * ROWS) for BLOCK_OF in range(BANDS + 1)]
#: The same for single bytes after so many of them.
STEPS = (25, 60, 120, HASHES)
_LEAST_BYTES = [least_matches(n, by_chance=1 / 256) for n in STEPS]


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that comparing MinHash values band by band does not rule out."""
    equal = np.zeros(len(a), np.int32)
    step = 4
    for k in range(0, BANDS, step):
        at = slice(k * ROWS, (k + step) * ROWS)
        equal += (sig[a, at] == sig[b, at]).sum(axis=1, dtype=np.int32)
        keep = equal >= _LEAST[min(k + step, BANDS)]
        a, b, equal = a[keep], b[keep], equal[keep]
    return a, b


def likely(low: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of paired rows of bytes of MinHash values comparing them step by step does not rule out."""
    at, equal, done = np.arange(max(len(low), len(other))), 0, 0
    low, other = np.broadcast_arrays(low, other)
    for n, least in zip(STEPS, _LEAST_BYTES, strict=True):
        equal = equal + (low[at, done:n] == other[at, done:n]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        at, equal, done = at[keep], equal[keep], n
    return at


def hanging(low: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (row, row) of the likely pairs of a unit's rows; what already hangs together isn't compared."""
    apart, forest = np.arange(len(low)), []
    while len(apart) > 1:
        front, apart = [int(apart[0])], apart[1:]
        while front and len(apart):
            x = front.pop()
            at = likely(low[x : x + 1], low[apart])
            found = apart[at].tolist()
            forest += [(x, y) for y in found]
            front += found
            apart = np.delete(apart, at)
    return forest


NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near(batches):
    """Consumes rows (band, low, high, node, bytes) sorted by the first three; holds one batch and one pair of blocks."""
    rest = None

    def forest(node, low, cuts):
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        good = two[likely(low[two], low[two + 1])] if len(two) else two
        edges = [(node[good], node[good + 1])]
        for at, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := hanging(low[at : at + n]):
                x, y = np.array(found).T + at
                edges.append((node[x], node[y]))
        a, b = (np.concatenate(c) for c in zip(*edges, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=NEAR)

    for batch in batches:
        key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        node = batch.column(3).to_numpy()
        low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, HASHES)
        if rest is not None:
            key, node, low = (np.concatenate(c) for c in zip(rest, (key, node, low), strict=True))
        cuts = np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1))])
        last = cuts[-1]
        rest = key[last:], node[last:], low[last:]
        if last:
            yield forest(node[:last], low[:last], cuts)
    if rest is not None:
        yield forest(rest[1], rest[2], np.array([0, len(rest[1])]))


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair's exact similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    universe = np.unique(np.concatenate(sets))
    if len(a) > 2 * len(sets) and len(sets) * len(universe) <= CELLS:
        there = np.zeros((len(sets), len(universe)), np.float32)
        for k, s in enumerate(sets):
            there[k, np.searchsorted(universe, s)] = 1
        common = np.rint(there @ there.T)[a, b].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    return THRESHOLD[1] * common >= THRESHOLD[0] * (size[a] + size[b] - common)


def links_within(nodes: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], low: int, high: int):
    """(node, links) and forest edges (node, node) of one pair of blocks."""
    n, size = len(nodes), np.array([len(s) for s in sets])
    order = np.argsort(block != low, kind="stable")
    cut = int((block == low).sum())
    # Row k is paired with all rows behind it in its block, or with all of the other block.
    first = np.arange(1, n + 1) if low == high else np.full(cut, cut)
    per, count, a_all, b_all, begin = n - first, np.zeros(n, np.int64), [], [], 0
    while begin < len(per):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(per[begin:]), PAIRS)) + begin)
        a, b = np.repeat(np.arange(begin, min(end, len(per))), per[begin:end]), ranges(first[begin:end], per[begin:end])
        a, b, begin = order[a], order[b], end
        close = THRESHOLD[1] * np.minimum(size[a], size[b]) >= THRESHOLD[0] * np.maximum(size[a], size[b])
        a, b = surviving(sig, a[close], b[close])
        if len(a):
            good = verified(sets, a, b)
            a_all.append(a[good]), b_all.append(b[good])
            count += np.bincount(a[good], minlength=n) + np.bincount(b[good], minlength=n)
    forest = spanning(n, np.concatenate(a_all), np.concatenate(b_all)) if a_all else []
    return [(int(nodes[k]), int(c)) for k, c in enumerate(count) if c], [(int(nodes[x]), int(nodes[y])) for x, y in forest]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join each of n nodes to the least of its component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return [(int(k), int(c)) for k, c in enumerate(label) if k != c]
        label = new


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _pairs(batches):
    """Consumes rows sorted by (cluster, low, high); holds one pair of blocks at a time."""
    key, rows, out = None, [], []

    def close():
        if len(rows) > 1:
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            sig = np.stack([np.frombuffer(r[2], np.uint32) for r in rows])
            counts, forest = links_within(np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), sig, sets, key[1], key[2])
            out.extend((n, None, c) for n, c in counts)
            out.extend((a, b, None) for a, b in forest)
        rows.clear()

    def made():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=FOUND)
        out.clear()

    for batch in batches:
        cluster, low, high = (batch.column(k).to_pylist() for k in range(3))
        rest = [batch.column(k).to_pylist() for k in range(3, 7)]
        for at, row in zip(zip(cluster, low, high, strict=True), zip(*rest, strict=True), strict=True):
            if at != key:
                close()
                key = at
            rows.append(row)
        if len(out) > 10_000:
            yield from made()
    close()
    if out:
        yield from made()


def _cut(n, block: int, most: int | None = None, many: int = 0):
    """Number of blocks of n texts: of block texts each, or of up to most where that makes more than many."""
    blocks = F.ceil(n / block)
    return blocks if most is None else F.least(blocks, F.greatest(F.lit(many).cast("long"), F.ceil(n / most)))


def _units(placed: DataFrame, group: str, *more: str) -> DataFrame:
    """One row for each pair of blocks that a row of placed (group, blocks, block, node) belongs to, with the rows of a pair together.

    A group's pairs of blocks are numbered and dealt one after the other, so that a large group is as many rows in every task.
    """
    spark = placed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select(group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "blocks", *more)
    number = F.expr(f"xxhash64({group}) % {n} + (low * blocks - low * (low - 1) div 2 + high - low) % {n}")
    return units.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions(group, "low", "high").drop("blocks")


def _text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows (doc_id, text_key), and of the texts (text_key, low_id, n_copies, n_links, class_id, lead)."""
    sketch = stage_table(docs.select("doc_id", "text").mapInArrow(trimmed(_sketch), "doc_id long, text_key binary, bands array<long>, bytes binary"), "sketches")
    texts = sketch.groupBy("text_key").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    # Written once, so that a text's number is fixed.
    texts = stage_table(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    keys = texts.select("node", F.explode("bands").alias("band"))
    shared = stage_table(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", _cut(F.col("n"), NEAR_BLOCK).alias("blocks")), "buckets")
    spot = F.expr("pmod(xxhash64(node), blocks)")
    near = keys.join(shared, "band").join(texts.select("node", "bytes"), "node").withColumn("block", spot)
    near = _units(near, "band", "node", "bytes").mapInArrow(trimmed(_near), "a long, b long")
    clusters = stage_table(components(near), "clusters")
    sizes = stage_table(clusters.groupBy("component").agg(F.count("*").alias("n")).select("component", _cut(F.col("n"), BLOCK, MOST, MANY).alias("blocks")), "cluster-sizes")
    placed = clusters.join(sizes, "component").join(texts.select("node", "text_key"), "node").select(F.col("component").alias("cluster"), "blocks", spot.alias("block"), "node", "text_key")
    # Copies go before they are shuffled.
    whole = docs.select(_text_key().alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))
    members = placed.join(whole, "text_key").select("cluster", "blocks", "block", "node", "text").mapInArrow(trimmed(_members), "cluster long, blocks long, block long, node long, sig binary, hashes binary")
    found = _units(members, "cluster", "block", "node", "sig", "hashes").mapInArrow(trimmed(_pairs), "a long, b long, links long")
    found = stage_table(found, "links")
    counts = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(found.where("links IS NULL").select("a", "b")).withColumnRenamed("component", "lead")
    named = texts.select("text_key", "node", "low_id", "n_copies").join(counts, "node", "left").join(classes, "node", "left")
    named = stage_table(named.withColumn("lead", F.coalesce("lead", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), "text-links")
    least = named.groupBy("lead").agg(F.min("low_id").alias("class_id"))
    return sketch.select("doc_id", "text_key"), stage_table(named.join(least, "lead").drop("node"), "text-classes")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, text_id, n_copies) for each row of docs.

    docs needs doc_id and text; other columns are ignored. Texts are compared, whatever ids their rows have:
    class_id is the smallest id of the link component, n_links the number of different texts linked
    to the row's text, text_id the smallest id of rows with the same text, n_copies their number; ids of
    null are passed over, and where there is no other the id is null. Null and empty texts are one
    text without links, as is each text without words; a text of fewer than five words is one
    shingle. A very long text is hashed in pieces and is one set. Empty tables give no rows.
    """
    rows, texts = _classified(docs)
    return rows.join(texts, "text_key").select("doc_id", "class_id", "n_links", F.col("low_id").alias("text_id"), "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, all its columns.

    It is the row with the smallest id (null after all others), then that of the text with the smallest MD5, then
    that with the smallest hash of its plain columns.
    """
    rows, texts = _classified(docs)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    chosen = rows.join(texts.select("text_key", "lead"), "text_key").groupBy("lead").agg(F.min(first).alias("r")).select("r.doc_id", "r.text_key")
    of, key, order, row = fresh(docs.columns, "of", "key", "order", "row")
    chosen = stage_table(chosen.select(F.col("doc_id").alias(of), F.col("text_key").alias(key)), "kept-rows")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType | T.VariantType)]
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.coalesce(F.xxhash64(*plain), F.lit(0)).alias(order), _text_key().alias(key), F.col("doc_id").alias(of))
    kept = named.join(chosen.withColumnsRenamed({of: f"{of}_", key: f"{key}_"}), (F.col(key) == F.col(f"{key}_")) & F.col(of).eqNullSafe(F.col(f"{of}_")), "left_semi")
    return kept.groupBy(key, of).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_classes() of all documents."""
    return jaccard_classes(spread(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS node, text, low_id, n_copies FROM (SELECT coalesce(text, '') AS text, min(doc_id) AS low_id, count(*) AS n_copies FROM documents GROUP BY 1)
), w AS (
  SELECT node, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), p AS (
  SELECT node, w, least(5, len(w)) AS n, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS p FROM w WHERE len(w) > 0
), s AS (
  SELECT DISTINCT node, array_to_string(list_slice(w, p, p + n - 1), ' ') AS shingle FROM p
), c AS (
  SELECT node, count(*) AS n FROM s GROUP BY node
), common AS (
  SELECT x.node AS a, y.node AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.node <> y.node GROUP BY 1, 2
), l AS (
  SELECT a, b FROM common JOIN c ca ON a = ca.node JOIN c cb ON b = cb.node WHERE 5 * common.n >= 4 * (ca.n + cb.n - common.n)
), r AS (
  SELECT node, node AS label FROM t UNION SELECT l.b, r.label FROM r JOIN l ON r.node = l.a WHERE r.label < l.b
), k AS (
  SELECT node, min(label) AS lead FROM r GROUP BY node
), m AS (
  SELECT lead, min(low_id) AS class_id FROM k JOIN t USING (node) GROUP BY lead
), n AS (
  SELECT a AS node, count(*) AS n_links FROM l GROUP BY a
)
SELECT d.doc_id, m.class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, t.low_id AS text_id, CAST(t.n_copies AS BIGINT) AS n_copies
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN k ON k.node = t.node JOIN m ON m.lead = k.lead LEFT JOIN n ON n.node = t.node
"""
