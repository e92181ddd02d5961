"""Approximate nearest neighbours with learned partitions.

A bounded sample gives an exact neighbour graph, which recursive bisection (spectral order,
cut at the median, improved by swaps) cuts into equal parts with few edges between them, the more
the more rows there are. A small network learns, from the vectors alone, where a vector's
neighbours lie. Every row goes to its most probable part; a query visits its most probable parts
until their probabilities add up to what held-out rows of the sample need for TARGET recall, and
candidates are reranked by exact distance in double precision.

Parts are cut into cells of bounded size by a hash of the id, so that a crowded part, or one
vector repeated many times, is spread over tasks. A vector moves once, to its cell; a query moves
to the cells of the parts that it visits, where queries stream past the cell's vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stage_table, table

SAMPLE, GRAPH_K, TARGET = 4096, 10, 0.93
#: Rows of a part, until there are 2^MOST_LEVELS parts, and vectors of the sample in each.
PART_ROWS, MOST_LEVELS, PART_SAMPLE = 100, 9, 8
HIDDEN, EPOCHS, SEED = 96, 60, 11
#: Rows of a cell, at least and at most; in between, twice those of an average part.
LEAST_CELL, MOST_CELL = 1024, 65_536


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that take part, with the number of components that most rows have, and their number."""
    good = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("v") == (sizes["d"] if sizes else 0)), sizes["n"] if sizes else 0


def levels_for(rows: int, sample: int) -> int:
    """Cuts that leave parts of about PART_ROWS rows, as far as the sample goes."""
    return max(0, min(MOST_LEVELS, int(np.log2(max(1, rows // PART_ROWS))), int(np.log2(max(1, sample // PART_SAMPLE)))))


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    k, square, out = min(k, len(x) - 1), (x * x).sum(axis=1), []
    for a in range(0, len(x), 512):
        d = square[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, max(k - 1, 0), axis=1)[:, :k])
    return np.vstack(out)


def _halves(a: np.ndarray, rng) -> np.ndarray:
    """Balanced bisection of a weighted graph: which half each node goes to."""
    n = len(a)
    degree = a.sum(axis=1) + 1e-9
    root = np.sqrt(degree)
    v = rng.normal(size=n).astype(np.float32)
    for _ in range(60):
        v -= root * (root @ v) / (root @ root)
        v = 0.5 * (v + (a @ (v / root)) / root)
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        to = a @ side
        gain = np.where(side, degree - 2 * to, 2 * to - degree)
        left, right = np.nonzero(~side)[0], np.nonzero(side)[0]
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        good = gain[left[:m]] + gain[right[:m]] - 2 * a[left[:m], right[:m]] > 0
        if not good.any():
            break
        side[left[:m][good]], side[right[:m][good]] = True, False
    return side


def balanced_parts(near: np.ndarray, levels: int) -> np.ndarray:
    n, rng = len(near), np.random.default_rng(SEED)
    a = np.zeros((n, n), np.float32)
    a[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    a += a.T
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            at = np.nonzero(part == p)[0]
            if len(at) > 1:
                new[at[_halves(a[np.ix_(at, at)], rng)]] += 1
        part = new
    return part


def train_router(x: np.ndarray, goal: np.ndarray) -> list[np.ndarray]:
    """Weights of a one-layer network with the soft labels goal, by Adam on cross-entropy."""
    rng = np.random.default_rng(SEED)
    w = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, goal.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(goal.shape[1])]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a : a + 256]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            d = (_softmax(h @ w[2] + w[3]) - goal[at]) / len(at)
            dh = d @ w[2].T * (h > 0)
            step += 1
            for k, g in enumerate((x[at].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["weights"]
    return _softmax(np.maximum((x - model["mean"]) / model["scale"] @ w[0] + w[1], 0) @ w[2] + w[3])


def learn(x: np.ndarray, rows: int) -> dict:
    """Router and the probability that a query's parts must hold, from a sample of vectors of so many rows."""
    x = np.unique(x, axis=0)
    levels = levels_for(rows, len(x))
    parts = 1 << levels
    model = {"mean": x.mean(axis=0), "scale": x.std() + 1e-12, "parts": parts, "mass": 1.0}
    if not levels:
        return model | {"weights": [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]}
    rng = np.random.default_rng(SEED)
    x = x[rng.permutation(len(x))]
    near = neighbour_graph(x)
    part = balanced_parts(near, levels)
    goal = np.eye(parts)[part]
    goal = 0.3 * goal + 0.7 * goal[near].mean(axis=1)
    z = (x - model["mean"]) / model["scale"]
    # What a query must visit comes from rows that the router has not seen.
    held = np.arange(len(x)) % 5 == 0
    model["weights"] = train_router(z[~held], goal[~held])
    p = probabilities(model, x)
    order, before = _visits(p[held])
    place = np.argsort(order, axis=1)
    need = np.take_along_axis(before, np.take_along_axis(place, p.argmax(axis=1)[near[held]], axis=1), axis=1)
    return model | {"mass": float(np.quantile(need, TARGET, method="higher"))}


def _visits(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts by falling probability, and the probability of all that come before each."""
    order = np.argsort(-p, axis=1, kind="stable")
    own = np.take_along_axis(p, order, axis=1)
    return order, np.cumsum(own, axis=1) - own


def _route(shared):
    """Adds each row's part, and the parts that it visits if it asks."""

    def run(batches):
        model = shared.value
        for batch in batches:
            if len(batch):
                p, asks = probabilities(model, _matrix(batch.column(1))), batch.column(2).to_numpy(zero_copy_only=False)
                parts: list = [None] * len(batch)
                at = np.flatnonzero(asks)
                for k, order, before in zip(at.tolist(), *_visits(p[at]), strict=True):
                    parts[k] = order[before <= model["mass"]]
                made = [pa.array(p.argmax(axis=1), pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["vec_id", "v", "asks", "part", "parts"])

    return run


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


#: Candidates that a task holds before it sends on what is left of them.
HELD = 1 << 18


def best(row: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, named: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """(row, query_id, vec_id, score) of the k nearest of the vectors x (their rows and ids) for each query vector y, by exact distance; not its own row."""
    none, square = np.zeros(0, np.int64), (x * x).sum(axis=1)
    found = [(none, none, none, np.zeros(0))]
    for a in range(0, len(y), 64):
        rough = square[None, :] - 2 * y[a : a + 64] @ x.T + (y[a : a + 64] ** 2).sum(axis=1)[:, None]
        rough[own[a : a + 64, None] == row[None, :]] = np.inf
        # What rounding could bring among the k best is measured exactly.
        limit = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        for q, r, m in zip(range(a, a + 64), rough, limit, strict=False):
            at = np.nonzero((r <= m + 1e-9 * (1 + abs(m))) & np.isfinite(r))[0] if np.isfinite(m) else np.nonzero(np.isfinite(r))[0]
            d = np.sqrt(((x[at] - y[q]) ** 2).sum(axis=1))
            top = np.lexsort((ids[at], d))[:k]
            found.append((np.full(len(top), own[q]), np.full(len(top), named[q]), ids[at][top], d[top]))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def nearest_of(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The k nearest of each row among candidates (row, query_id, vec_id, score)."""
    row, named, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, score, row))
    first = np.searchsorted(row[order], row[order])
    order = order[np.arange(len(order)) - first < k]
    return [row[order], named[order], ids[order], score[order]]


def _search(k: int):
    """Consumes rows (part, cell, query, row, vec_id, v) sorted by the first three.

    Holds one cell's vectors, one batch, and HELD candidates: a query's from the cells of a task are merged.
    """

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=FOUND)

    def run(batches):
        key, rows, cell, found = None, [], None, []
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cuts = np.concatenate([[0], 1 + np.flatnonzero((at[1:] != at[:-1]).any(axis=1)), [len(at)]])
            row, ids, v = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if low == high:
                    continue
                part, number, query = at[low].tolist()
                if key != (part, number):
                    key, rows, cell = (part, number), [], None
                if not query:
                    rows.append((row[low:high].copy(), ids[low:high].copy(), v[low:high].copy()))
                    continue
                cell = cell or ([np.concatenate(c) for c in zip(*rows, strict=True)] if rows else None)
                if cell:
                    found.append(best(*cell, row[low:high], ids[low:high], v[low:high], k))
                if sum(len(f[0]) for f in found) > HELD:
                    found = [nearest_of(found, k)]
                    if len(found[0][0]) > HELD // 2:
                        yield made(found.pop())
        if found:
            yield made(nearest_of(found, k))

    return run


def nearest(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each query row.

    rows needs vec_id and embedding; other columns are ignored. is_query is a condition on vec_id. Vectors
    that are null, zero, of an unusual length or with null or non-finite components, and rows
    without id, take no part. Equal distances go to the smaller vec_id. Rows that share an id are kept apart: each
    has a ranking of its own and may be the other's neighbour. With fewer candidates all are returned; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    good, total = usable(rows)
    # The sample is bounded by SAMPLE; it is all that the driver sees of the vectors.
    some = [r["v"] for r in good.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(SAMPLE).collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(learn(np.array(some), total))
    asked = good.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    routed = stage_table(asked.mapInArrow(_route(shared), "vec_id long, v array<double>, asks boolean, part long, parts array<long>").withColumn("row", F.monotonically_increasing_id()), "routed")
    # One row for each part.
    counts = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    per_cell = min(MOST_CELL, max(LEAST_CELL, 2 * -(-total // len(counts))))
    cells = F.create_map(*(F.lit(x) for p, n in sorted(counts.items()) for x in (p, -(-n // per_cell))))
    spot = F.pmod(F.xxhash64("vec_id"), cells[F.col("part")]).cast("long")
    members = routed.select("part", spot.alias("cell"), F.lit(0).alias("query"), "row", "vec_id", "v")
    queries = routed.where("asks").select(F.explode("parts").alias("part"), "row", "vec_id", "v").where(cells[F.col("part")].isNotNull())
    queries = queries.select("part", F.explode(F.sequence(F.lit(0).cast("long"), (cells[F.col("part")] - 1).cast("long"))).alias("cell"), F.lit(1).alias("query"), "row", "vec_id", "v")
    dealt = members.unionAll(queries).repartition("part", "cell").sortWithinPartitions("part", "cell", "query")
    found = dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest() of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
