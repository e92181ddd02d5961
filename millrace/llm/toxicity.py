"""Toxicity by the nearest labelled examples.

Labelled examples are indexed by every word they hold; a word's weight is its TF-IDF times the
root of its chi-square with the label, so that words that tell the labels apart count most.
The index is inverted and cut into blocks of similar examples. A search bounds every block by its
words' largest weights, visits the blocks with the highest bounds first and skips all whose bound
can't reach the K-th cosine found; what it returns are the exact nearest examples. They vote
with their cosines, and the vote is calibrated on leave-one-out votes of the examples themselves
(chi-squares and document frequencies are those of all examples). They are the evidence, too.

Bounded by parameters: the SAMPLE labelled rows with the smallest hashes of their ids are
learnt from, with all their words. Document frequencies count all documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import isotonic
from millrace.llm.common import fresh, held_out, labelled_fold, ranges, spread, stage_table, table, trimmed, word_column, words_of, worker_state

SAMPLE, K = 6000, 16
#: Examples of a block, and texts that are searched at once.
BLOCK, BATCH = 32, 256
#: Words in this share of the examples or more have a weight (often 0) for every example; others have postings.
DENSE = 1 / 32
#: Blocks that a search visits at first and the factor by which that grows.
FIRST, GROWTH = 2, 8
#: More than rounding can do to a cosine in single precision.
SLACK = 1e-4
#: Chi-square that a word counts with at least, so that no word is without weight.
FLOOR = 0.01
#: Results of the last texts that a worker keeps for copies.
KEPT = 20_000
THRESHOLD = 0.7


def term_counts(text: str | None, terms: dict[bytes, int]) -> np.ndarray:
    """(term, count) of a text by term, an integer array of two columns."""
    seen = Counter(map(terms.get, words_of(text)))
    seen.pop(None, None)
    found = np.array([*seen.items()], np.int32).reshape(-1, 2)
    return found[np.argsort(found[:, 0])]


def similar_order(rows: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows in which runs of block rows are similar: repeated cuts along the main direction."""
    out, stack = [], [np.arange(len(rows))]
    while stack:
        at = stack.pop()
        if len(at) <= block:
            out.append(at)
            continue
        x = rows[at] - rows[at].mean(axis=0)
        v = np.cos(np.arange(x.shape[1])).astype(rows.dtype)
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        at = at[np.argsort(np.round(x @ v, 4), kind="stable")]
        cut = block * max(1, round(len(at) / 2 / block))
        stack += [at[cut:], at[:cut]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Unit-length vectors of labelled examples by term; scale is each term's factor.

    visited and blocks count the blocks that searches have looked into and all they could have.
    """

    def __init__(self, ids: list[int], labels: list[int], vectors: list[np.ndarray], scale: np.ndarray):
        self.ids, self.labels, self.scale = np.array(ids), np.array(labels, np.float64), scale
        self.visited = self.blocks = 0
        made = [self.weights(v) for v in vectors]
        # By example: what exact cosines are made of.
        self.length = np.array([len(t) for t, _ in made], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in made)])
        self.values = np.concatenate([np.zeros(0), *(w for _, w in made)])
        n = len(made)
        held = np.bincount(self.terms, minlength=len(scale))
        common = np.nonzero(held >= max(1, DENSE * n))[0]
        self.row = np.full(len(scale), -1, np.int32)
        self.row[common] = np.arange(len(common))
        # By term, over examples in the order of blocks.
        own, place = np.repeat(np.arange(n), self.length), self.row[self.terms]
        dense = place >= 0
        matrix = np.zeros((n, len(common)), np.float32)
        matrix[own[dense], place[dense]] = self.values[dense]
        self.order = similar_order(matrix)
        blocks = -(-n // BLOCK)
        self.dense = np.zeros((blocks, len(common), BLOCK), np.float32)
        for b in range(blocks):
            some = matrix[self.order[b * BLOCK : (b + 1) * BLOCK]]
            self.dense[b, :, : len(some)] = some.T
        self.most = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        by_term = np.argsort(self.terms[~dense], kind="stable")
        self.at = self.place[own[~dense][by_term]].astype(np.int32)
        self.weight = self.values[~dense][by_term].astype(np.float32)
        self.size = np.bincount(self.terms[~dense], minlength=len(scale))
        self.start = np.cumsum(self.size) - self.size

    def weights(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length weights."""
        if not len(counts):
            return np.zeros(0, np.int32), np.zeros(0)
        t, n = np.asarray(counts, np.int32).T
        w = (1 + np.log(n)) * self.scale[t]
        return t, w / np.sqrt(w @ w)

    def search(self, counts, k: int = K, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a cosine above 0; ties to the smaller place in ids."""
        return self.search_all([counts], k, [leave])[0]

    def search_all(self, many: list, k: int = K, leave=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of each vector, BATCH at once."""
        out = []
        for low in range(0, len(many), BATCH):
            some = [self.weights(v) for v in many[low : low + BATCH]]
            out += self._search(some, k, [-1] * len(some) if leave is None else leave[low : low + BATCH])
        return out

    def _search(self, some: list[tuple[np.ndarray, np.ndarray]], k: int, leave) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks = len(self.dense)
        query = np.zeros((len(some), len(self.most)), np.float32)
        # Cosines of the words with postings, in full; what stands at a block's unused places is never found.
        rest = np.full((len(some), blocks * BLOCK), -np.inf, np.float32)
        for q, (terms, weights) in enumerate(some):
            row = self.row[terms]
            query[q, row[row >= 0]] = weights[row >= 0]
            size = self.size[terms]
            posting = ranges(self.start[terms], size)
            rest[q, : len(self.order)] = np.bincount(self.at[posting], self.weight[posting] * np.repeat(weights, size), len(self.order))
            if leave[q] >= 0:
                rest[q, self.place[leave[q]]] = -np.inf
        rest = rest.reshape(len(some), blocks, BLOCK)
        bound = query @ self.most + rest.max(axis=2, initial=-np.inf)
        found = np.full(rest.shape, -np.inf, np.float32)
        by_bound = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(some), k), -np.inf, np.float32)
        least, low, high = best[:, 0], 0, FIRST
        while low < blocks:
            turn = by_bound[:, low:high]
            go = np.zeros(bound.shape, bool)
            np.put_along_axis(go, turn, np.take_along_axis(bound, turn, axis=1) >= least[:, None] - SLACK, axis=1)
            for b in np.nonzero(go.any(axis=0))[0]:
                q = np.nonzero(go[:, b])[0]
                found[q, b] = rest[q, b] + query[q] @ self.dense[b]
            self.visited += int(go.sum())
            seen = np.take_along_axis(found, turn[:, :, None], axis=1).reshape(len(some), -1)
            best = np.partition(np.hstack([best, seen]), -k, axis=1)[:, -k:]
            least, low, high = best[:, 0], high, high * GROWTH
        self.blocks += bound.size
        return [self._exact(own, f.ravel(), t, k) for own, f, t in zip(some, found, least, strict=True)]

    def _exact(self, own: tuple[np.ndarray, np.ndarray], found: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of those found about as near as the k-th, by cosines in double precision."""
        at = self.order[np.nonzero((found >= least - SLACK) & (found > -np.inf))[0]]
        full = np.zeros(len(self.scale))
        full[own[0]] = own[1]
        size = self.length[at]
        entry = ranges(self.begin[at], size)
        cosine = np.bincount(np.repeat(np.arange(len(at)), size), full[self.terms[entry]] * self.values[entry], len(at))
        # Rounded, so that equal cosines are equal in whatever order they were added up.
        cosine = np.round(cosine, 12)
        at, cosine = at[cosine > 0], cosine[cosine > 0]
        top = np.lexsort((at, -cosine))[:k]
        return at[top], cosine[top]

    def vote(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        """Cosine-weighted share of label 1; -1 without neighbours."""
        at, cosine = found
        return float(cosine @ self.labels[at] / cosine.sum()) if len(at) else -1.0


def _built(model: dict) -> tuple[dict[bytes, int], BlockMaxIndex | None]:
    """This worker's terms and index of a broadcast model."""

    def made():
        index = BlockMaxIndex(model["ids"], model["labels"], _split(model["counts"], model["lengths"]), model["scale"]) if model["ids"] else None
        return _terms_of(model["words"]), index

    return worker_state(model["key"], made)


def _terms_of(words: bytes) -> dict[bytes, int]:
    return {w: k for k, w in enumerate(words.split())}


def _split(counts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(counts, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _count_frequencies(shared):
    def run(batches):
        terms, rows = _terms_of(shared.value), 0
        seen = np.zeros(len(terms), np.int64)
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found += [terms[w] for w in terms.keys() & set(words_of(text))]
            seen += np.bincount(np.array(found, np.int64), minlength=len(terms))
            rows += len(batch)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *at], pa.int64()), "n": pa.array([rows, *seen[at]], pa.int64())})

    return run


def _vectors(shared):
    def run(batches):
        terms = _terms_of(shared.value)
        for batch in batches:
            found = [term_counts(t, terms).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "counts"])

    return run


def _score(shared, score: str, evidence: str):
    """Adds the columns score and evidence to rows with a text."""

    def run(batches):
        model = shared.value
        terms, index = _built(model)
        known: dict = {}
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index("text")), []
            for low in range(0, len(texts), BATCH):
                counts = [term_counts(t, terms) for t in texts[low : low + BATCH].to_pylist()]
                keys = [hashlib.md5(c.tobytes()).digest() for c in counts]
                if len(known) >= KEPT:
                    known.clear()
                new = {key: c for key, c in zip(keys, counts, strict=True) if key not in known}
                for key, (at, cosine) in zip(new, index.search_all([*new.values()]) if index else [((), ())] * len(new), strict=True):
                    p = float(isotonic.apply(model["knots"], np.array([index.vote((at, cosine))]))[0]) if len(at) else model["default"]
                    known[key] = p, ",".join(f"{index.ids[a]}:{index.labels[a]:.0f}:{c:.4f}" for a, c in zip(at[:3], cosine[:3], strict=True))
                rows += [known[key] for key in keys]
            made = [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, score, evidence])

    return run


def with_scores(docs: DataFrame, labels: DataFrame, score: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs, all its columns, with the new columns score and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(build_model(docs, labels))
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(evidence, T.StringType())])
    return docs.mapInArrow(trimmed(_score(shared, score, evidence)), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, with a score below THRESHOLD; the same null and empty texts as in score_toxicity()."""
    score, evidence = fresh(docs.columns, "score", "evidence")
    return with_scores(docs, labels, score, evidence).where(F.col(score) < THRESHOLD).drop(score, evidence)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, size: int) -> DataFrame:
    """(doc_id, label, text) of the labelled rows with the smallest hashes; one row per text.

    The sample's rows are bounded by size, so its ids are broadcast. Labels of a repeated id are joined by their maximum.
    """
    known = labelled_fold(labels).where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(size)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.*")


def term_table(sample: DataFrame) -> pa.Table:
    """Every word of the sample and its chi-square with the label, by word; no rows without labels of both kinds."""
    words = sample.select("label", F.explode(F.array_distinct(word_column(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("p"))
    total = sample.agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("p")).first()
    if not total["n"] or not total["p"] or total["p"] == total["n"]:
        return pa.table({"word": pa.array([], pa.string()), "chi": pa.array([], pa.float64())})
    rows, pos = F.lit(total["n"]), F.lit(total["p"])
    n, p = F.col("n"), F.col("p")
    chi = rows * F.pow(p * rows - n * pos, 2) / F.greatest(n * pos * (rows - n) * (rows - pos), F.lit(1.0))
    return counts.select("word", chi.alias("chi")).toArrow().sort_by("word")


def build_model(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample_size: int | None = None) -> dict:
    """Words, example vectors and calibration, as the workers get them; without labels of both kinds there are no examples."""
    sc = docs.sparkSession.sparkContext
    sample = stage_table(labelled_sample(docs, labels, column, sample_size or SAMPLE), "toxicity-sample")
    found = term_table(sample)
    if not len(found):
        mean = sample.agg(F.avg("label")).first()[0]
        return {"key": uuid.uuid4().hex, "words": b"", "ids": [], "labels": [], "counts": np.zeros((0, 2), np.int32), "lengths": [], "scale": np.zeros(0), "knots": None, "default": float(mean or 0)}
    words = " ".join(found["word"].to_pylist()).encode()
    shared = sc.broadcast(words)
    rows = sample.select("doc_id", "label", "text").mapInArrow(trimmed(_vectors(shared)), "doc_id long, label int, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("counts", "ascending")])
    seen = docs.select("text").mapInArrow(trimmed(_count_frequencies(shared)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = (seen[c].to_numpy() for c in ("term", "n"))
    held = np.zeros(len(found))
    held[at[at >= 0]] = n[at >= 0]
    idf = 1 + np.log((1 + n[at < 0].sum()) / (1 + held))
    scale = idf * np.sqrt(np.maximum(found["chi"].to_numpy(), FLOOR))
    vectors = [np.frombuffer(c, np.int32).reshape(-1, 2) for c in rows["counts"].to_pylist()]
    labels_, ids = rows["label"].to_pylist(), rows["doc_id"].to_pylist()
    shared.unpersist()
    index = BlockMaxIndex(ids, labels_, vectors, scale)
    votes = np.array([index.vote(f) for f in index.search_all(vectors, leave=range(len(vectors)))])
    none = votes < 0
    default = float((index.labels[none].sum() + np.mean(labels_)) / (none.sum() + 1))
    some = ~none
    knots = isotonic.fit(votes[some], index.labels[some], np.ones(some.sum())) if some.any() else (np.zeros(1), np.full(1, default))
    return {"key": uuid.uuid4().hex, "words": words, "ids": ids, "labels": labels_, "counts": np.concatenate(vectors), "lengths": np.array([len(v) for v in vectors]), "scale": scale, "knots": knots, "default": default}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of docs.

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. Null and
    empty texts, and texts without a word of the examples, get the examples' rate among such texts.
    A very long text is one vector of its word counts, like any other; a task holds one batch of texts.
    evidence lists the three nearest examples as id:label:cosine. Equal cosines go to the smaller id. Without labels of both kinds
    every score is the base rate (0 without any). Repeated rows give repeated results; an empty table gives no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity() of all documents, with the labels of the learning fold."""
    return score_toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
