"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

One pass over the texts gives a narrow table of statistics. They are standardised over all
documents; FEATURES random cosines approximate a Gaussian kernel on them; the normal equations
of all labelled rows are summed by partition; two half fits score each other's rows, and an
isotonic curve through those scores calibrates the full fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import isotonic
from millrace.llm.common import held_out, labelled_fold, spread, stage_table, table

FEATURES, RIDGE, BINS, SEED = 256, 1.0, 2000, 7
#: Rows that the kernel's width is taken from (the median distance of random pairs).
WIDTH_ROWS = 1000
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "stops", "commas",
    "exclamations", "bars", "symbols", "other_marks", "high_bytes", "distinct_words", "log_lines", "repeated_lines", "line_words", "capital_words",
)
_GROUPS = np.zeros((256, 10))
for _k, _chars in enumerate(
    (bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\n\v\f", b".", b",;:", b"!?", b"|", b"#$%&*@^~_=+<>/\\", bytes(range(128, 256)))
):
    _GROUPS[list(_chars), _k] = 1


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text; shares of nothing are 0."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    low, up, digit, space, stop, comma, shout, bar, symbol, high = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUPS / n
    words, lines = text.split(), text.split("\n")
    sizes = list(map(len, words))
    k = max(1, len(words))
    known = low + up + digit + space + stop + comma + shout + bar + symbol + high
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), min(40.0, sum(sizes) / k), float(np.log1p(max(sizes, default=0))),
        low, up, digit, space, stop, comma, shout, bar, symbol, max(0.0, 1 - known) if raw else 0.0, high,
        len(set(words)) / k, float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), float(np.log1p(k / len(lines))), sum(w[0].isupper() for w in words) / k,
    ]


def _features(batches):
    for batch in batches:
        out = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], names=["doc_id", *STATISTICS])


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Random cosines of standardised statistics, and a constant."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    z = np.cos(z @ model["w"] + model["b"]) * np.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(z), 1))])


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(STATISTICS))])


def _sums(shared):
    """Normal equations of a partition, for each half of its rows."""

    def run(batches):
        d = FEATURES + 1
        total = np.zeros((2, d, d + 1))
        for batch in batches:
            z, y = fourier(_matrix(batch), shared.value), batch.column(len(STATISTICS)).to_numpy(zero_copy_only=False)
            half = batch.column(len(STATISTICS) + 1).to_numpy(zero_copy_only=False)
            for h in (0, 1):
                p = z[half == h]
                total[h] += np.hstack([p.T @ p, (p.T @ y[half == h])[:, None]])
        if total.any():
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _added(batches):
    total = None
    for batch in batches:
        for b in batch.column(0).to_pylist():
            got = np.frombuffer(b)
            total = got.copy() if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def solve(sums: np.ndarray) -> np.ndarray:
    d = FEATURES + 1
    penalty = np.eye(d) * RIDGE
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(sums[:, :d] + penalty, sums[:, d])


def _cross(shared):
    """Each row's score by the fit of the other half, as a bin."""

    def run(batches):
        for batch in batches:
            z = fourier(_matrix(batch), shared.value)
            half = batch.column(len(STATISTICS) + 1).to_numpy(zero_copy_only=False)
            s = np.where(half == 0, z @ shared.value["halves"][1], z @ shared.value["halves"][0])
            bins = np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(len(STATISTICS))], names=["bin", "label"])

    return run


def _scores(shared):
    def run(batches):
        for batch in batches:
            model = shared.value
            s = isotonic.apply(model["knots"], fourier(_matrix(batch), model) @ model["fit"])
            yield pa.RecordBatch.from_arrays([batch.column(len(STATISTICS)), pa.array(s)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. Null and
    empty texts are scored by their statistics, all of a text of length 0; a very long text is read whole, and a task holds
    one batch of texts. Labels of a repeated id are averaged, so that
    each id counts once. Without labelled rows every score is 0. Repeated rows give repeated results; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    kinds = ", ".join(f"{c} double" for c in STATISTICS)
    rows = stage_table(docs.select("doc_id", "text").mapInArrow(_features, f"doc_id long, {kinds}"), "statistics")
    known = labelled_fold(labels).where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    train = stage_table(rows.join(known, "doc_id").select(*STATISTICS, "label", half), "labelled")
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in STATISTICS), *(F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS)).first()
    # WIDTH_ROWS rows at most, in an order that follows from them alone.
    some = np.array(sorted(list(r) for r in train.select(*STATISTICS).orderBy(F.xxhash64(*STATISTICS)).limit(WIDTH_ROWS).collect()))
    flag = held_out(F.col("doc_id")).alias("held_out")
    if not len(some):
        return rows.select("doc_id", flag, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rng = np.random.default_rng(SEED)
    model = {"mean": np.array([stats[f"m_{c}"] for c in STATISTICS]), "scale": np.array([max(stats[f"s_{c}"], 1e-6) for c in STATISTICS])}
    z = np.clip((some - model["mean"]) / model["scale"], -8, 8)
    far = np.linalg.norm(z - z[rng.permutation(len(z))], axis=1)
    width = float(np.median(far[far > 0])) if (far > 0).any() else 1.0
    model |= {"w": rng.normal(size=(len(STATISTICS), FEATURES)) / width, "b": rng.uniform(0, 2 * np.pi, FEATURES)}
    # Sums by partition, then by 8 groups of partitions: the driver adds 8 matrices at most.
    sums = train.mapInArrow(_sums(sc.broadcast(model)), "sums binary").repartition(8).mapInArrow(_added, "sums binary").collect()
    halves = sum(np.frombuffer(r["sums"]) for r in sums).reshape(2, FEATURES + 1, FEATURES + 2)
    model |= {"halves": [solve(h) for h in halves], "fit": solve(halves.sum(axis=0))}
    bins = train.mapInArrow(_cross(sc.broadcast(model)), "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    at = np.array([(r["bin"], r["p"], r["n"]) for r in bins.collect()], np.float64)
    model["knots"] = isotonic.fit((at[:, 0] + 0.5) * 2 / BINS - 0.5, at[:, 1], at[:, 2])
    scored = rows.select(*STATISTICS, "doc_id").mapInArrow(_scores(sc.broadcast(model)), "doc_id long, score double")
    return scored.select("doc_id", flag, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality() of all documents, with the labels of the learning fold."""
    return score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
