"""Toxicity and quality: exact search, calibration and held-out accuracy."""

import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import isotonic, quality, toxicity
from millrace.llm.common import words_of

SF = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = [tuple(sorted((int(t), int(rng.integers(1, 5))) for t in rng.choice(30, rng.integers(0, 7), replace=False))) for _ in range(700)]
    index = toxicity.BlockMaxIndex(list(range(700)), [k % 2 for k in range(700)], [np.array(v, np.int32).reshape(-1, 2) for v in vectors], 1 + rng.random(30))
    dense = np.zeros((700, 30))
    for k, v in enumerate(vectors):
        t, w = index.weights(v)
        dense[k, t] = w
    for k in range(0, 700, 7):
        cosine = np.round(dense @ dense[k], 12)
        cosine[k] = 0
        order = [i for i in np.lexsort((np.arange(700), -cosine)) if cosine[i] > 0][: toxicity.K]
        at, found = index.search(vectors[k], leave=k)
        assert at.tolist() == order and np.allclose(found, cosine[order])


def test_blocks_are_skipped():
    # Ten topics with words of their own: most blocks can't hold a near example.
    rng = np.random.default_rng(4)
    topic = [np.array(sorted((int(t), 1) for t in rng.choice(np.arange(40 * g, 40 * g + 40), 25, replace=False)), np.int32) for g in range(10) for _ in range(100)]
    index = toxicity.BlockMaxIndex(list(range(1000)), [0] * 1000, topic, np.ones(400))
    found = index.search_all(topic[::7])
    assert all(set(at // 100) == {7 * k // 100} for k, (at, _) in enumerate(found))
    assert 0 < index.visited < index.blocks / 4


def brute_scores(docs, labels):
    """doc_id -> (score, three nearest) from the definitions, by comparing with every example."""
    split = lambda t: words_of(t)
    known = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            known[d] = max(y, known.get(d, 0))
    chosen = set(sorted(known, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))[: toxicity.SAMPLE])
    examples = {}
    for d, t in docs:
        if d in chosen:
            examples[t or ""] = min(examples.get(t or "", (d, known[d])), (d, known[d]))
    rows = sorted((d, y, t) for t, (d, y) in examples.items())
    n, p = len(rows), sum(y for _, y, _ in rows)
    weight = {}
    for w in {w for _, _, t in rows for w in split(t)}:
        own = [y for _, y, t in rows if w in split(t)]
        chi = n * (sum(own) * n - len(own) * p) ** 2 / max(len(own) * p * (n - len(own)) * (n - p), 1)
        seen = sum(w in split(t) for _, t in docs)
        weight[w] = (1 + np.log((1 + len(docs)) / (1 + seen))) * np.sqrt(max(chi, toxicity.FLOOR))

    def vector(t):
        v = {w: (1 + np.log(c)) * weight[w] for w, c in Counter(split(t)).items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [vector(t) for _, _, t in rows]

    def nearest(v, leave=None):
        c = [(-round(sum(x * e.get(w, 0) for w, x in v.items()), 12), k) for k, e in enumerate(vectors) if k != leave]
        return [(k, -x) for x, k in sorted(c) if x < 0][: toxicity.K]

    vote = lambda f: sum(c * rows[k][1] for k, c in f) / sum(c for _, c in f)
    own = [nearest(v, k) for k, v in enumerate(vectors)]
    some = [k for k, f in enumerate(own) if f]
    knots = isotonic.fit(np.array([vote(own[k]) for k in some]), np.array([float(rows[k][1]) for k in some]), np.ones(len(some)))
    lone = [rows[k][1] for k, f in enumerate(own) if not f]
    default = (sum(lone) + p / n) / (len(lone) + 1)
    out = {}
    for d, t in docs:
        f = nearest(vector(t))
        out[d] = (float(isotonic.apply(knots, np.array([vote(f)]))[0]) if f else default, [rows[k][0] for k, _ in f[:3]])
    return out


def test_scores_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 150)
    rng = np.random.default_rng(9)
    word = lambda bad: f"{'vile' if bad else 'calm'}{int(rng.integers(12))}" if rng.random() < 0.25 else f"w{int(rng.integers(60) ** 2 / 60)}"
    docs = [(k, " ".join(word(k % 4 == 0) for _ in range(int(rng.integers(0, 30))))) for k in range(400)] + [(1000, None), (1001, "unseen only"), (1002, "W1, w1! w2")]
    docs += [(1003, docs[8][1]), (8, "calm1 w1")]
    labels = [(k, int(k % 4 == 0)) for k in range(300)] + [(5, 1), (None, 1), (7, None)]
    want = brute_scores(docs, labels)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.build_model(spark.createDataFrame(docs, "doc_id long, text string"), table, sample_size=150)
    assert len(model["ids"]) <= 150
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    for r in got:
        if r["doc_id"] != 8:  # two texts
            score, near = want[r["doc_id"]]
            assert abs(r["score"] - score) < 1e-9
            assert [int(x.split(":")[0]) for x in r["evidence"].split(",") if x] == near


def test_names_do_not_clash(spark, odd):
    table = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    named = odd.selectExpr("*", "'mine' AS __score", "'mine' AS `_SCORE`", "1 AS evidence")
    out = toxicity.drop_toxic(named, table)
    assert out.columns == named.columns and {r["__score"] for r in out.collect()} <= {"mine"}


def test_isotonic():
    x, y = isotonic.fit(np.array([3.0, 1, 2, 4, 3]), np.array([1.0, 1, 0, 1, 1]), np.ones(5), prior=0)
    # 1 and 2 are out of order and pool at 1.5; 3, 3 and 4 agree and pool at 10 / 3; between pools it is a line.
    assert isotonic.apply((x, y), np.array([0, 1.5, 10 / 3, 9])).tolist() == [0.5, 0.5, 1.0, 1.0]
    x, y = isotonic.fit(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]), np.ones(4), prior=0)
    assert (x.tolist(), y.tolist()) == ([1.0], [0.5])


def check_rows(out, odd_rows):
    assert len(out) == len(odd_rows)
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_odd_rows(spark, odd, odd_rows, none):
    some = [(k, k % 2, (k + 1) % 2, "x") for k in range(12)] + [(None, 1, 1, None), (1, None, None, None), (5, 0, 1, ""), (5, 0, 1, "")]
    for labels in (some, [], [(1, 1, 1, "x")]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")
        for f, limit in ((toxicity.score_toxicity, 0.7), (quality.score_quality, 0.5)):
            out = f(odd, table).collect()
            check_rows(out, odd_rows)
            assert all(r["predicted"] == (r["score"] >= limit) for r in out)
            assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1
            assert f(none, table).collect() == []
    assert toxicity.drop_toxic(odd, table).columns == odd.columns


@has_data
@pytest.mark.parametrize(("f", "column", "least"), [(toxicity.score_toxicity, "toxic", 0.95), (quality.score_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, f, column, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = f(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", F.col(column).alias("y")).collect()
    assert np.mean([r["predicted"] == r["y"] for r in out]) >= least


@has_data
def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, t).collect()} for t in (labels, turned)]
    assert scores[0] == scores[1]


def test_every_word_of_the_examples_is_searched(spark):
    rows = [(k, f"vile own{k}" if k % 3 == 0 else f"calm own{k}") for k in range(90)] + [(k, f"rude own{k}") for k in range(90, 96)]
    labels = spark.createDataFrame([(k, int("calm" not in t)) for k, t in rows], "doc_id long, toxic int")
    learnt = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    assert 0 < sum(k >= 90 for k in learnt) < 8  # few examples hold the word
    new = [(1000, "rude"), (1001, "calm"), (1002, f"own{learnt[0]}"), (1003, "unseen"), (1004, None)]
    out = toxicity.score_toxicity(spark.createDataFrame(rows + new, "doc_id long, text string"), labels).where("doc_id >= 1000").collect()
    got = {r["doc_id"]: (r["predicted"], r["evidence"].split(":")[0]) for r in out}
    assert got[1000][0] == 1 and int(got[1000][1]) >= 90
    assert got[1001][0] == 0 and got[1001][1]
    assert got[1002][1] == str(learnt[0])
    assert got[1003][1] == got[1004][1] == ""


def brute_quality(docs, labels):
    """doc_id -> score from the definitions: features of all rows, one normal equation, isotonic curve over the halves' cross scores."""
    known = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            known.setdefault(d, []).append(y)
    x = np.array([quality.statistics(t) for _, t in docs])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    at = [k for k, (d, _) in enumerate(docs) if d in known]
    y = np.array([np.mean(known[docs[k][0]]) for k in at])
    rng = np.random.default_rng(quality.SEED)
    some = z[sorted(at, key=lambda k: x[k].tolist())]
    far = np.linalg.norm(some - some[rng.permutation(len(some))], axis=1)
    width = np.median(far[far > 0])
    w, b = rng.normal(size=(x.shape[1], quality.FEATURES)) / width, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    f = np.hstack([np.cos(z @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(z), 1))])

    def fit(rows, goal):
        a = f[rows].T @ f[rows] + np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])
        return np.linalg.solve(a, f[rows].T @ goal)

    half = np.array([xxhash.xxh64(struct.pack("<q", docs[k][0]), seed=42).intdigest() % 2 for k in at])
    at = np.array(at)
    cross = np.where(half == 0, f[at] @ fit(at[half == 1], y[half == 1]), f[at] @ fit(at[half == 0], y[half == 0]))
    bins = np.clip(np.floor((cross + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    knots = isotonic.fit((bins + 0.5) * 2 / quality.BINS - 0.5, y, np.ones(len(y)))
    return dict(zip([d for d, _ in docs], isotonic.apply(knots, f @ fit(at, y)).tolist(), strict=True))


def test_quality_is_that_of_the_definition(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("abcdefghij"[int(rng.integers(10))] * int(rng.integers(2, 9)) for _ in range(int(rng.integers(5, 60)))) + "."
    bad = lambda: " ".join("#!9Z|"[int(rng.integers(5))] * int(rng.integers(1, 12)) for _ in range(int(rng.integers(1, 40))))
    docs = [(k, good() if k % 3 else bad()) for k in range(300)] + [(500, ""), (501, None), (502, "x" * 30_000)]
    labels = [(k, int(k % 3 > 0)) for k in range(200)] + [(4, 0), (None, 1), (6, None)]
    want = brute_quality(docs, labels)
    got = quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)


def test_statistics_are_those_of_the_whole_text():
    got = dict(zip(quality.STATISTICS, quality.statistics("Ab, c! 12|é\nAb, c! 12|é\n\n#"), strict=True))
    raw = len("Ab, c! 12|é\nAb, c! 12|é\n\n#".encode())
    assert got["log_chars"] == np.log1p(26) and got["log_words"] == np.log1p(7) and got["distinct_words"] == 4 / 7
    assert got["upper"] == 2 / raw and got["letters"] == 4 / raw and got["digits"] == 4 / raw and got["bars"] == 2 / raw and got["symbols"] == 1 / raw
    assert got["high_bytes"] == 4 / raw and got["commas"] == 2 / raw and got["exclamations"] == 2 / raw and got["log_lines"] == np.log1p(4)
    assert got["repeated_lines"] == 1 - 3 / 4 and got["capital_words"] == 2 / 7 and got["longest_word"] == np.log1p(4)


def test_capital_words_counts_all_words():
    at = quality.STATISTICS.index("capital_words")
    assert quality.statistics("a b C D E F G H i j")[at] == 0.6
    assert quality.statistics("A b")[at] == 0.5 and quality.statistics(None)[at] == quality.statistics("")[at] == 0
