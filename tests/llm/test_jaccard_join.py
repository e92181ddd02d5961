"""Near-copy classes against exact pairwise comparison."""

import random
from collections import Counter

import numpy as np

from millrace.llm import jaccard_join as jj
from millrace.llm.common import words_of
from millrace.llm.components import components


def exact(rows):
    """Sorted (doc_id, class, links, text id) of rows (doc_id, text) by comparing all pairs of texts."""
    ids = {}
    for d, t in rows:
        ids.setdefault(t or "", []).append(d)
    least = lambda some: min((d for d in some if d is not None), default=None)
    sets = {}
    for t in ids:
        w = words_of(t)
        n = min(5, len(w))
        sets[t] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root, links = {t: t for t in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = sorted(sets)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if (u := len(sets[a] | sets[b])) and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * u:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    group = {}
    for t in texts:
        group.setdefault(find(t), []).extend(ids[t])
    return sorted(((d, least(group[find(t or "")]), links[t or ""], least(ids[t or ""])) for d, t in rows), key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["text_id"]) for r in jj.jaccard_classes(df).collect()), key=str)


def test_groups_of_near_copies(spark, monkeypatch):
    # Several blocks a bucket and a cluster, and some chunks of pairs.
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj, "NEAR_BLOCK", 8)
    monkeypatch.setattr(jj, "PAIRS", 100)
    rng, rows = random.Random(3), []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 60])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == exact(rows)


def test_odd_rows(odd, odd_rows, none):
    assert got(odd) == exact([r[:2] for r in odd_rows])
    assert jj.jaccard_classes(none).collect() == [] and jj.keep_one(none).collect() == []


def _text(rng, base, n):
    words = list(base)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_texts_are_compared_whatever_their_ids(spark):
    rng = random.Random(11)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    ax, ay, bx, by = " ".join(a), " ".join([*a[:-1], "y"]), " ".join(b), " ".join([*b[:-1], "y"])
    for rows in ([(1, ax), (1, bx), (2, ay), (3, by)], [(3, by), (2, ay), (1, bx), (1, ax), (1, ax)], [(None, ax), (None, ay), (None, bx), (4, by)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(df) == exact(rows)
        kept = [tuple(r) for r in jj.keep_one(df).collect()]
        assert len(kept) == 2 and {t in (ax, ay) for _, t in kept} == {True, False}
    df = spark.createDataFrame([(1, ax, "q", {"m": 1}), (1, ax, "p", {"m": 2}), (None, bx, None, None)], "doc_id long, text string, `node.` string, Key map<string,int>")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jj.keep_one(df).collect())
    assert kept == [(0, bx), (1, ax)] and jj.keep_one(df).columns == df.columns


def test_loose_chains_do_not_make_clusters(spark):
    # Neighbours share about half of their shingles: many bands collide, but no pair may reach the threshold.
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120 + 35 * 300)]
    rows = [(k, " ".join(words[35 * k : 35 * k + 120])) for k in range(300)]
    sets = [jj.shingles(t) for _, t in rows]
    sig = np.stack([jj.signature(s) for s in sets])
    bands = [set(jj.band_keys(s).tolist()) for s in sig]
    assert sum(bool(x & y) for x, y in zip(bands, bands[1:], strict=False)) > 200
    assert sum(len(jj.likely(sig[k : k + 1].astype(np.uint8), sig[k + 1 : k + 2].astype(np.uint8))) for k in range(299)) < 10
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == exact(rows)


def test_shingle_hashes_tell_sets_apart():
    a, b = "a b c d e f", "A  b, c d E"
    assert len(jj.shingles(a)) == 2 and len(np.intersect1d(jj.shingles(a), jj.shingles(b))) == 1
    assert len(jj.shingles("x y")) == 1 and len(jj.shingles("")) == len(jj.shingles(None)) == 0
    texts = {f"{x} {y} {z} q r" for x in "abcdef" for y in "abcdef" for z in "abcdef"}
    assert len({int(jj.shingles(t)[0]) for t in texts}) == len(texts)


def test_pieces_make_no_difference(monkeypatch):
    text = " ".join(f"w{k % 701}" for k in range(5000))
    whole = jj.shingles(text)
    for piece in (1, 7, 4996, 4997):
        monkeypatch.setattr(jj, "PIECE", piece)
        assert np.array_equal(jj.shingles(text), whole)
    assert len(whole) == 701 and len(jj.shingles("a b c d")) == 1


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        sig = np.stack([jj.signature(pool[:90]), jj.signature(pool[10:])])  # exactly 0.8
        lost += not len(jj.surviving(sig, np.array([0]), np.array([1]))[0])
        lost += not len(jj.likely(sig[:1].astype(np.uint8), sig[1:].astype(np.uint8)))
    assert lost == 0
    far = np.stack([jj.signature(rng.integers(0, 1 << 63, 90).astype(np.uint64)) for _ in range(2)])
    assert not len(jj.surviving(far, np.array([0]), np.array([1]))[0])
    assert not len(jj.likely(far[:1].astype(np.uint8), far[1:].astype(np.uint8)))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: find(x) for x in list(root)}
    assert components(df.where("a > 1000")).collect() == []
