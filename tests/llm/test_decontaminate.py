"""Benchmark windows against plain search."""

import hashlib

from millrace.llm import decontaminate as dc
from millrace.llm.common import words_of

ITEM = "id long, item_id long, text string, score string"


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n and item is not None else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def items_of():
    return [
        (1, " ".join(f"q{k}" for k in range(15))),
        (2, "THE quick, brown fox"),
        (10, "no id here"),
        (3, "日本 😀"),
        (4, ""),
        (5, None),
        (None, "lazy dog"),
        (2, "the quick brown fox"),
        (6, "q3 q4"),
    ]


def docs_of():
    run = " ".join(f"q{k}" for k in range(15))
    return [run, run + " x " + run, "x " + " ".join(f"q{k}" for k in range(9)), "a. The-QUICK brown\nfox! jumps", "xq3 q4", "q3  q4", "日本 😀", "lazy dog", None, "", "q4 q3 q4 q3 q4"]


def table(spark):
    return spark.createDataFrame([(0, i, t, "x") for i, t in items_of()], ITEM)


def test_windows(spark, odd, odd_rows, none):
    rows = list(enumerate(docs_of())) + [(1 << 60, "lazy dog q3 q4"), (None, "q3 q4")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, items string")
    texts = {d: t for d, t in rows}
    for limit in (40_000, 2):  # one automaton, and several passes
        for r in dc.decontaminate(df, table(spark), limit=limit).collect():
            assert len(r["items"]) == r["n_items"] and r["items"] == sorted(r["items"])
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items_of())
            got = [texts[r["doc_id"]][int(a) : int(b)] for a, b in (s.split(":") for s in r["spans"].split(",") if s)]
            assert sum(len(words_of(g)) for g in got) == r["n_hit"]
    assert dc.decontaminate(odd, table(spark)).count() == len(odd_rows)
    assert dc.decontaminate(none, table(spark)).collect() == []
    assert dc.decontaminate(df, table(spark).limit(0)).where("contaminated").count() == 0


def test_ids_that_hold_commas(spark):
    items = spark.createDataFrame([("a,b", "the quick fox"), ("b", "lazy dog"), ("", "x y z")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "a lazy dog, the quick fox"), (3, "x y z")], "doc_id long, text string")
    for limit in (40_000, 1):
        got = {r["doc_id"]: (r["n_items"], r["items"], r["items_sha256"]) for r in dc.decontaminate(docs, items, limit=limit).collect()}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got == {1: (1, ["a,b"], digest("a,b")), 2: (2, ["a,b", "b"], digest("a,b,b")), 3: (1, [""], digest(""))}


def test_drop(spark, odd, odd_rows):
    for limit in (40_000, 2):
        kept = dc.drop_contaminated(odd, table(spark), limit=limit)
        assert kept.columns == odd.columns
        assert sorted(str(r["text"]) for r in kept.collect()) == sorted(str(r[1]) for r in odd_rows if not brute(r[1], items_of())[4])
