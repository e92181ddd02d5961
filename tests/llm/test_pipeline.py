"""Each stage of the pipeline on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline as cp
from millrace.llm import decontaminate, jaccard_join, mixing, toxicity
from millrace.llm.registry import oracle_sql, queries
from tests.llm.test_decontaminate import brute
from tests.llm.test_jaccard_join import exact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append((name, docs, out))
        docs = out
    assert all(out.columns == columns for _, _, out in seen[:-1])
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(b) == ids(toxicity.score_toxicity(a, labels).where("predicted = 0"))
    classes = exact([(r["doc_id"], r["text"]) for r in b.collect()])
    assert ids(c) == sorted({k for _, k, _, _ in classes})
    passages = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert ids(d) == sorted(r["doc_id"] for r in c.collect() if not brute(r["text"], passages)[4])
    copies = {r["doc_id"]: r["epochs"] + (2 * r["words"] >= r["size"] and r["words"] > 0) for r in mixing.mix(d).collect()}
    assert Counter(ids(e)) == Counter({k: n for k, n in copies.items() if n})
    assert ids(f) == ids(e)


def test_rows_without_anything(spark, odd, none):
    for stage in (jaccard_join.keep_one, mixing.mixed_rows):
        assert stage(none).collect() == [] and stage(odd).columns == odd.columns
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count()
    kept = jaccard_join.keep_one(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 5, 6, 7, 8, 12]
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_registered():
    assert {q.partition("_")[0] for q in queries()} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    want = c.execute(oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_clean_up(spark, odd):
    from millrace.llm.common import clean_up, stage_table, work_path

    path = work_path(spark, "t")
    assert stage_table(odd, "t", path=path).count() == odd.count() and os.path.isdir(path)
    clean_up(spark)
    assert not os.path.exists(path)
