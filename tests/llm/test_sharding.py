"""Hilbert shards: the curve, the law and the odd cases."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import sharding


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (4, 3)):
        cells = [c for c, _ in sorted(sharding.hilbert_table(dims, bits), key=lambda x: x[1])]
        assert sorted(cells) == list(range(1 << dims * bits))
        at = lambda c: [c >> bits * d & (1 << bits) - 1 for d in range(dims)]
        assert all(sum(abs(x - y) for x, y in zip(at(a), at(b), strict=True)) == 1 for a, b in zip(cells, cells[1:], strict=False))


def law(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_odd_rows(odd, odd_rows, none):
    for shards in (24, 3):
        got = sharding.hilbert_order(odd, shards).collect()
        law(got, len(odd_rows), shards)
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert sorted((r["doc_id"] or -1 if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.hilbert_order(none).collect() == []


def test_order_is_the_ranks(spark):
    rows = [(k, "x" * (k * 37 % 500), "en" if k % 3 else "de", f"src{k % 7}" if k % 2 else "hot") for k in range(3000)]
    got = sharding.hilbert_order(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    law(got, 3000, 24)
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in ordered] == list(range(3000))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in got)
    # Shards are compact: most hold a few of the sizes' range.
    spans = defaultdict(list)
    for r in got:
        spans[r["shard"]].append(r["size"])
    assert sum(max(v) - min(v) < 300 for v in spans.values()) >= 12
    again = sharding.hilbert_order(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string")).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_odd_sources_and_ids_do_not_fill_a_bin(spark):
    # One source of another spelling than the rest, sources with a long common start, and one id far off.
    common = "https://a-very-long-common-prefix-of-more-than-sixty-four-characters.example.org/"
    rows = [(2**62 if k == 5 else None if k == 6 else k, "x" * (k % 50), "en", "hot" if k % 3 == 0 else f"{common}{k % 40:02d}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted, total = sharding._counted(df)
    cuts = sharding.equal_depth_cuts(counted, total)
    assert [len(c) for c in cuts] == [6, 0, 7, 7]
    ids = sorted((r[0] is not None, r[0] or 0) for r in rows)
    for b, at in cuts[3]:
        assert ids.index((True, at)) == -(-b * 4000 // 8)
    sources = sorted(r[3] for r in rows)
    for b, at in cuts[0]:
        assert sources.index(at) * 8 // 4000 == b and sum(x < at for x in sources) * 8 >= b * 4000
    by = defaultdict(set)
    for r in sharding.hilbert_order(df).collect():
        by[r["shard"]].add(r["source"])
    assert sum(len(v) < 12 for v in by.values()) >= 12


def test_many_copies_of_one_row(spark):
    rows = [(7, "same", "en", "s")] * 900 + [(None, None, None, None)] * 200 + [(k, f"t{k}", "de", f"s{k % 3}") for k in range(100)]
    got = sharding.hilbert_order(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    law(got, 1200, 24)
    assert sorted(r["rank"] for r in got) == list(range(1200))
    assert sum(r["doc_id"] == 7 and r["size"] == 12 for r in got) >= 900


def test_readers_skip_shards(spark, tmp_path):
    rows = [(k, "x" * (k * 37 % 500), "en" if k % 3 else "de", f"src{k % 7}" if k % 2 else "hot", k % 5, "a") for k in range(3000)] + [(None, None, None, None, 1, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, `Run` string")
    out = str(tmp_path / "shards")
    sharding.write_shards(df, out)
    everything = sharding.read_shards(spark, out)
    assert everything.columns == df.columns
    assert sorted(map(str, everything.collect())) == sorted(map(str, df.collect()))
    size = lambda r: len(r[1] or "") + 8
    for wanted, test in (
        ({"size": (400, 420), "source": ("hot", "hot")}, lambda r: 400 <= size(r) <= 420 and r[3] == "hot"),
        ({"doc_id": (None, 100)}, lambda r: r[0] is not None and r[0] <= 100),
        ({"lang": ("de", "de"), "size": (None, 60)}, lambda r: r[2] == "de" and size(r) <= 60),
    ):
        some = sharding.read_shards(spark, out, **wanted)
        assert sorted(map(str, some.collect())) == sorted(str(r) for r in df.collect() if test(r))
        assert len(some.inputFiles()) <= len(everything.inputFiles())
        ranges = spark.read.parquet(f"{out}/ranges")
        hit = some.select(F.input_file_name()).distinct().count()
        assert 0 < hit <= ranges.count() // 2
