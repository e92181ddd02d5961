"""Mixing against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from millrace.llm import mixing


def weight_of(text):
    words, lines, n = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n"), len(text)
    if not words:
        return 0.01
    plain, low = len(re.sub(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", "", text)) / n, len(re.sub("[A-Z]", "", text)) / n
    return max(0.01, 1 / (1 + abs(n / len(words) - 6) / 6) * plain * low * (len(set(words)) / len(words)) * (len(set(lines)) / len(lines)))


def brute(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    out, by = [], defaultdict(list)
    for d, t, s in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        drawn = f"{'' if d is None else d}:{zlib.crc32((t or '').encode())}"
        u = (int(hashlib.md5(drawn.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((-math.log(u) / weight_of(t or ""), d is not None, d or 0, size))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total = {s: sum(x[3] for x in by[s]) for s in names}
    target, rest, free = {}, float(sum(total.values())), set(names)
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 3 * total[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: 3.0 * total[s] for s in full}
        rest -= sum(3 * total[s] for s in full)
        free -= full
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        left = math.floor(target[s] - epochs * total[s] + 1e-9)
        for _, has, d, size in sorted(by[s]):
            take = max(0, min(size, left))
            left -= size
            out.append((d if has else None, size, total[s], round(target[s], 6), epochs * size + take))
    return out


def got(df):
    return [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()]


def test_mix(spark, odd, odd_rows, none):
    rows = [(k, " ".join(["word"] * (k * 31 % 97)), ["hot", "hot", "hot", "b", "c", None, "d"][k * k % 7]) for k in range(700)] + [(9000, "tiny", "z")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter(got(out)) == Counter(brute(rows))
    want = brute([(r[0], r[1], r[3]) for r in odd_rows])
    assert Counter(got(mixing.mix(odd))) == Counter(want)
    assert all(t <= 3 * s for _, s, _, _, t in want)
    assert mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0] and [r["target"] for r in mixing.mix(blank).collect()] == [0.0, 0.0]


def test_sources_come_near_their_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 50)), f"s{k % 5}") for k in range(1000)]
    sums, targets = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(0 <= targets[s] - sums[s] < 1 for s in targets)


def test_heavy_weights_and_many_rows_of_one_id_are_dealt(spark):
    # Texts without spaces have mean word lengths of hundreds, and rows without id draw by their text.
    rows = [(None if k % 3 else k, "x" * (100 + k * 7 % 900) + f" {k}", "s") for k in range(3000)] + [(5, "same words", "s")] * 800
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    assert Counter(got(mixing.mix(df))) == Counter(brute(rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows are dealt as many are
    try:
        dealt = mixing._dealt(mixing.narrow_rows(df), "t", "source", "key", "doc_id", "size")
        sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
        assert Counter(got(mixing.mix(df))) == Counter(brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_targets_follow_the_limits(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{k:03d}": rng.choice([0, 1, 5, 50, 10_000]) * rng.randrange(1, 9) for k in range(60)}
        df = spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(6)
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
        assert math.isclose(sum(got.values()), sum(sizes.values()))
        free = [s for s in sizes if got[s] < 3 * sizes[s]]
        unit = max((got[s] / weight[s] for s in free), default=0)
        assert all(math.isclose(got[s], weight[s] * unit) for s in free)
        assert all(got[s] == 3 * sizes[s] and weight[s] * unit >= got[s] * 0.999999 for s in sizes if s not in free)


def test_rows_that_differ_are_told_apart(spark):
    text = " ".join(["w"] * 50)
    rows = [(1, text, "a", "en", "mine"), (1, text, "a", "de", "mine"), (1, text, "a", "de", "mine"), (-1, text, None, None, "x"), (None, text, "\x00", "", None), (2, text, "b", "en", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __id string")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["epochs"] + (2 * r["words"] >= r["size"])
    kinds = Counter()
    for r, n in got.items():
        kinds[r[0], r[2]] += n
    assert kinds == Counter({k: n for k, n in want.items() if n})


def test_rows(spark, odd):
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns
    taken = {(r["doc_id"], r["epochs"], 2 * r["words"] >= r["size"] > 0) for r in mixing.mix(odd).collect()}
    copies = Counter(r["doc_id"] for r in out.collect())
    for d, epochs, more in taken:
        if d in (1, 7, 8, 9, 10, 11):
            assert copies[d] == epochs + more
